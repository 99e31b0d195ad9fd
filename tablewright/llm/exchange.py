"""Exchange of distinct words: texts stay where they are, their words meet by hash, answers come back.

A task cuts its texts into chunks of some megabytes. A chunk sends its distinct words, each to the
part that the word's hash names; whatever is worked out there for a word comes back to the chunks
that hold it, where the chunk's texts, as numbers of words, are waiting. Rows are few and large:
one for each chunk and part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from tablewright.llm.common import stored

# Characters of text after which a chunk ends; a longer text is a chunk by itself.
CHUNK_SIZE = 32 << 20
ROWS = "kind int, chunk long, part int, payload binary, extra binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
WORDS, TEXTS, REPLIES = 0, 1, 2


class Numbers(dict):
    """Distinct words in order of first sight."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def packed(arrays: list[bytes]) -> bytes:
    """Byte strings as one compressed payload."""
    lengths = np.fromiter(map(len, arrays), np.uint32, len(arrays)).tobytes()
    body = len(arrays).to_bytes(8, "little") + lengths + b"".join(arrays)
    return len(body).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(payload: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(payload[8:], max_output_size=int.from_bytes(payload[:8], "little"))
    count = int.from_bytes(body[:8], "little")
    lengths = np.frombuffer(body, np.uint32, count, 8)
    ends = np.cumsum(lengths, dtype=np.int64) + 8 + 4 * count
    return [body[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def rows(values: list[tuple]) -> pa.RecordBatch:
    """Rows of the exchange."""
    return pa.RecordBatch.from_arrays(
        [pa.array([v[i] for v in values], k) for i, k in enumerate(_KINDS)], ["kind", "chunk", "part", "payload", "extra"]
    )


def _chunk(ids: list, texts: list[str], counted: list[bool], parts: int, kind: int, split: Callable) -> pa.RecordBatch:
    """The rows of a chunk: its distinct words by part, or its texts as numbers of words.

    Words are numbered by falling frequency, as small numbers pack well; a part lists its words in
    that order with its occurrences in counted texts, and the texts come with the part of every number.
    """
    seen = Numbers()
    numbered = [np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)) for words in map(split, texts)]
    words = [w if isinstance(w, bytes) else w.encode() for w in seen]
    flat = np.concatenate([np.zeros(0, np.uint32), *numbered])
    falling = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    part = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(parts))[falling]
    name = xxhash.xxh3_64()
    for key, text in zip(ids, numbered, strict=True):
        name.update(f"{key}:{len(text)};")
    name.update(b"\n".join(words))
    chunk = name.intdigest() >> 1
    if kind == WORDS:
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        chosen = [(p, falling[order[edges[p] : edges[p + 1]]].tolist()) for p in range(parts) if edges[p] < edges[p + 1]]
        lengths = np.fromiter(map(len, numbered), np.int64, len(numbered))
        counts = np.bincount(flat[np.repeat(np.array(counted, bool), lengths)], minlength=len(words)).astype(np.uint32)
        return rows([(WORDS, chunk, p, packed([words[i] for i in numbers]), packed([counts[numbers].tobytes()])) for p, numbers in chosen])
    rank = np.empty(len(words), np.uint32)
    rank[falling] = np.arange(len(words), dtype=np.uint32)
    planes = rank[flat].view(np.uint8).reshape(-1, 4).T
    lengths = np.fromiter(map(len, numbered), np.uint32, len(numbered))
    keys = np.array([i is not None for i in ids], bool), np.array([i or 0 for i in ids], np.int64)
    body = [x.tobytes() for x in (*keys, lengths, part.astype(np.uint32).view(np.uint8).reshape(-1, 4).T, *planes)]
    return rows([(TEXTS, chunk, -1, packed(body), None)])


def numbers_of(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, words per text, number of every word, and part of every number, as ``_chunk`` packed them."""
    present, keys, lengths, part, *planes = unpacked(payload)
    whole = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in (part, b"".join(planes))]
    keys = np.frombuffer(keys, np.int64)
    keys = [k if p else None for k, p in zip(keys.tolist(), np.frombuffer(present, bool).tolist(), strict=True)]
    return keys, np.frombuffer(lengths, np.uint32), whole[1], whole[0]


def split_texts(texts: DataFrame, parts: int, kind: int, split: Callable, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """The rows of one kind for ``texts`` (doc_id, text and, for counting, counted).

    Both kinds must come from the same rows in the same order: see ``settled``.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, counted, size = [], [], [], 0
        for batch in stream:
            flags = batch.column(2).to_pylist() if batch.num_columns > 2 else [False] * batch.num_rows
            for key, text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flags, strict=True):
                ids.append(key)
                held.append(text or "")
                counted.append(flag)
                size += len(held[-1]) + 16
                if size >= chunk_size:
                    yield _chunk(ids, held, counted, parts, kind, split)
                    ids, held, counted, size = [], [], [], 0
        if ids:
            yield _chunk(ids, held, counted, parts, kind, split)

    return texts.mapInArrow(run, ROWS)


def settled(texts: DataFrame) -> DataFrame:
    """``texts`` if read straight from files, which any task reads alike, else written to the shared folder first."""
    return stored(texts, "texts") if "Exchange" in texts._jdf.queryExecution().executedPlan().toString() else texts


def replies_by_number(part: np.ndarray, replies: dict[int, list]) -> list:
    """The answer to every number of a chunk. ``replies`` has those of each part in the order of its words."""
    found: list = [None] * len(part)
    order = np.argsort(part, kind="stable")
    for numbers in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(part) else []:
        for number, reply in zip(numbers.tolist(), replies[int(part[numbers[0]])], strict=True):
            found[number] = reply
    return found
