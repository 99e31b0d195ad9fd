"""BPE encoding over a table of distinct words, and decoding through a table of pieces.

Texts are split into words at spaces where no token can cross (a space after a character that is
certainly not white space; the space belongs to the word it precedes, so specials and runs of white
space stay inside one word). A task numbers the distinct words of its texts and keeps each text as
those numbers, a few megabytes of text at a time (a chunk). The words of all chunks meet by hash,
each distinct word is encoded once, and the ids go back to the chunks that hold the word, where
they are joined to the positions. Neither texts nor positions ride along with the words.

Texts are split twice, for the words and for the positions, rather than kept in between; a chunk is
named by its contents, and a chunk whose ids don't all come back is an error. Input that is not
read straight from files is written to the shared folder first, so that both passes and any repeated
task see the same rows in the same order.

Defined cases: null text encodes as the empty text, to no ids; repeated rows and ids are each
encoded as rows of their own; one text is never split over chunks, however long; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tablewright.llm.common import parts_for
from tablewright.llm.exchange import (
    CHUNK_SIZE,
    REPLIES,
    ROWS,
    TEXTS,
    WORDS,
    numbers_of,
    packed,
    replies_by_number,
    rows,
    settled,
    split_texts,
    unpacked,
)

TOKENIZER = "byte_bpe_50k.json"
ENCODED = "doc_id long, ids binary, decoded binary"

@cache
def tokenizer(name: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, loaded once per worker, without truncation or padding."""
    built = Tokenizer.from_file(public_tokenizers.path(name))
    built.no_truncation()
    built.no_padding()
    return built


# A space after what some tokenizer may count as white space.
UNSURE = re.compile("[\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff] ")


def words_at_spaces(text: str) -> list[str]:
    """Words whose tokens do not depend on their neighbours; joined they give the text.

    Every word but the first starts with a space that follows a character which no tokenizer
    counts as white space.
    """
    if not text:
        return []
    words = text.split(" ")
    if words[0] and not UNSURE.search(text):
        return [words[0], *[" " + w for w in words[1:]]]
    out, last = [words[0]], words[0]
    for word in words[1:]:
        if last == "" or UNSURE.match(last[-1] + " "):
            out[-1] += " " + word
        else:
            out.append(" " + word)
        last = word
    return out


def _encode(name: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, known = tokenizer(name), None, {}
        assert tok.get_vocab_size() <= 1 << 16  # ids travel as 16 bits
        for batch in stream:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, known = row["part"], {}
                words = unpacked(row["payload"])
                fresh = list(dict.fromkeys(w for w in words if w not in known))
                for start in range(0, len(fresh), 20_000):
                    some = fresh[start : start + 20_000]
                    found = tok.encode_batch([w.decode() for w in some], add_special_tokens=False)
                    known.update((w, np.array(e.ids, np.uint16).tobytes()) for w, e in zip(some, found, strict=True))
                yield rows([(REPLIES, row["chunk"], part, packed([known[w] for w in words]), None)])

    return run


@cache
def pieces_of(name: str) -> list[bytes]:
    """The bytes of every id; the table has as many rows as the vocabulary."""
    tok = tokenizer(name)
    base = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {chr(b): b for b in base} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(base)))}
    assert set(shown) == set(pre_tokenizers.ByteLevel.alphabet())
    special = tok.get_added_tokens_decoder()
    pieces = []
    for i in range(max(tok.get_vocab(with_added_tokens=True).values()) + 1):
        token = tok.id_to_token(i) or ""
        pieces.append(token.encode() if i in special else bytes(shown[c] for c in token))
    return pieces


def _join(name: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        piece = pieces_of(name).__getitem__
        held = table.select(["kind", "part", "payload"]).to_pylist()
        replies = {r["part"]: unpacked(r["payload"]) for r in held if r["kind"] == REPLIES}
        out_keys, out_ids, out_text = [], [], []
        for row in held:
            if row["kind"] != TEXTS:
                continue
            keys, lengths, flat, part = numbers_of(row["payload"])
            ids = replies_by_number(part, replies)
            ends = np.cumsum(lengths)
            for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
                joined = b"".join(map(ids.__getitem__, flat[end - length : end].tolist()))
                out_ids.append(np.frombuffer(joined, np.uint16).astype("<u4").tobytes())
                out_text.append(b"".join(map(piece, np.frombuffer(joined, np.uint16).tolist())))
            out_keys += keys
        # Pieces may cut a character; what is then no UTF-8 becomes the replacement character.
        out_text = [t.decode("utf-8", "replace").encode() for t in out_text]
        return pa.table(
            [pa.array(out_keys, pa.int64()), pa.array(out_ids, pa.binary()), pa.array(out_text, pa.binary())],
            names=["doc_id", "ids", "decoded"],
        )

    return run


def encode_decode(
    documents: DataFrame, name: str = TOKENIZER, key: str = "doc_id", text: str = "text", chunk_size: int = CHUNK_SIZE, finish=None, schema: str = ENCODED
) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit) and the decoded bytes.

    ``finish`` (table of these columns to table of ``schema``) runs in the joining task, for results
    that need not carry the ids and texts further.
    """
    texts = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = settled(texts)
    parts = parts_for(texts)
    words = split_texts(texts, parts, WORDS, words_at_spaces, chunk_size).repartition(parts, "part").sortWithinPartitions("part", "chunk")
    replies = words.mapInArrow(_encode(name), ROWS)
    both = replies.unionByName(split_texts(texts, parts, TEXTS, words_at_spaces, chunk_size)).groupBy("chunk")
    join = _join(name)
    if finish is None:
        return both.applyInArrow(join, ENCODED)
    return both.applyInArrow(lambda k, t: finish(join(k, t)), schema)


def digests(table: pa.Table) -> pa.Table:
    """Counts and checksums of ids and decoded texts."""
    ids, texts = table["ids"].to_pylist(), table["decoded"].to_pylist()
    return pa.table(
        [
            table["doc_id"],
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def document_digests(documents: DataFrame, name: str = TOKENIZER) -> DataFrame:
    return encode_decode(documents, name, finish=digests, schema=DIGESTS)
