"""Token ids as Parquet files: list columns, small row groups, page indexes.

Documents are encoded, dealt out by ranges of their id, numbered (``start`` is the number of ids
before a document) and written sorted. Ids are a dictionary-encoded list column, keys and offsets
are delta-encoded, row groups and pages are small and every page carries its least and greatest
values, so a reader fetches the ids of a few documents, or the offsets alone, without the rest.

Defined cases: null text is the empty text and gives the end id alone; a null key sorts first;
documents with one key sort by the ids themselves; an empty table gives an empty file set.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.bpe import tokenizer
from tablewright.llm.common import parts_for, stored
from tablewright.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 64 << 10, 1_000
# Distinct words that a worker remembers, over all its tasks.
REMEMBERED = 1_000_000

# Format options fixed by the Parquet writer: version 2 pages encode integers without a dictionary by delta.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


# Bytes as the characters that the vocabulary writes them with: those that Latin-1 prints stand for themselves, the others follow from 256.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))


class Ids(dict):
    """The ids of a word as bytes, remembered; the tokenizer sees a word alone."""

    def __init__(self, name: str):
        super().__init__()
        tok = tokenizer(name)
        self.encode, self.pieces = tok.encode, tok.model.tokenize
        self.kind = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        # Small Latin letters alone: nothing to normalise or split, so the model gets them without these steps.
        if word.isascii() and word.isalpha() and word.islower():
            ids = [piece.id for piece in self.pieces(word)]
        elif word.isalpha() and max(word) <= "\u024f" and word.lower() == word:
            ids = [piece.id for piece in self.pieces(word.encode().decode("latin-1").translate(BYTES))]
        else:
            ids = self.encode(word, add_special_tokens=False).ids
        value = self[word] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return value


@cache
def remembered(name: str) -> Ids:
    return Ids(name)


# Letters, numbers and white space up to U+024F as Unicode classes them, and the contractions of the tokenizer's pattern.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
TOKEN = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{LETTERS}{NUMBERS}{SPACES}]+")
PLAIN = re.compile("[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9\t-\r ]+")
# Beyond these characters case and composition may depend on neighbours, and special tokens come first.
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]|<\\|")


# Kinds of bytes: letters and digits, white space, full stops and commas, what white space is to ``str.split`` only, the rest.
KINDS = bytes(
    ord("." if c in b".," else "?" if 0x1C <= c <= 0x1F else " " if c in b"\t\n\v\f\r " else "a" if c >= 0x80 or chr(c).isalnum() else "!")
    for c in range(256)
)
# Full stops and commas that touch more than the end of a word, and texts that ``str.split`` would split elsewhere.
ODD = (b"?", b".a", b"..", b".!", b"!.")
# In UTF-8, what is beyond ASCII and up to U+024F and no letter; U+00AA, U+00B5 and U+00BA count among these.
NO_LETTERS = (b"\xc2", b"\xc3\x97", b"\xc3\xb7")


def words_for(text: str) -> list[str]:
    """Words that the lower-casing tokenizer treats alone.

    Texts in other scripts are split at spaces. Latin texts are split at white space, full stops and commas that
    end a word apart, which is faster than the tokenizer's pattern; where they stand otherwise, into its own tokens.
    """
    plain = text.isascii() and "<|" not in text
    if not plain and OTHER.search(text):
        return text.split(" ")
    text = text.lower()
    raw = text.encode()
    kinds = raw.translate(KINDS)
    if any(x in kinds for x in ODD) or not plain and any(x in raw for x in NO_LETTERS):
        return PLAIN.findall(text) if plain else TOKEN.findall(text)
    return text.replace(".", " .").replace(",", " ,").split()


def _encoded(name: str, end_id: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(name)
        end, size = np.array([end_id], known.kind).tobytes(), known.kind.itemsize
        for batch in stream:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [b"".join([*map(known.__getitem__, words_for(t or "")), end]) for t in part.column(1).to_pylist()]
                lengths = pa.array([len(x) // size for x in ids], pa.int64())
                # The hash of the ids parts rows of one key that would otherwise all lie in one range.
                tie = pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, tie, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "tie", "ids"])

    return run


def _listed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids from packed bytes to lists of integers."""
    for batch in stream:
        packed, lengths = batch.column("ids").cast(pa.large_binary()), batch.column("n_tokens").to_numpy()
        # The bytes of all rows lie in one piece.
        _, ends, data = packed.buffers()
        first, last = np.frombuffer(ends, np.int64)[[packed.offset, packed.offset + len(packed)]].tolist() if len(packed) else (0, 0)
        kind = np.dtype("<u2" if last - first == 2 * lengths.sum() else "<u4")
        flat = np.frombuffer(data, kind, (last - first) // kind.itemsize, first).astype(np.int32) if last > first else np.zeros(0, np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        kept = [batch.column(c) for c in ("part", "doc_id", "tie", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, pa.array(flat))], ["part", "doc_id", "tie", "n_tokens", "ids"])


def write_tokens(documents: DataFrame, path: str, name: str = TOKENIZER, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``documents`` into ``path``: ids in ``tokens``, the offsets of all documents in ``index``."""
    texts = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Dealing out by ranges looks at the rows twice, the first time without ids, so they are encoded once and kept.
    encoded = stored(texts.mapInArrow(_encoded(name, end_id), "doc_id long, n_tokens long, tie long, ids binary"), "encoded")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    placed = encoded.repartitionByRange(parts_for(encoded), *order)
    rows = placed.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "tie", "n_tokens", "ids")
    rows = rows.mapInArrow(_listed, "part int, doc_id long, tie long, n_tokens long, ids array<int>")
    rows.write.options(**LAYOUT).partitionBy("part").parquet(f"{path}/tokens")
    spark = documents.sparkSession
    numbered(_tokens(spark, path, "doc_id long, tie long, n_tokens long")).drop("tie").write.options(**LAYOUT).parquet(f"{path}/index")


def _tokens(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, part int").parquet(f"{path}/tokens")


def numbered(rows: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """``rows`` of the token files with ``start``.

    One sum per file gives the ids in the files before it; within a file a running sum does. The sums
    come from ``narrow``, the same rows without what is costly to work out twice.
    """
    sums = (rows if narrow is None else narrow).groupBy("part").agg(F.sum("n_tokens").alias("_in"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("_before")
    return rows.join(before, "part").withColumn("start", start).drop("_before")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, part of every document, without touching ids."""
    return spark.read.schema("doc_id long, n_tokens long, start long, part int").parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str, keys: Sequence[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids; with ``keys`` only the row groups and pages that can hold them are read."""
    rows = _tokens(spark, path, "doc_id long, n_tokens long, ids array<int>").drop("part")
    return rows if keys is None else rows.where(F.col("doc_id").isin(list(keys)))


def _checksums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        ids = batch.column("ids")
        values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = 4 * np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        whole = memoryview(values).cast("B")
        crc = [zlib.crc32(whole[start:end]) for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ids) else []
        kept = [batch.column(c) for c in ("part", "doc_id", "tie", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], ["part", "doc_id", "tie", "n_tokens", "ids_crc32"])


def document_checksums(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``documents``, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(documents, path)
    rows = _tokens(spark, path, "doc_id long, tie long, n_tokens long, ids array<int>")
    checked = rows.mapInArrow(_checksums, "part int, doc_id long, tie long, n_tokens long, ids_crc32 long")
    return numbered(checked, _tokens(spark, path, "n_tokens long")).select("doc_id", "start", "n_tokens", "ids_crc32")
