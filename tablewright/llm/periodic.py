"""Periodic runs of words: stretches that repeat themselves four times or more, and texts without the repeats.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), at
least max(6, 4 q) words long, that no neighbouring word extends. Every word of a run occurs four
times in it. So a word that occurs fewer than four times in a segment is in no run of that segment
and splits it; the pieces are split again by their own counts until nothing changes, all documents of
a chunk at once. What survives is scanned by lags. A run of period q covers three multiples of q in a
row at which the word equals the one q later; only such places are extended to both sides, so that a
segment of m words costs about m log m, whatever its periods.

Defined cases: null and empty texts have no words and no run; rows without an id and repeated rows
are rows like any other; an empty table gives an empty result. A document is worked on by one task,
whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import binaries, unwrapped, wrapped
from tablewright.llm.exchange import Numbers

LEAST_REPEATS, LEAST_WORDS = 4, 6
# Splitting ends early once a level takes less than this share of the words it looked at; the scan needs no stable segments.
WORTHWHILE = 0.01
# Sixteenths of a lag at which places are looked at once more before they are extended.
BETWEEN = (8, 24, 4, 12, 20, 28, 2, 6, 10, 14, 18, 22, 26, 30)
# Bytes of text that are split and numbered together; a longer text is a chunk by itself.
CHUNK = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def segments(words: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the segments of numbered ``words`` that can hold runs; none spans two documents."""
    at = np.arange(len(words))
    kinds = int(words.max()) + 1 if len(words) else 0
    done: list[tuple[int, int]] = []
    while len(at):
        new = np.concatenate([[True], (np.diff(at) != 1) | (document[at[1:]] != document[at[:-1]])])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(at)))
        segment = np.repeat(np.arange(len(starts)), lengths)
        _, number, count = np.unique(segment * kinds + words[at], return_inverse=True, return_counts=True)
        keep = (count[number] >= LEAST_REPEATS) & (lengths[segment] >= LEAST_WORDS)
        stable = np.logical_and.reduceat(keep, starts)
        if len(at) - np.count_nonzero(keep) < WORTHWHILE * len(at):
            stable = lengths >= LEAST_WORDS
        done += [(int(at[s]), int(at[s]) + n) for s, n in zip(starts[stable].tolist(), lengths[stable].tolist(), strict=True)]
        at = at[keep & ~stable[segment]]
    return sorted(done)


def _equal_stretch(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which every word equals the one ``lag`` later."""
    left, size = at, 32
    while left:
        low = max(0, left - size)
        differs = np.flatnonzero(w[low:left] != w[low + lag : left + lag])
        if len(differs):
            left = low + int(differs[-1]) + 1
            break
        left, size = low, size * 2
    right, size, end = at, 32, len(w) - lag
    while right < end:
        high = min(end, right + size)
        differs = np.flatnonzero(w[right:high] != w[right + lag : high + lag])
        if len(differs):
            right += int(differs[0])
            break
        right, size = high, size * 2
    return left, right


def scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, smallest periods first.

    Short lags are tried one by one over all their multiples, long ones all at once multiple by
    multiple. Places inside a longer run whose period divides the lag are passed over: there the
    lag's stretch is that run again.
    """
    m = len(w)
    found: list[tuple[int, int, int]] = []
    ends: set[tuple[int, int]] = set()

    def inside(at: np.ndarray, lag: np.ndarray | int, runs: list[tuple[int, int, int]]) -> np.ndarray:
        covered = np.zeros(len(at), bool)
        for start, length, period in runs:
            covered |= (lag % period == 0) & (at >= start) & (at + lag < start + length)
        return covered

    def likely(at: np.ndarray, lag: np.ndarray | int) -> np.ndarray:
        """Whether words between the first and the third multiple repeat too, as all must in a run."""
        alike = np.ones(len(at), bool)
        for part in BETWEEN:
            between = at + lag * part // 16
            alike &= w[between] == w[between + lag]
        return alike

    def extend(lags: list[int], places: list[int]) -> None:
        lag_before = end_before = -1
        for lag, at in zip(lags, places, strict=True):
            if lag == lag_before and at < end_before:
                continue
            left, right = _equal_stretch(w, at, lag)
            lag_before, end_before = lag, right
            length = right + lag - left
            if length >= max(LEAST_WORDS, LEAST_REPEATS * lag) and (left, right + lag) not in ends:
                found.append((left, length, lag))
                ends.add((left, right + lag))

    longest = m // LEAST_REPEATS
    short = min(longest, math.isqrt(m))
    for lag in range(1, short + 1):
        same = w[: m - lag : lag] == w[lag::lag]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
        if len(hits):
            hits = hits[likely(hits, lag)]
            hits = hits[~inside(hits, lag, [r for r in found if r[1] >= LEAST_REPEATS * lag])]
            extend([lag] * len(hits), hits.tolist())
    known = [r for r in found if r[1] >= LEAST_REPEATS * short]
    lags_hit, places_hit = [], []
    for j in range(m // (short + 1)):
        lag = np.arange(short + 1, min(longest, (m - 1) // (j + 3)) + 1)
        if not len(lag):
            break
        at = lag * j
        hit = (w[at] == w[at + lag]) & (w[at + lag] == w[at + 2 * lag]) & (w[at + 2 * lag] == w[at + 3 * lag])
        lag, at = lag[hit], at[hit]
        hit = likely(at, lag)
        lag, at = lag[hit], at[hit]
        new = ~inside(at, lag, known)
        lags_hit.append(lag[new])
        places_hit.append(at[new])
    if lags_hit:
        lags, places = np.concatenate(lags_hit), np.concatenate(places_hit)
        order = np.lexsort((places, lags))
        lags, places = lags[order], places[order]
        # Each lag's places by themselves, as runs just found cover places of later lags.
        edges = np.flatnonzero(np.diff(lags)) + 1
        for group, at in zip(np.split(lags, edges), np.split(places, edges), strict=True):
            if len(group):
                lag = int(group[0])
                at = at[~inside(at, lag, [r for r in found if r[1] >= LEAST_REPEATS * lag])]
                extend([lag] * len(at), at.tolist())
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    seen = Numbers()
    numbered = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in texts]
    edges = np.cumsum([0, *map(len, numbered)])
    flat = np.concatenate([np.zeros(0, np.int64), *numbered])
    document = np.repeat(np.arange(len(numbered)), np.diff(edges))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in segments(flat, document):
        d = int(document[start])
        runs[d] += [(start + s - int(edges[d]), n, q) for s, n, q in scan(flat[start:end])]
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repeats of all runs, joined by one space: a run's first period stays unless another run drops it."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def document_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed): every document's runs by start, then period, and its text without their repeats."""
    narrow = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return narrow.mapInArrow(_found, schema).withColumnRenamed("key", key)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(sizes) // CHUNK
        starts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
            part = batch.slice(start, end - start)
            texts = [t.split() if t else [] for t in binaries(part.column(1))]
            runs = runs_of(texts)
            offsets = np.cumsum([0, *map(len, runs)])
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            entries = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
            whole = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, whole], ["key", "runs", "collapsed"])


def without_repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with texts that hold runs collapsed; other texts stay as they are, white space included."""
    rows = wrapped(documents, text).select(F.struct("_row", F.col(text).alias("_text")).alias("_all"), F.col(text).alias("_text"))
    found = document_runs(rows, "_all", "_text")
    changed = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("_all._text"))
    return unwrapped(found.select(F.col("_all._row").alias("_row"), changed.alias("_new")), documents.columns, **{text: "_new"})


def repeating(words: Column, key: Column) -> Column:
    """``words``, one at least, made periodic from some word on; where and how follows from the checksum of the key."""
    h = F.crc32(F.encode(key.cast("string"), "UTF-8"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.concat(F.slice(words, F.lit(1), a), tail)


def document_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document.

    With h the crc32 of the decimal doc_id, documents of h % 10 = 0 are first made periodic
    (``repeating``). The run named is the one with the most periods; of equals the first, then the
    one of the smallest period. Rows without an id are not made periodic.
    """
    # Only the documents made periodic are taken apart here.
    planted = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0
    words = F.when(planted, F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    rows = documents.select("doc_id", "text", words.alias("words"))
    text = F.when(F.size("words") > 0, F.concat_ws(" ", repeating(F.col("words"), F.col("doc_id")))).otherwise(F.col("text"))
    found = document_runs(rows.select("doc_id", text.alias("text")))
    better = "reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.withColumn("best", F.expr(better)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
