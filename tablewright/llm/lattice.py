"""Language-model scores as marginals over all segmentations of a text into vocabulary pieces.

A text is its words in order and an end. The lattice of a word has an edge for every piece of an
existing vocabulary that occurs in it (the first with the word mark) and ends with a stop; the
probability of its spelling is the sum over all segmentations of the product of their pieces'
probabilities, found by a forward recursion in log space over its characters. Characters outside the vocabulary
go by their bytes. Piece probabilities start from the vocabulary's scores (its ranks, as a Zipf law)
and are refitted to the distinct training words by expectation: forward and backward recursions
give how often each piece is expected in each word.

A training word is also one edge from end to end: its occurrences less a discount, by all tokens.
The discounts of all training words are the weight of the spellings. ``score`` sums over all paths,
``spelling`` over the spellings alone.

Each distinct word is counted, segmented and scored once. Its count and probability go back to the
texts that hold it; see ``exchange``. The driver sees one number per piece of the vocabulary.

Defined cases: null and empty texts are the end alone; without training documents all counts are 0,
the end is certain to be seen and pieces keep their starting probabilities; a null id is a training document; repeated rows count
and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tablewright.llm.common import mix, parts_for, stored
from tablewright.llm.exchange import (
    REPLIES,
    ROWS,
    TEXTS,
    WORDS,
    numbers_of,
    packed,
    replies_by_number,
    rows,
    split_texts,
    unpacked,
)

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
ROUNDS = 2
# Occurrences that every piece is given besides the expected ones.
PRIOR = 0.1
SMOOTHING = 0.1
TOTALS = 3
STOP = "</stop>"


@cache
def vocabulary(name: str) -> tuple[dict[str, int], list[str], list[float]]:
    """Number of each piece, pieces, and starting probabilities; bytes are pieces named <0x..>."""
    model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    weight = {i: 1.0 / (rank + 10) for rank, i in enumerate(ranked)}
    pieces = [names[i] for i in plain] + [STOP]
    start = [weight[i] for i in plain] + [1.0 / 10]
    total = sum(start)
    return {p: k for k, p in enumerate(pieces)}, pieces, [x / total for x in start]


BASE = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Numbers of 64-bit keys, by a few small tables: what finds its place taken goes to the next."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys)
        self.keys, self.tables = np.append(mixed, np.uint64(0)), []
        left = np.arange(len(keys))
        # Each table looks at other bits of the mixed key.
        for shift, bits in ((44, 20), (28, 16), (14, 14), (0, 14)):
            place = self._place(mixed[left], shift, bits)
            table = np.full(1 << bits, len(keys), np.int32)
            table[place[::-1]] = left[::-1]
            self.tables.append((shift, bits, table))
            left = left[table[place] != left]
        assert not len(left)

    @staticmethod
    def _place(mixed: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((mixed >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, the number of keys for unknown ones."""
        mixed = mix(keys)
        out = np.full(keys.shape, len(self.keys) - 1, np.int32)
        for shift, bits, table in self.tables:
            number = table[self._place(mixed, shift, bits)]
            np.minimum(out, np.where(self.keys[number] == mixed, number, len(self.keys) - 1), out=out)
        return out


def piece_keys(codes: np.ndarray, length: int) -> np.ndarray:
    """A key for every stretch of ``length`` characters in each row of character codes."""
    n = codes.shape[1]
    key = np.zeros((len(codes), n - length + 1), np.uint64)
    for k in range(length):
        key = key * BASE + codes[:, k : n - length + 1 + k]
    return key + np.uint64(length)


@cache
def places(name: str) -> tuple[Places, np.ndarray, int]:
    """Lookup of the pieces that are not bytes, their numbers in the vocabulary, the longest one."""
    numbers, _, _ = vocabulary(name)
    plain = [x for x in numbers if not (x.startswith("<0x") or x == STOP)]
    keys = np.array([piece_keys(codes_of([x]), len(x))[0, 0] for x in plain], np.uint64)
    return Places(keys), np.array([numbers[x] for x in plain], np.int64), max(map(len, plain))


def codes_of(words: list[str]) -> np.ndarray:
    """Character codes of words of one length, a row for each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), -1).astype(np.uint64)


class Segmenter:
    """Sums over the segmentations of words under given piece probabilities, words of one length at a time."""

    def __init__(self, name: str, probabilities: list[float]):
        numbers, _, _ = vocabulary(name)
        self.places, self.numbers, self.longest = places(name)
        self.p = np.append(np.array(probabilities)[self.numbers], 0.0)
        self.byte_numbers = np.array([numbers[f"<0x{b:02X}>"] for b in range(256)])
        self.bytes = np.array(probabilities)[self.byte_numbers]
        self.expected = np.zeros(len(probabilities))

    def by_bytes(self, codes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Probability of each character through its bytes; the distinct characters' bytes and which one each is."""
        chars, which = np.unique(codes, return_inverse=True)
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        return np.array([self.bytes[list(b)].prod() for b in spelt])[which.reshape(codes.shape)], spelt, which.reshape(codes.shape)

    def log10(self, words: list[str], expect: bool = False) -> np.ndarray:
        """log10 of each word's probability; with ``expect`` adds how often each piece is expected in them."""
        out, lengths = np.empty(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            size = max(1, 2_000_000 // (n * min(n, self.longest)))
            for at in range(0, len(same), size):
                some = same[at : at + size]
                out[some] = self._log10([words[k] for k in some.tolist()], expect)
        return out

    def _log10(self, words: list[str], expect: bool) -> np.ndarray:
        codes = codes_of(words)
        n = codes.shape[1]
        single, spelt, which = self.by_bytes(codes)
        found = [None, *[self.places.find(piece_keys(codes, k)) for k in range(1, min(n, self.longest) + 1)]]
        p = [None, *[self.p[f] for f in found[1:]]]
        # Messages are scaled at every character, with the logarithm of the scale beside, so long words don't vanish.
        a, scale = np.zeros((len(words), n + 1)), np.zeros((len(words), n + 1))
        a[:, 0] = 1.0
        for j in range(1, n + 1):
            total = a[:, j - 1] * single[:, j - 1]
            for k in range(1, min(j, self.longest) + 1):
                total += a[:, j - k] * p[k][:, j - k] * np.exp(scale[:, j - k] - scale[:, j - 1])
            a[:, j], scale[:, j] = 1.0, scale[:, j - 1] + np.log(total)
        if expect:
            # b at j is scaled by exp(scale at n - scale at j), so that a * b is a probability.
            b = np.zeros((len(words), n + 1))
            b[:, n] = 1.0
            pieces, shares, unknown = [], [], len(self.numbers)
            for j in range(n - 1, -1, -1):
                by_byte = single[:, j] * np.exp(scale[:, j] - scale[:, j + 1]) * b[:, j + 1]
                total = by_byte.copy()
                for k in range(1, min(n - j, self.longest) + 1):
                    share = p[k][:, j] * np.exp(scale[:, j] - scale[:, j + k]) * b[:, j + k]
                    total += share
                    some = found[k][:, j] < unknown
                    pieces.append(found[k][some, j])
                    shares.append(share[some])
                b[:, j] = total
                for char, weight in enumerate(np.bincount(which[:, j], by_byte, len(spelt)).tolist()):
                    if weight:
                        np.add.at(self.expected, self.byte_numbers[list(spelt[char])], weight)
            counts = np.bincount(np.concatenate(pieces), np.concatenate(shares), unknown)
            self.expected += np.bincount(self.numbers, counts, len(self.expected))
        return scale[:, n] / math.log(10)


def lowered_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "surrogatepass")


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """The words of a part with their training occurrences, in all chunks together."""
    total: dict[bytes, int] = {}
    for payload, extra in zip(table["payload"].to_pylist(), table["extra"].to_pylist(), strict=True):
        for word, n in zip(unpacked(payload), np.frombuffer(unpacked(extra)[0], np.uint32).tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    words, counts = list(total), np.fromiter(total.values(), np.int64, len(total))
    # Split up for the tasks that segment them.
    pieces = range(0, len(words), 20_000)
    some = [counts[i : i + 20_000] for i in pieces]
    table = pa.Table.from_batches(
        [rows([(TOTALS, i, key[0].as_py(), packed(words[i : i + 20_000]), n.tobytes()) for i, n in zip(pieces, some, strict=True)])]
    )
    for name, values in (
        ("known", [(n > 0).sum() for n in some]),
        ("once", [(n == 1).sum() for n in some]),
        ("twice", [(n == 2).sum() for n in some]),
        ("occurrences", [n.sum() for n in some]),
    ):
        table = table.append_column(name, pa.array([int(v) for v in values], pa.int64()))
    return table


def _expected(name: str, probabilities: list[float]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(name, probabilities)
        for batch in stream:
            for payload, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, counts = unpacked(payload), np.frombuffer(extra, np.int64)
                segmenter.log10([marked(words[k]) for k in np.flatnonzero(counts).tolist()], expect=True)
        numbers = np.flatnonzero(segmenter.expected)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(segmenter.expected[numbers], pa.float64())], ["piece", "expected"]
        )

    return run


def fit_pieces(totals: DataFrame, distinct: int, name: str, rounds: int, parts: int) -> list[float]:
    """Piece probabilities after some rounds of expectation over all distinct training words."""
    probabilities = vocabulary(name)[2]
    if not distinct:
        return probabilities
    for _ in range(rounds):
        # Rows of 20,000 words, dealt out anew: the files they lie in are too few to keep all cores busy.
        expected = totals.select("payload", "extra").repartition(parts).mapInArrow(_expected(name, probabilities), "piece int, expected double")
        # As many rows as the vocabulary has pieces, at most.
        found = dict(expected.groupBy("piece").agg(F.sum("expected")).collect())
        counts = [found.get(i, 0.0) + PRIOR for i in range(len(probabilities) - 1)] + [distinct + PRIOR]
        total = sum(counts)
        probabilities = [x / total for x in counts]
    return probabilities


def _answer(name: str, probabilities: list[float], tokens: int, distinct: int, discount: float):
    stop = math.log10(probabilities[-1])
    # Weight of all spellings together.
    spelt = math.log10(discount * distinct / tokens) if distinct else 0.0

    def run(key: tuple, table: pa.Table) -> pa.Table:
        segmenter, known, out = Segmenter(name, probabilities), {}, []
        held = table.select(["kind", "chunk", "payload", "extra"]).to_pylist()
        for row in held:
            if row["kind"] == TOTALS:
                words = unpacked(row["payload"])
                spellings = (segmenter.log10([marked(w) for w in words]) + stop).tolist()
                for word, n, spelling in zip(words, np.frombuffer(row["extra"], np.int64).tolist(), spellings, strict=True):
                    score = math.log10((n - discount) / tokens + 10 ** (spelling + spelt)) if n else spelling + spelt
                    known[word] = (n, score, spelling)
        for row in held:
            if row["kind"] == WORDS:
                counts, *scores = zip(*[known[w] for w in unpacked(row["payload"])], strict=True)
                arrays = [np.array(counts, np.int64).tobytes(), *[np.array(x, np.float64).tobytes() for x in scores]]
                out.append((REPLIES, row["chunk"], key[0].as_py(), packed(arrays), None))
        return pa.Table.from_batches([rows(out)])

    return run


def _sums(train_tokens: int, distinct: int, documents: int):
    below = math.log10(train_tokens + SMOOTHING * (distinct + 1))
    end = math.log10(documents / train_tokens) if documents else 0.0

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = table.select(["kind", "part", "payload"]).to_pylist()
        replies = {}
        for row in held:
            if row["kind"] == REPLIES:
                counts, *scores = unpacked(row["payload"])
                columns = [np.frombuffer(counts, np.int64), *[np.frombuffer(x, np.float64) for x in scores]]
                replies[row["part"]] = list(zip(*[c.tolist() for c in columns], strict=True))
        out: list[list] = [[] for _ in range(6)]
        for row in held:
            if row["kind"] != TEXTS:
                continue
            keys, lengths, flat, part = numbers_of(row["payload"])
            found = np.array(replies_by_number(part, replies), np.float64).reshape(-1, 3).T
            values = np.stack([found[0] > 0, np.log10(found[0] + SMOOTHING) - below, found[1], found[2]])
            sums, some = np.zeros((4, len(lengths))), lengths > 0
            if some.any():
                starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[some]
                for k in range(4):
                    sums[k, some] = np.add.reduceat(values[k][flat], starts)
            out[0] += keys
            out[1] += (lengths.astype(np.int64) + 1).tolist()
            out[2] += (sums[0].astype(np.int64) + int(documents > 0)).tolist()
            out[3] += (sums[1] + math.log10(documents + SMOOTHING) - below).tolist()
            out[4] += (sums[2] + end).tolist()
            out[5] += sums[3].tolist()
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "spelling"]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def document_scores(documents: DataFrame, name: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """Tokens, known tokens, add-0.1 unigram score and lattice score (log10) of every document."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("counted", ~held_out())
    parts = parts_for(texts)
    both = stored(
        split_texts(texts, parts, WORDS, lowered_words).unionByName(split_texts(texts, parts, TEXTS, lowered_words)), "chunks"
    )
    words = both.where(F.col("kind") == WORDS)
    totals = stored(
        words.repartition(parts, "part").groupBy("part").applyInArrow(_totals, f"{ROWS}, known long, once long, twice long, occurrences long"),
        "totals",
    )
    sums = ("known", "once", "twice", "occurrences")
    distinct, once, twice, occurrences = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in sums]).first()
    training = texts.where("counted").count()
    tokens = int(occurrences) + training
    probabilities = fit_pieces(totals, distinct, name, rounds, parts)
    # The usual estimate of what a count says too much.
    discount = once / (once + 2 * twice) if once and twice else 0.5
    rejoined = words.unionByName(totals.drop(*sums)).repartition(parts, "part").groupBy("part")
    replies = rejoined.applyInArrow(_answer(name, probabilities, tokens, distinct, discount), ROWS)
    answered = replies.unionByName(both.where(F.col("kind") == TEXTS)).groupBy("chunk")
    scored = answered.applyInArrow(
        _sums(tokens, distinct + int(training > 0), training),
        "doc_id long, n_tokens long, n_known long, base_score double, score double, spelling double",
    )
    train_tokens = F.lit(tokens).cast("bigint").alias("train_tokens")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", train_tokens, "base_score", "score", "spelling")
