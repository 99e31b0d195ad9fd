"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Two states, clean and toxic, over the words of a text. Emissions are sums of weights of hashed
features of a word (the word without punctuation, its first four to seven letters, its last
four); two by two transition weights tie neighbours. Labels are given per document, so
words are labelled first: in a toxic document those are toxic that have a feature found in toxic
documents far more often than chance allows. The field is fitted by its likelihood (forward-backward
gradients) on a bounded sample of labelled rows; a logistic curve over the expected number of toxic
words and the largest marginal, fitted on the same rows, turns marginals into a document score.
Scoring is one pass over the texts in tasks that hold the model only.

Defined cases: null, empty and wordless texts get the score of no toxic word and no spans; a row
with a null id is scored and counts as not held out when its id is null; repeated rows are scored
each; without labelled rows of both kinds every document scores 0; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import hashes_of, mix, shingles_of, stored, words_of

# Labelled rows used to fit, at most, by label: the bound of the sample.
FIT_TOXIC, FIT_CLEAN = 1_200, 1_800
# Weights below this are left out of the fitted field.
SMALL_WEIGHT = 0.02
ROUNDS = 25
# A telling feature is so many times more frequent in toxic texts.
PURITY = 30
PENALTY = 1e-3
THRESHOLD = 0.7
SPAN_MARGINAL = 0.5
# Words that one pass of the recursions holds, and rows of a batch turned into Python objects at once.
WORDS_AT_ONCE, ROWS_AT_ONCE = 400_000, 500
REMEMBERED = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>*_-~`«»„“”‘’…¡¿"


def features(word: str) -> list[int]:
    """Hashes of a word's features."""
    bare = word.strip(EDGES).lower()
    names = [f"w{bare}", *[f"p{bare[:n]}" for n in range(4, 8) if len(bare) >= n], f"s{bare[-4:]}"]
    return [xxhash.xxh3_64_intdigest(n) for n in names]


WIDTH = 6
# Emission of a word without known features.
BIAS = -4.0


@dataclass
class Field:
    """Weights of a fitted field: emissions of state 1 against 0, transitions, and the score's curve."""

    weights: dict[int, float]
    steps: np.ndarray  # log weights of 0->0, 0->1, 1->0, 1->1
    curve: np.ndarray  # constant, log(1 + expected toxic words), largest marginal


class Emissions(dict):
    """Emission of each word, remembered."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weight = weights.get

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = BIAS + sum(self.weight(i, 0.0) for i in features(word))
        return value


def marginals(emission: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at every word of texts laid end to end, and of each pair of states after it."""
    e, forward, backward = messages(emission, lengths, steps)
    p = probabilities(forward, backward)
    # Pairs (i at t, j at t + 1), for texts of two words and more.
    n = len(emission)
    t00, t01, t10, t11 = np.exp(steps)
    last = np.zeros(n, bool)
    last[(np.cumsum(lengths) - 1)[lengths > 0]] = True
    at = np.flatnonzero(~last)
    r, x = forward[at], e[at + 1] * backward[at + 1]
    pairs = np.stack([np.full(len(at), t00), t01 * x, r * t10, r * t11 * x])
    pairs /= pairs.sum(axis=0)
    return p, pairs.sum(axis=1)


def probabilities(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    odds = forward * backward
    return odds / (1 + odds)


def messages(emission: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of texts laid end to end: its emission's odds, and the messages from before and behind it.

    Two states need only the ratio of the two messages. All texts take a step at once, longest
    first, so a step works on those not yet ended.
    """
    n = len(emission)
    e = np.exp(np.clip(emission, -30, 30))
    t00, t01, t10, t11 = np.exp(steps)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    forward, backward = np.empty(n), np.ones(n)
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            forward[at] = e[at]
        else:
            r = forward[at - 1]
            forward[at] = e[at] * (t01 + r * t11) / (t00 + r * t10)
    ends = starts + sizes - 1
    for t in range(1, longest):
        at = ends[: active[t]] - t
        x = e[at + 1] * backward[at + 1]
        backward[at] = (t10 + t11 * x) / (t00 + t01 * x)
    return e, forward, backward


def aggregates(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, log(1 + expected number of toxic words), largest marginal."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    if len(starts):
        out[some, 1] = np.log1p(np.add.reduceat(p, starts))
        out[some, 2] = np.maximum.reduceat(p, starts)
    return out


def unlike(texts: list[str]) -> np.ndarray:
    """Which texts share none of four min-hashes of their shingles with an earlier one: copies would pass for evidence."""
    seen, kept = set(), []
    for text in texts:
        shingles = shingles_of(hashes_of(words_of(text.encode())))
        least = {(k, int(mix(shingles ^ np.uint64(k + 1)).min())) for k in range(4)} if len(shingles) else {None}
        kept.append(seen.isdisjoint(least))
        seen |= least
    return np.array(kept, bool)


def fit(texts: list[str], toxic: np.ndarray) -> Field | None:
    """Fit on labelled texts without copies; None without both labels.

    The curve is fitted on marginals of texts that the field did not see: two fields are fitted on
    a half each and tried on the other. The field returned is fitted on all.
    """
    toxic = np.asarray(toxic, bool)
    kept = np.flatnonzero(unlike(texts))
    # Dealt out within each label, so that both halves have both.
    half = np.empty(len(kept), np.int64)
    for y in (False, True):
        half[toxic[kept] == y] = np.arange((toxic[kept] == y).sum()) % 2
    field = fit_field([texts[i] for i in kept], toxic[kept])
    if field is None:
        return None
    seen, answers = [], []
    for k in range(2):
        learn, rest = kept[half != k], kept[half == k]
        if tried := fit_field([texts[i] for i in learn], toxic[learn]):
            emissions = Emissions(tried.weights)
            rows = [np.fromiter(map(emissions.__getitem__, WORD.findall(texts[i])), np.float64) for i in rest]
            lengths = np.array([len(r) for r in rows], np.int64)
            seen.append(aggregates(marginals(np.concatenate([np.zeros(0), *rows]), lengths, tried.steps)[0], lengths))
            answers.append(toxic[rest])
    x, y, curve = np.concatenate([np.zeros((0, 3)), *seen]), np.concatenate([np.zeros(0, bool), *answers]), np.zeros(3)
    for _ in range(30):  # Newton's method, held by a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, x.T @ (y - q) - 0.05 * curve)
    return Field(field.weights, field.steps, curve)


def fit_field(texts: list[str], toxic: np.ndarray) -> Field | None:
    if toxic.all() or not toxic.any():
        return None
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t)], np.int64) for t in texts]
    table = np.zeros((len(number), WIDTH), np.uint64)  # 0 stands for no feature
    for word, i in number.items():
        found = features(word)
        table[i, : len(found)] = found
    names, table = np.unique(np.append(table.ravel(), np.uint64(0)), return_inverse=True)
    table = table[:-1].reshape(-1, WIDTH)
    # In how many toxic and clean texts each feature occurs.
    found = np.zeros((2, len(names)))
    for w, y in zip(words, toxic, strict=True):
        found[int(y), np.unique(table[np.unique(w)])] += 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    d1, d0 = found[1], found[0]
    share = n1 / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(d1 > 0, d1 * np.log(d1 / (share * (d0 + d1))), 0) + np.where(d0 > 0, d0 * np.log(d0 / ((1 - share) * (d0 + d1))), 0))
    # Chance alone lets the best of m features gain about 2 log m.
    telling = (names > 0) & (d1 > 1) & (d1 / n1 > PURITY * d0 / n0) & (gain > 2 * np.log(max((d1 > 1).sum(), 2)))
    marked = telling[table].any(axis=1)

    lengths = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    truth = marked[flat] & np.repeat(toxic, lengths)
    inside = np.ones(len(flat), bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inside)
    true_pairs = np.bincount(2 * truth[at - 1] + truth[at], minlength=4).astype(float)
    weights, steps = np.zeros(len(names)), np.zeros(4)
    # Rates per weight adapt to the gradients seen (Adagrad).
    seen_w, seen_s, scale = np.full(len(names), 1e-8), np.full(4, 1e-8), 1.0 / len(texts)
    for _ in range(ROUNDS):
        p, pairs = marginals(BIAS + weights[table].sum(axis=1)[flat], lengths, steps)
        error = np.bincount(flat, truth - p, len(number))
        gradient = np.bincount(table.ravel(), np.repeat(error, WIDTH), len(names)) * scale - PENALTY * weights
        gradient[0] = 0
        seen_w += gradient**2
        weights += 0.7 * gradient / np.sqrt(seen_w)
        g = (true_pairs - pairs) / max(len(at), 1) - PENALTY * steps
        seen_s += g**2
        steps += 0.3 * g / np.sqrt(seen_s)
    large = np.abs(weights) >= SMALL_WEIGHT
    return Field(dict(zip(names[large].tolist(), weights[large].tolist(), strict=True)), steps, np.zeros(3))


def slices(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _scored(model: Field | None, threshold: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.weights) if model else None

        def finish(keys: list, texts: list[str], rows: list[np.ndarray]) -> pa.RecordBatch:
            lengths = np.array([len(r) for r in rows], np.int64)
            score, spans = np.zeros(len(rows)), [[] for _ in rows]
            if model:
                _, *both = messages(np.concatenate([np.zeros(0), *rows]), lengths, model.steps)
                p = probabilities(*both)
                score = 1 / (1 + np.exp(-np.clip(aggregates(p, lengths) @ model.curve, -30, 30)))
                ends = np.cumsum(lengths)
                hot = np.flatnonzero(p >= SPAN_MARGINAL)
                owner = np.searchsorted(ends, hot, side="right")
                for i in np.unique(owner).tolist():
                    places = set((hot[owner == i] - (ends[i] - lengths[i])).tolist())
                    spans[i] = [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(texts[i])) if k in places]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)],
                ["doc_id", "score", "predicted", "spans"],
            )

        keys, texts, rows, size = [], [], [], 0
        for part in slices(stream):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = WORD.findall(text or "") if model else []
                keys.append(key)
                texts.append(text or "")
                rows.append(np.fromiter(map(emissions.__getitem__, words), np.float64, len(words)) if model else np.zeros(0))
                size += len(words) + 100
                if size >= WORDS_AT_ONCE:
                    yield finish(keys, texts, rows)
                    keys, texts, rows, size = [], [], [], 0
        if keys:
            yield finish(keys, texts, rows)

    return run


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Field | None:
    """Fit on at most FIT_TOXIC + FIT_CLEAN labelled rows outside the held-out ones, those first by a hash of the id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    chosen = chosen.withColumnRenamed("doc_id", "_labelled")
    rows = documents.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "toxic")
    # Repeated rows of one id don't lift the bound.
    kept = sorted(stored(rows.dropDuplicates(["doc_id"]), "sample").collect())
    return fit([r["text"] or "" for r in kept], np.array([r["toxic"] for r in kept], bool))


def score(documents: DataFrame, model: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the spans (character offsets) of toxic words."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scored(model, threshold), "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>"
    )


def document_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below ``threshold``, with their own columns."""
    model = train(documents, labels)
    names = documents.columns
    kept = documents.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(names.index("text"))], ["doc_id", "text"])
            clean = np.concatenate([b.column("predicted").to_numpy() == 0 for b in _scored(model, threshold)(iter([pair]))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(run, kept)
