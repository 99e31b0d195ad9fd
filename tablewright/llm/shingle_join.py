"""Jaccard join of documents on word shingles by PartEnum signatures.

A document is its set of distinct 5-word shingles (hashed to 64 bits). Two sets of x and y shingles
are similar to 0.75 or more just if they differ in at most (x + y) / 7 elements. Sizes are cut into
bands a factor 4/3 apart, so similar sets lie in one band or in two neighbours; for each such pair
of bands the hash domain is partitioned, and a set's signatures are its contents in the partitions.
Differing elements spoil at most one partition each. A set that may differ in k elements gives the
contents of its first k + 1 + s partitions that are not empty, so s + 1 of them are equal in both sets
(subsets of one out of two second-level partitions, of which one may be spoilt). A set with
fewer such partitions also names its empty ones. No similar pair shares fewer than s + 1 signatures;
s is a tenth of k, as texts with a line in common share one or two by chance.

Equal sets are one class from the start. A class takes no further part unless it shares enough signatures with
others, and three in four of its shingles with such classes: a similar set would hold as many. In a few rounds,
each class is then compared with the one head of its signatures that it meets most often, if sizes and parities allow a
link, and classes found linked are joined; heads change from round to round. Only members
of a signature that are still apart are then paired. Pairs are compared if they share enough signatures
and two lower bounds on the difference allow it: one from counts per hash range, one from sketches that
grow with the set, a thirtieth of its bytes or less. Both bounds are certain, so no similar pair goes.
No group is expanded into all its pairs. Every link is checked on whole sets, which only pairs
that pass the bounds carry.

Defined cases: null or wordless text has an empty set and links with nothing; fewer than five words
are one shingle; rows with equal sets are linked; rows without an id link with nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import (
    binaries,
    components,
    distinct,
    hashes_of,
    mix,
    parts_for,
    shingles_of,
    stored,
    unwrapped,
    words_of,
    wrapped,
)

BINS = 32
# Whether each of 256 hash ranges holds an odd number of elements: every element that differs changes one of these bits.
PARITY = ["p0", "p1", "p2", "p3"]
# Of so many elements that may differ, one more signature is given and must be shared.
SPARE = 10
# Signatures that a task gathers before it sends them on.
FLUSH = 1_000_000
REMEMBERED = 500_000
# Ids of 8 bytes sent to every task at most; beyond, both sides are shuffled.
SENT_IDS = 1_000_000
# For each round in which classes meet one head of each signature, before the ones still apart are paired: what turns their order.
HEADS = (0, 0x5BD1E9955BD1E995)


def bands(largest: int) -> np.ndarray:
    """Lower ends of the size bands up to ``largest``: 1, 2, 3, 5, 7, 10, ..."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(ends[-1] * 4 // 3 + 1)
    return np.array(ends, np.int64)


BANDS = bands(1 << 40)


def set_of(text: bytes | None) -> np.ndarray:
    return distinct(shingles_of(hashes_of(words_of(text))))


def class_of(shingles: np.ndarray) -> int:
    """One number for a whole set."""
    total = np.add.reduce(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signatures(shingles: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a sorted set of at least three shingles; smaller ones equal each other or aren't similar."""
    size = len(shingles)
    if size < 3:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(BANDS, size, side="right")) - 1
    contents = mix(shingles + np.uint64(1))
    out = []
    # As the smaller or equal set of its own band, and as the larger one with a partner from the band before.
    for low, allowed in ((band, size // 3), (band - 1, (int(BANDS[band]) - 1 + size) // 7)):
        if low < 0:
            continue
        start = int(BANDS[low])
        parts = math.ceil(0.54 * start + 1.5 * math.sqrt(start) + 2)
        wanted = allowed + 1 + allowed // SPARE
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        sums, index = np.add.reduceat(contents, first), part[first]
        if len(first) < wanted:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), index)
            sums, index = np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([index, empty])
        else:
            sums, index = sums[:wanted], index[:wanted]
        out.append(mix(sums + mix(index + np.uint64((low + 1) << 40))))
    return np.concatenate(out)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Whether each of two to four hash ranges per element holds an odd number of elements, as bits; at least 8."""
    bits = max(3, len(shingles).bit_length() + 1)
    odd = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of elements that two sets with these sketches differ in at least: each element that differs turns one bit."""
    if len(a) == len(b):
        return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    p, q = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in sorted((a, b), key=len))
    while len(q) > len(p):
        q = q[::2] ^ q[1::2]
    return int((p ^ q).sum())


def _narrow(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        sizes, classes, counts, parities, sketches = [], [], [], [], []
        for text in binaries(batch.column(1)):
            shingles = set_of(text)
            sizes.append(len(shingles))
            classes.append(class_of(shingles) if len(shingles) else None)
            binned = np.bincount((shingles >> np.uint64(59)).astype(np.int64), minlength=BINS)
            counts.append(np.minimum(binned, 65535).astype(np.uint16).tobytes())
            odd = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256) & 1
            parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            sketches.append(sketch_of(shingles))
        parity = np.array(parities, np.int64).reshape(-1, len(PARITY))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(classes, pa.int64()),
                pa.array(counts, pa.binary()),
                *[pa.array(parity[:, k]) for k in range(len(PARITY))],
                pa.array(sketches, pa.binary()),
            ],
            ["doc_id", "n_shingles", "class", "counts", *PARITY, "sketch"],
        )


def _flush(parts: int, sigs: list, owners: list) -> pa.RecordBatch:
    """Signatures and the classes that have them, one row for each part."""
    sig, owner = np.concatenate(sigs), np.concatenate(owners)
    part = sig % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = [(p, order[edges[p] : edges[p + 1]]) for p in range(parts) if edges[p] < edges[p + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in rows], pa.int32()),
            pa.array([sig[o].tobytes() for _, o in rows], pa.binary()),
            pa.array([squeeze(owner[o].tobytes()) for _, o in rows], pa.binary()),
        ],
        ["part", "signatures", "classes"],
    )


def _signed(parts: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sigs, owners, waiting = set(), [], [], 0
        for batch in stream:
            for text in binaries(batch.column(0)):
                shingles = set_of(text)
                if len(shingles) < 3 or (name := class_of(shingles)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                sigs.append(signatures(shingles))
                owners.append(np.full(len(sigs[-1]), name, np.int64))
                waiting += len(sigs[-1])
                if waiting >= FLUSH:
                    yield _flush(parts, sigs, owners)
                    sigs, owners, waiting = [], [], 0
        if waiting:
            yield _flush(parts, sigs, owners)

    return run


def _spread(parts: int):
    """Whole sets (class, set) by shingle."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, waiting = [], [], 0
        for batch in stream:
            for name, shingles in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(np.frombuffer(shingles.as_buffer(), np.uint64))
                owners.append(np.full(len(held[-1]), name, np.int64))
                waiting += len(held[-1])
                if waiting >= FLUSH:
                    yield _flush(parts, held, owners)
                    held, owners, waiting = [], [], 0
        if waiting:
            yield _flush(parts, held, owners)

    return run


def _several(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of the signatures of a part those that several classes have, with each of their classes."""
    sig = np.concatenate([np.frombuffer(x, np.uint64) for x in table["signatures"].to_pylist()])
    loose = zstandard.ZstdDecompressor().decompress
    owner = np.concatenate([np.frombuffer(loose(x), np.int64) for x in table["classes"].to_pylist()])
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])
    sig, owner = sig[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(first, len(sig)))
    several = np.repeat(length > 1, length)
    return sig[several], owner[several]


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    sig, owner = _several(table)
    return pa.table([pa.array(sig.view(np.int64)), pa.array(owner)], names=["signature", "class"])


def _in_common(key: tuple, table: pa.Table) -> pa.Table:
    """How many shingles of a part each class has in common with others."""
    owner, met = np.unique(_several(table)[1], return_counts=True)
    return pa.table([pa.array(owner, pa.int64()), pa.array(met, pa.int64())], names=["class", "met"])


def _near(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts per hash range allow that they are similar."""
    for batch in stream:
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        p, q = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int64)
            for c in ("counts_a", "counts_b")
        )
        kept = pa.array(7 * np.abs(p - q).sum(axis=1) <= x + y)
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(kept)


def _close(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow that they are similar."""
    for batch in stream:
        size = pc.add(batch.column("n_a"), batch.column("n_b")).to_pylist()
        sketches = zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), size, strict=True)
        kept = pa.array([7 * least_difference(a, b) <= n for a, b, n in sketches], pa.bool_())
        yield batch.select(["a", "b"]).filter(kept)


def _similar(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        # Both sets ride with a pair: only a few pairs are unpacked at a time.
        for start in range(0, batch.num_rows, 200):
            part, kept = batch.slice(start, 200), []
            for s, t in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(100 * common >= 75 * (len(s) + len(t) - common))
            yield part.select(["a", "b"]).append_column("linked", pa.array(kept, pa.bool_()))


def _sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            sets = [set_of(t) for t in binaries(part.column(0))]
            classes = pa.array([class_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([classes, pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "set"])


def _sided(df: DataFrame, side: str, names: dict[str, str]) -> DataFrame:
    return df.select(F.col("class").alias(side), *[F.col(c).alias(n) for c, n in names.items()])


def allowed(shared: DataFrame, facts: DataFrame) -> DataFrame:
    """Of pairs (a, b, shared) of classes those whose sizes, parities and shared signatures allow similarity, with n_a and n_b.

    The bounds are conditions of the second join, before anything larger is joined to a pair.
    """
    own = {c: f"{c}_a" for c in ("n", *PARITY)}
    both = shared.join(_sided(facts, "a", own), "a").join(_sided(facts, "b", {c: f"{c}_b" for c in own}), "b")
    both = both.where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    both = both.where("7 * (" + " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in PARITY) + ") <= n_a + n_b")
    # At least a quarter of the smaller set, less one, may differ, whatever the bands.
    both = both.where(f"shared > floor(greatest(least(n_a, n_b) * 0.25 - 1, 0) / {SPARE})")
    return both.select("a", "b", "shared", "n_a", "n_b")


def most_often(pairs: DataFrame) -> DataFrame:
    """For each b the a it shares most signatures with, the smallest of several."""
    best = F.min(F.struct((-F.col("shared")).alias("s"), "a", "n_a", "n_b"))
    return pairs.groupBy("b").agg(best.alias("_m")).select("_m.a", "b", (-F.col("_m.s")).alias("shared"), "_m.n_a", "_m.n_b")


def pairs_apart(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with a signature in common that are apart and whose sizes and parities allow similarity.

    The bounds are conditions of the join itself: no row is made for a pair they rule out.
    """
    left = members.select("signature", *[F.col(c).alias(f"a_{c}") for c in ("class", "component", "n", *PARITY)])
    right = members.select("signature", *[F.col(c).alias(f"b_{c}") for c in ("class", "component", "n", *PARITY)])
    differing = " + ".join(f"bit_count(a_{p} ^ b_{p})" for p in PARITY)
    bound = f"4 * a_n >= 3 * b_n and 4 * b_n >= 3 * a_n and 7 * ({differing}) <= a_n + b_n"
    same = left["signature"] == right["signature"]
    joined = left.join(right, same & F.expr(f"a_class < b_class and a_component != b_component and {bound}"))
    return joined.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))


def link_classes(texts: DataFrame, narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (class, n, counts, sketch, doc) of ``narrow`` and their components (node, component)."""
    known = narrow.where("class is not null and doc_id is not null").groupBy("class")
    classes = stored(known.agg(F.first("n_shingles").alias("n"), F.first("counts").alias("counts"), F.min("doc_id").alias("doc"), *[F.first(p).alias(p) for p in (*PARITY, "sketch")]), "classes")
    parts = parts_for(texts)
    packed = "part int, signatures binary, classes binary"
    sent = texts.select("text").mapInArrow(_signed(parts), packed)
    groups = stored(sent.repartition(parts, "part").groupBy("part").applyInArrow(_shared, "signature long, class long"), "groups")

    def sent_along(df: DataFrame, bound: int) -> DataFrame:
        return F.broadcast(df) if df.count() <= bound else df

    sizes = classes.select("class", "n")
    # A similar set is three quarters of this one or larger: so many signatures the two share at least.
    enough = groups.groupBy("class").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "class")
    enough = stored(enough.where(f"shared > floor(greatest(n * 0.1875 - 1, 0) / {SPARE})").select("class"), "enough")
    # Their whole sets, each from the text with the smallest id.
    ids = classes.join(enough, "class", "left_semi").select(F.col("doc").alias("_doc"))
    chosen = texts.join(sent_along(ids, SENT_IDS), F.col("doc_id") == F.col("_doc"), "left_semi").select("text")
    sets = stored(chosen.mapInArrow(_sets, "class long, set binary"), "sets")
    spread = sets.mapInArrow(_spread(parts), packed).repartition(parts, "part")
    met = spread.groupBy("part").applyInArrow(_in_common, "class long, met long").groupBy("class").agg(F.sum("met").alias("met"))
    live = stored(met.join(sizes, "class").where("4 * met >= 3 * n").join(enough, "class", "left_semi").select("class"), "live")
    groups = stored(groups.join(sent_along(live, SENT_IDS), "class", "left_semi"), "groups")

    counts, sketches = (classes.select("class", c) for c in ("counts", "sketch"))

    def met_by(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, one row for each shared signature) once, with ``shared``, that the facts of their classes allow."""
        return allowed(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), classes)

    def possible(both: DataFrame) -> DataFrame:
        """Pairs whose counts and sketches allow that they are similar."""
        both = both.join(_sided(counts, "a", {"counts": "counts_a"}), "a").join(_sided(counts, "b", {"counts": "counts_b"}), "b")
        near = both.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(_near, "a long, b long, n_a long, n_b long")
        both = near.join(_sided(sketches, "a", {"sketch": "sketch_a"}), "a").join(_sided(sketches, "b", {"sketch": "sketch_b"}), "b")
        return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_close, "a long, b long")

    def checked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        few = sets.join(sent_along(ends, SENT_IDS), "class", "left_semi")
        both = pairs.join(_sided(few, "a", {"set": "set_a"}), "a").join(_sided(few, "b", {"set": "set_b"}), "b")
        return stored(both.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long, linked boolean").distinct(), "checked")

    def either_way(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    named, done, links, label = groups.withColumn("component", F.col("class")), None, None, None
    for turn, mask in enumerate(HEADS):
        # A signature's head is its first class in an order of all classes, which changes from round to round.
        first = F.min(F.col("class").bitwiseXOR(F.lit(mask))).bitwiseXOR(F.lit(mask))
        heads = named.groupBy("signature").agg(first.alias("a"), F.min("component").alias("_l"), F.max("component").alias("_u")).where("_l != _u")
        heads = heads.select("signature", "a", F.col("a").alias("ca")) if label is None else heads.join(label, F.col("a") == F.col("node"), "left").select(
            "signature", "a", F.coalesce(F.col("component"), "a").alias("ca")
        )
        star = named.join(heads, "signature").where("component != ca")
        star = met_by(star.select("a", F.col("class").alias("b")))
        star = star if done is None else star.join(done, ["a", "b"], "left_anti")
        # One pair a class, chosen before anything larger than sizes and parities is joined to it.
        tried = checked(stored(possible(most_often(star)), "star"))
        done = either_way(tried) if done is None else done.unionByName(either_way(tried))
        new = tried.where("linked").select("a", "b")
        if turn and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        label = stored(components(links, "a", "b"), "components")
        label = sent_along(label, SENT_IDS // 4)
        named = groups.join(label, F.col("class") == F.col("node"), "left").select(
            "signature", "class", F.coalesce("component", "class").alias("component")
        )
    split = named.groupBy("signature").agg(F.min("component").alias("_l"), F.max("component").alias("_m")).where("_l != _m")
    # Signatures whose classes are not all joined yet; any two classes still apart are compared.
    open_groups = stored(named.join(split.select("signature"), "signature"), "open")
    facts = classes.select(F.col("class").alias("_c"), "n", *PARITY)
    met = pairs_apart(open_groups.join(facts, F.col("class") == F.col("_c")).drop("_c"))
    apart = stored(possible(met_by(met).join(done, ["a", "b"], "left_anti")), "apart")
    rounds = 0
    while True:
        for side in ("a", "b"):
            ends = label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            apart = apart.drop(f"c{side}").join(ends, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        done = either_way(tried)
        apart = stored(apart.where("ca != cb").join(done, ["a", "b"], "left_anti").select("a", "b", "ca", "cb"), "apart")
        if apart.isEmpty():
            return classes, label
        # One pair for each two components, then sixteen times as many in every round, as most pairs of joined ones need no look.
        two = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy("a", "b")
        some = apart.withColumn("_n", F.row_number().over(two)).where(F.col("_n") <= 16**rounds).select("a", "b")
        tried = checked(some)
        links = links.unionByName(tried.where("linked").select("a", "b"))
        label = stored(components(links, "a", "b"), "components")
        rounds += 1


def _components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and class of every row; and of every class its component and that one's smallest id."""
    texts = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    narrow = stored(texts.mapInArrow(_narrow, "doc_id long, n_shingles long, class long, counts binary, p0 long, p1 long, p2 long, p3 long, sketch binary"), "narrow")
    texts = texts.where("doc_id is not null")
    classes, joined = link_classes(texts, narrow)
    named = classes.join(joined, F.col("class") == F.col("node"), "left").select(
        F.col("class").alias("_class"), "doc", F.coalesce("component", "class").alias("_component")
    )
    smallest = named.groupBy("_component").agg(F.min("doc").alias("component_id"))
    return narrow, named.join(smallest, "_component").select("_class", "_component", "component_id")


def document_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    narrow, per_class = _components(documents, key, text)
    return narrow.join(per_class.drop("_component"), F.col("class") == F.col("_class"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def _classed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the class of their text, null without words."""
    for batch in stream:
        sets = map(set_of, binaries(batch.column("text")))
        classes = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, classes], [*batch.schema.names, "_class"])


def first_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those similar to an earlier one: of each component one row with the smallest id stays.

    Rows without words and rows without an id stay. Of several rows of a component with its smallest
    id the one with the smallest text stays; unlike texts under one id are judged apart.
    """
    narrow, per_class = _components(documents)
    per_class = stored(per_class, "classes")
    found = narrow.where("doc_id is not null").join(per_class, F.col("class") == F.col("_class"), "left")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.max(kept).alias("_kept"))
    # Ids that go, or whose rows need a second look; the rest stay without being moved.
    odd = stored(per_id.where("_rows > 1 or not _kept").withColumnRenamed("doc_id", "_odd"), "odd")
    few = odd.count() <= SENT_IDS
    rows, same = wrapped(documents, "doc_id", "text"), F.col("doc_id").cast("bigint") == F.col("_odd")
    once = rows.join(F.broadcast(odd) if few else odd, same, "left_anti")
    repeated = odd.where("_kept and _rows > 1")
    again = rows.join(F.broadcast(repeated) if few else repeated, same, "left_semi")
    again = again.mapInArrow(_classed, T.StructType([*again.schema, T.StructField("_class", T.LongType())]))
    judged = again.join(per_class.withColumnRenamed("_class", "_of"), F.col("_class") == F.col("_of"), "left")
    judged = judged.where(F.coalesce(F.col("doc_id").cast("bigint") == F.col("component_id"), F.lit(True)))
    wordless = judged.where("_class is null")
    least = Window.partitionBy("doc_id", "_component").orderBy("text")
    first = judged.where("_class is not null").withColumn("_n", F.row_number().over(least)).where("_n = 1")
    again = first.select(*rows.columns).unionByName(wordless.select(*rows.columns))
    return unwrapped(once.unionByName(again), documents.columns)
