"""Exact search for the largest inner products: ball trees per shard, branch and bound, one threshold per query.

Vectors are whole numbers. Equal vectors are one item with its smallest ids, so any number of copies
weighs as one. Items are dealt to clusters around centres from a bounded sample; a cluster has one
ball, and one shard or, if it is large, several. Each shard is a tree of balls down to small leaves.
No vector of a ball has an inner product with q above ``q . centre + |q| radius``.

A query first searches one shard of the cluster with the highest bound. The k-th score it has by then
goes with it to the next clusters in order of their bounds, and from these to the rest: whatever lies
below it is passed over, cluster, node or leaf. Inside a shard a query goes down the tree the same
way, best child first, then meets the leaves in order of their bounds while its threshold rises. All
queries of a block do so together, leaf by leaf. Bounds are rounded up and scores are exact, so the
result is that of comparing every query with every vector.

Vectors shorter than the longest count as padded with zeros. Defined cases: vectors that are null or
hold null or non-finite components (also once scaled) take no part, nor do rows without an id; the
zero vector and the empty one do, with score 0; rows that repeat an id and its vector are one row;
different vectors under one id are rows of their own, told apart by ``query_part``; with fewer
candidates than wanted all are returned; a score beyond a long counts as the nearest long; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import mix, stored
from tablewright.llm.vectors import padded

# Items per leaf and bounds of the items per shard, which grows with the root of their number.
LEAF, SHARD_LEAST, SHARD_MOST, SHARD_ROOTS = 64, 2048, 131_072, 32
# Bytes of components per shard.
SHARD_BYTES = 64 << 20
# Most clusters, rows of the sample they are found in and rounds of moving their centres.
CLUSTERS, SAMPLE, MOVES = 4096, 8192, 8
# Clusters that a query searches after its first one and before all others.
NEXT = 8
# Visits to a shard that one task holds, and queries that go down a tree together.
VISITS, BLOCK = 32_768, 1024
# Below this product of norms every sum of a product is exact in doubles.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1
# Below any score.
NONE = -LONG - 1


# --- one shard


@dataclass
class Tree:
    """Items in leaf order; nodes as ranges of items, children of node i in ``children[i]`` (-1 for a leaf)."""

    items: np.ndarray
    spans: np.ndarray
    children: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree and the order in which it holds the rows of ``x``.

    A node is cut in half along the line through two of its far points; equal halves keep the depth
    at log2 of the leaves however the vectors lie.
    """
    order = np.arange(len(x))
    spans, children, centres, radii = [], [], [], []
    waiting = [(0, len(x), -1, 0)]
    while waiting:
        start, end, parent, side = waiting.pop()
        rows = x[order[start:end]]
        # Divided before the sum: components near the end of doubles must not overflow.
        centre = (rows / len(rows)).sum(axis=0)
        distance = norms(rows - centre)
        number = len(spans)
        spans.append((start, end))
        children.append([-1, -1])
        centres.append(centre)
        radii.append(distance.max())
        if parent >= 0:
            children[parent][side] = number
        if end - start > leaf and radii[-1] > 0:
            one = rows[distance.argmax()]
            other = rows[norms(rows - one).argmax()]
            line = (one - other) / max(1.0, float(np.abs(one - other).max()))
            cut = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows @ line, cut)]
            waiting += [(start, start + cut, number, 0), (start + cut, end, number, 1)]
    # Within a leaf items keep their given order, which is that of their ids.
    for (start, end), below in zip(spans, children, strict=True):
        if below[0] < 0:
            order[start:end].sort()
    return Tree(x[order], np.array(spans), np.array(children), np.array(centres), np.array(radii)), order


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=-1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1.0)[..., None]) ** 2).sum(axis=-1))


def upper_bound(dots: np.ndarray, lengths: np.ndarray, centre_lengths: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No less than any inner product with a vector of the ball, rounding included."""
    reach = lengths * radii
    return dots + reach + 1e-9 * (reach + lengths * centre_lengths) + 1e-9


@dataclass
class Best:
    """The best items of each query of a block: scores falling, of equals the smaller first id first."""

    scores: np.ndarray
    firsts: np.ndarray
    places: np.ndarray
    floor: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int, floor: np.ndarray) -> Best:
        return cls(np.full((queries, k), NONE), np.full((queries, k), LONG), np.full((queries, k), -1), floor)

    def threshold(self, rows: np.ndarray) -> np.ndarray:
        """The score that an item must reach to count."""
        return np.maximum(self.floor[rows], self.scores[rows, -1])

    def offer(self, rows: np.ndarray, scores: np.ndarray, firsts: np.ndarray, start: int) -> None:
        """Merge the scores of a leaf's items for some queries."""
        places = np.arange(start, start + scores.shape[1])
        all_scores = np.hstack([self.scores[rows], scores])
        all_firsts = np.hstack([self.firsts[rows], np.broadcast_to(firsts, scores.shape)])
        all_places = np.hstack([self.places[rows], np.broadcast_to(places, scores.shape)])
        best = np.lexsort((all_firsts, ~all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(all_scores, best, 1)
        self.firsts[rows] = np.take_along_axis(all_firsts, best, 1)
        self.places[rows] = np.take_along_axis(all_places, best, 1)


def search_tree(tree: Tree, firsts: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The best ``k`` items of each query, without those below its ``floor``.

    Products are doubles where these are exact, else whole numbers of Python.
    """
    lengths, centre_lengths = norms(queries), norms(tree.centres)
    exact = float(lengths.max(initial=0.0)) * float(norms(tree.items).max(initial=0.0)) < EXACT
    items, wanted = (tree.items, queries) if exact else (_unbounded(tree.items), _unbounded(queries))
    best = Best.none(len(queries), k, floor)

    def products(rows: np.ndarray, start: int, end: int) -> np.ndarray:
        found = wanted[rows] @ items[start:end].T
        return (found if exact else np.clip(found, -LONG, LONG)).astype(np.int64)

    def bounds(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", queries[rows], tree.centres[nodes])
        return upper_bound(dots, lengths[rows], centre_lengths[nodes], tree.radii[nodes])

    def visit(rows: np.ndarray, leaves: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            start, end = tree.spans[leaves[part[0]]]
            at = rows[part]
            scores = products(at, start, end)
            useful = (scores >= best.threshold(at)[:, None]).any(axis=1)
            if useful.any():
                best.offer(at[useful], scores[useful], firsts[start:end], int(start))

    # Down the best children to one leaf each.
    everyone = np.arange(len(queries))
    at = np.zeros(len(queries), np.int64)
    while True:
        inner = np.flatnonzero(tree.children[at, 0] >= 0)
        if not len(inner):
            break
        pair = tree.children[at[inner]]
        left, right = (bounds(inner, pair[:, side]) for side in (0, 1))
        at[inner] = np.where(left >= right, pair[:, 0], pair[:, 1])
    visit(everyone, at)
    dived = at

    # Down all children that may still hold a better item.
    rows, nodes, leaf_rows, leaf_nodes, leaf_bounds = everyone, np.zeros(len(queries), np.int64), [], [], []
    while len(rows):
        bound = bounds(rows, nodes)
        alive = bound >= best.threshold(rows)
        rows, nodes, bound = rows[alive], nodes[alive], bound[alive]
        is_leaf = tree.children[nodes, 0] < 0
        leaf_rows.append(rows[is_leaf])
        leaf_nodes.append(nodes[is_leaf])
        leaf_bounds.append(bound[is_leaf])
        rows, nodes = np.repeat(rows[~is_leaf], 2), tree.children[nodes[~is_leaf]].ravel()
    rows, nodes, bound = (np.concatenate([np.zeros(0, np.int64) if i < 2 else np.zeros(0), *x]) for i, x in enumerate((leaf_rows, leaf_nodes, leaf_bounds)))
    new = nodes != dived[rows]
    rows, nodes, bound = rows[new], nodes[new], bound[new]

    # The leaves in order of their bounds, more at a time as thresholds settle.
    order = np.lexsort((-bound, rows))
    rows, nodes, bound = rows[order], nodes[order], bound[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    wave = np.log2(place + 1).astype(np.int64)
    order = np.argsort(wave, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(wave[order])) + 1) if len(order) else []:
        part = part[bound[part] >= best.threshold(rows[part])]
        if len(part):
            visit(rows[part], nodes[part])
    return best


def _unbounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers without a bound."""
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


# --- clusters, shards and rounds on Spark


def whole_vectors(df: DataFrame, key: str, vector: str, scale: float) -> tuple[DataFrame, int]:
    """(id, x) of the rows that take part, components as floor(scale * c) and equally many, each pair once; and their number."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.select("id", F.transform("v", lambda c: c * F.lit(float(scale))).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Doubles that large are whole numbers.
    whole = F.transform("v", lambda c: F.when(F.abs(c) < 2.0**62, F.floor(c).cast("double")).otherwise(c))
    rows = stored(rows.where(finite).select("id", whole.alias("x")).distinct(), "rows")
    sizes = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = sizes["most"] or 0
    if sizes["least"] != sizes["most"]:
        zeros = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x"))
        rows = stored(rows.select("id", F.concat("x", zeros).alias("x")).distinct(), "rows")
    return rows, width


@dataclass(frozen=True)
class Clusters:
    """Centres with the ball around all their items and the number of shards each is cut into."""

    centres: np.ndarray
    radii: np.ndarray
    pieces: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        lengths = norms(q)
        return upper_bound(q @ self.centres.T, lengths[:, None], norms(self.centres)[None], self.radii[None])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + BLOCK] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), BLOCK)]])


def _centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Centres of the sample by Lloyd's moves from evenly spread rows."""
    centres = sample[np.linspace(0, len(sample) - 1, clusters).astype(int)].astype(np.float64)
    for _ in range(MOVES):
        nearest = _nearest(sample, centres)
        for c in np.unique(nearest):
            centres[c] = sample[nearest == c].mean(axis=0)
    return centres


def _shard_rows(n: int, width: int) -> int:
    """Items per shard: tasks, and copies of queries sent, both grow with the root of the items."""
    return int(min(max(SHARD_LEAST, SHARD_ROOTS * math.isqrt(n)), SHARD_MOST, max(LEAF, SHARD_BYTES // (8 * max(1, width)))))


def items_of(rows: DataFrame, wanted: int) -> DataFrame:
    """(x, ids): each distinct vector with the smallest ids that hold it, as many as a result can name.

    The limit per vector is applied before the shuffle as well as after it.
    """
    by_id = Window.partitionBy("x").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= wanted + 1)
    return few.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def clustered(items: DataFrame, n: int, width: int, shard_rows: int | None = None) -> tuple[DataFrame, Clusters]:
    """The items with their shard (cluster, piece), and the clusters."""
    per_shard = shard_rows or _shard_rows(n, width)
    clusters = min(CLUSTERS, max(1, math.ceil(n / per_shard)))
    sample = items.orderBy(F.xxhash64("x"), "x").limit(min(SAMPLE, max(clusters, SAMPLE))).toArrow()
    x = padded(sample.column("x"), width=width)
    # Distances only steer the search: very large components are brought down for them.
    shrink = max(1.0, float(np.abs(x).max(initial=0.0)) / 1e100)
    found = _centres(x / shrink, min(clusters, len(x))) * shrink

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = padded(batch.column(0), width=width)
            near = _nearest(rows / shrink, found / shrink)
            far = norms(rows - found[near])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["x", "ids", "cluster", "far"])

    dealt = stored(items.select("x", "ids").mapInArrow(assign, "x array<double>, ids array<long>, cluster int, far double"), "items")
    radii, pieces = np.zeros(len(found)), np.zeros(len(found), np.int64)
    for row in dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():  # at most CLUSTERS rows
        radii[row["cluster"]], pieces[row["cluster"]] = row["r"] * (1 + 1e-9), math.ceil(row["n"] / per_shard)
    held = np.flatnonzero(pieces)
    known = Clusters(found[held], radii[held], pieces[held])
    numbers = [(int(c), i, int(pieces[c])) for i, c in enumerate(held.tolist())]
    numbered = F.broadcast(items.sparkSession.createDataFrame(numbers, "_from int, _to int, _pieces int"))
    piece = F.pmod(F.xxhash64("x"), F.col("_pieces")).cast("int")
    joined = dealt.join(numbered, dealt["cluster"] == F.col("_from"))
    return joined.select(F.col("_to").alias("cluster"), piece.alias("piece"), "x", "ids"), known


def _packed_tree(width: int):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        by_first = np.argsort(first, kind="stable")
        x = padded(table.column("x"), width=width)[by_first]
        tree, order = build_tree(x)
        kept = ids.take(pa.array(by_first[order]))
        # The smallest type that holds the components.
        kind = next((t for t in (np.int16, np.int32) if np.abs(x).max(initial=0) <= np.iinfo(t).max), np.float64)
        columns = [table.column("cluster")[0].as_py(), table.column("piece")[0].as_py(), np.dtype(kind).str]
        columns += [a.tobytes() for a in (tree.items.astype(kind), tree.spans, tree.children, tree.centres, tree.radii)]
        columns += [kept.offsets.to_numpy().astype(np.int64).tobytes(), kept.values.to_numpy()[kept.offsets[0].as_py() : kept.offsets[-1].as_py()].tobytes()]
        return pa.table({name: pa.array([value], kind) for (name, kind), value in zip(_TREE.items(), columns, strict=True)})

    return pack


_TREE = {"cluster": pa.int32(), "piece": pa.int32(), "kind": pa.string()} | {
    name: pa.binary() for name in ("items", "spans", "children", "centres", "radii", "offsets", "ids")
}
_TREE_SCHEMA = "cluster int, piece int, kind string, items binary, spans binary, children binary, centres binary, radii binary, offsets binary, ids binary"


def _unpacked_tree(row: dict, width: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    radii = np.frombuffer(row["radii"])
    items = np.frombuffer(row["items"], np.dtype(row["kind"])).astype(np.float64)
    offsets, ids = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["ids"], np.int64)
    pairs = (np.frombuffer(row[name], np.int64).reshape(-1, 2) for name in ("spans", "children"))
    rows = len(offsets) - 1
    return Tree(items.reshape(rows, width), *pairs, np.frombuffer(row["centres"]).reshape(len(radii), width), radii), offsets - offsets[0], ids


def _routes(clusters: Clusters, width: int, number: int):
    """The shards that queries visit in a round: one of the cluster with the highest bound, then the
    rest of that cluster with the next ones, then all others, each while its bound reaches the query's floor."""
    low, high = ((0, 1), (0, 1 + NEXT), (1 + NEXT, len(clusters.radii)))[number]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids = part.column(0).to_numpy()
                floors = part.column(3).fill_null(NONE).to_numpy()
                bounds = clusters.bounds(padded(part.column(2), width=width))
                order = np.argsort(-bounds, axis=1, kind="stable")[:, low:high]
                row = np.repeat(np.arange(len(ids)), order.shape[1])
                cluster = order.ravel()
                reached = bounds[row, cluster] >= floors[row]
                first = np.arange(len(cluster)) % max(1, order.shape[1]) == 0
                row, cluster, first = row[reached], cluster[reached], first[reached]
                home = (mix(ids.astype(np.uint64)) % clusters.pieces.astype(np.uint64)[order[:, 0]]).astype(np.int64) if order.shape[1] else ids
                pieces = clusters.pieces[cluster] if number else np.ones(len(cluster), np.int64)
                piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                row, cluster, first = np.repeat(row, pieces), np.repeat(cluster, pieces), np.repeat(first, pieces)
                if number == 0:
                    piece = home[row]
                elif number == 1:
                    new = ~(first & (piece == home[row]))
                    row, cluster, piece = row[new], cluster[new], piece[new]
                taken = part.take(pa.array(row))
                columns = [*taken.columns, pa.array(cluster.astype(np.int32)), pa.array(piece.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "x", "floor", "cluster", "piece"])

    return run


def _visited(width: int, k: int):
    """Search one shard for the queries that visit it, whose floors are the scores they have so far."""

    def run(shards: pa.Table, visits: pa.Table) -> pa.Table:
        if not shards.num_rows or not visits.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in _FOUND.items()})
        tree, offsets, ids = _unpacked_tree(shards.slice(0, 1).to_pylist()[0], width)
        firsts = ids[offsets[:-1]]
        q = padded(visits.column("x"), width=width)
        floors = visits.column("floor").fill_null(NONE).to_numpy()
        parts = []
        for start in range(0, len(q), BLOCK):
            block = q[start : start + BLOCK]
            best = search_tree(tree, firsts, block, floors[start : start + BLOCK], k)
            row, column = np.nonzero(best.places >= 0)
            place = best.places[row, column]
            sizes = offsets[place + 1] - offsets[place]
            own = (tree.items[place] == block[row]).all(axis=1)
            at = np.repeat(offsets[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids[at]))
            asked = visits.slice(start, BLOCK).take(pa.array(row))
            columns = [asked.column("id"), asked.column("part"), pa.array(best.scores[row, column]), lists, pa.array(own)]
            parts.append(pa.table(columns, names=list(_FOUND)))
        return pa.concat_tables(parts)

    return run


_VISIT_SCHEMA = "id long, part int, x array<double>, floor long, cluster int, piece int"
_FOUND = {"id": pa.int64(), "part": pa.int32(), "score": pa.int64(), "ids": pa.list_(pa.int64()), "own": pa.bool_()}
_FOUND_SCHEMA = "id long, part int, score long, ids array<long>, own boolean"


def nearest_items(queries: DataFrame, shards: DataFrame, clusters: Clusters, width: int, wanted: int, visits_per_task: int = VISITS) -> DataFrame:
    """(id, part, score, ids, own): items found, each query's best ``wanted + 1`` among them.

    ``queries`` has id, part and x; a query's own row is one of the candidates until it is taken off.
    """
    k = wanted + 1
    found = queries.sparkSession.createDataFrame([], _FOUND_SCHEMA)
    some_left = (True, len(clusters.radii) > 1 or clusters.pieces.max(initial=0) > 1, len(clusters.radii) > 1 + NEXT)
    key = ["cluster", "piece", "chunk"]
    for number in range(3):
        if not some_left[number]:
            break
        ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("id", "part").orderBy(F.desc("score"))))
        floors = ranked.where(F.col("_r") == k).select("id", "part", F.col("score").alias("floor"))
        searching = queries.join(floors, ["id", "part"], "left").select("id", "part", "x", "floor")
        visits = stored(searching.mapInArrow(_routes(clusters, width, number), _VISIT_SCHEMA), "visits")
        chunks = visits.groupBy("cluster", "piece").agg(F.ceil(F.count("*") / visits_per_task).cast("int").alias("chunks"))
        met = shards.join(chunks, ["cluster", "piece"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = visits.join(chunks, ["cluster", "piece"])
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "part"), F.col("chunks")).cast("int"))
        asked = dealt.select(*key, "id", "part", "x", "floor").groupBy(*key)
        new = met.select(*key, *list(_TREE)[2:]).groupBy(*key).cogroup(asked).applyInArrow(_visited(width, k), _FOUND_SCHEMA)
        found = found.unionByName(stored(new, "found"))
    return found


def embedding_top(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    wanted: int = 5,
    scale: float = 256.0,
    shard_rows: int | None = None,
) -> DataFrame:
    """(query_id, query_part, rank, vec_id, score): the best rows for every row whose id ``every`` divides."""
    rows, width = whole_vectors(df, key, vector, scale)
    items = stored(items_of(rows, wanted), "items")
    n = items.count()
    by_vector = Window.partitionBy("id").orderBy("x")
    queries = rows.where(F.col("id") % every == 0).withColumn("part", F.row_number().over(by_vector))
    if n:
        dealt, clusters = clustered(items, n, width, shard_rows)
        shards = stored(dealt.groupBy("cluster", "piece").applyInArrow(_packed_tree(width), _TREE_SCHEMA), "shards")
        found = nearest_items(stored(queries, "queries"), shards, clusters, width, wanted)
    else:
        found = df.sparkSession.createDataFrame([], _FOUND_SCHEMA)
    named = found.withColumn("vec_id", F.explode("ids")).where("not (own and vec_id = id)")
    order = Window.partitionBy("id", "part").orderBy(F.desc("score"), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= wanted)
        .select(F.col("id").alias("query_id"), F.col("part").alias("query_part"), "rank", "vec_id", "score")
    )
