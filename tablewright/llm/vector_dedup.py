"""Near-duplicate embeddings by range search on a robust-pruned flat graph.

Vectors are set to length 1. Each joins the shards of its four nearest centroids (from a bounded
sample), so that near vectors share a shard although shards are cut apart; but no shard whose border is
too far away for any vector beyond it to be near. A shard builds a
graph: a vector's nearest members, robust-pruned (a candidate goes if it is closer to a kept
neighbour than to the vector, by a factor), and some far members for long steps. The adjacency lists of
a vector from all its shards are joined. Then every vector is searched in the shard of its nearest
centroid: a greedy search from the shard's medoids, then expansion through every vector found within the
range. A link counts for both ends: where the other end's search can't see it, as that one runs in a shard that
the vector is not in, the search that finds it credits both. So a link is lost only if neither vector
is in the other's own shard. A sample of each shard's searches is audited against brute force and the beam doubled until nearly
all is found. Links are verified in double precision.

Equal vectors are one node with a count. Shards with many members are built in blocks, and every
search of the shard runs on each block; searches come in blocks too. So no task holds a whole group,
however many vectors lie together, and no pairs are emitted: a search gives a number of links and
edges to the roots of what is joined in its block.

Defined cases: see ``valid_vectors``; vectors that take no part have no links and are their own
component; so has every row of an id that stands for several vectors but the one that takes part; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, stored
from tablewright.llm.vectors import matrix, padded, valid_vectors

COSINE = 0.95
OVERLAP = 4
SHARD_ROWS, MOST_SHARDS = 800, 16_384
# Sampled rows per centroid, and rounds of refinement.
SAMPLE_PER_SHARD, REFINEMENTS = 8, 3
# Rows of a block of members and of searches.
MEMBERS, SEARCHES = 4_096, 2_048
DEGREE, CANDIDATES, FAR, ALPHA = 24, 64, 4, 1.2
BEAM, MEDOIDS, AT_ONCE = 64, 8, 4
AUDITED, WANTED_RECALL = 64, 0.999
# Expanded in the range search: somewhat beyond the range itself.
SLACK = 0.02
SEED = 4


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(nodes: DataFrame, count: int) -> np.ndarray:
    """Unit centroids from at most SAMPLE_PER_SHARD * MOST_SHARDS rows."""
    shards = min(MOST_SHARDS, max(1, math.ceil(count / SHARD_ROWS)))
    rows = nodes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE_PER_SHARD * shards).select("v").collect()
    sample = unit(np.array([r["v"] for r in rows]))
    centroids = sample[:shards].copy()
    for _ in range(REFINEMENTS):
        near = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        for k in range(len(centroids)):
            if (own := sample[near == k]).size and np.linalg.norm(total := own.sum(axis=0)) > 0:
                centroids[k] = total / np.linalg.norm(total)
    return centroids


def _assigned(centroids: np.ndarray, least: float):
    overlap = min(OVERLAP, len(centroids))
    # A vector in reach of one across the border between two centroids is at most this far from the border.
    reach = math.sqrt(1 - max(least, 0) ** 2)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                x = unit(matrix(part.column("v")))
                score = x @ centroids.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :overlap]
                score = np.take_along_axis(score, near, axis=1)
                apart = np.linalg.norm(centroids[near] - centroids[near[:, :1]], axis=2)
                joins = score[:, :1] - score <= reach * apart + 1e-9
                ends = np.concatenate([[0], joins.sum(axis=1).cumsum()])
                shards = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near[joins], pa.int32()))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                columns = [part.column("id"), part.column("n"), shards, vectors]
                for k in range(overlap):
                    columns_k = [*columns, pa.array(near[:, k], pa.int32()), pa.array(np.full(len(x), k == 0))]
                    yield pa.RecordBatch.from_arrays(columns_k, ["id", "n", "shards", "v", "shard", "home"]).filter(pa.array(joins[:, k]))

    return run


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each member: pruned nearest ones, those that point back, and a few far ones."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    random = np.random.RandomState(SEED)
    candidates, degree = min(CANDIDATES, n - 1), min(DEGREE, n - 1)
    kept = np.full((n, degree), -1, np.int64)
    for start in range(0, n, 512):
        rows = np.arange(start, min(n, start + 512))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-s, candidates - 1, axis=1)[:, :candidates]
        order = np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        own = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, near, axis=1), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("rcd,red->rce", x[near], x[near]), 0))
        alive = np.ones(near.shape, bool)
        line = np.arange(len(rows))
        for k in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)  # the nearest that is left
            kept[rows[some], k] = near[line, pick][some]
            alive &= ~(ALPHA * between[line, pick] <= own)
            alive[line, pick] = False
    lists: list[set[int]] = [set(r[r >= 0].tolist()) for r in kept]
    for i, out in enumerate([list(x) for x in lists]):
        for j in out:
            if len(lists[j]) < 2 * DEGREE:
                lists[j].add(i)
    far = random.randint(0, n, (n, FAR))
    return [np.array(sorted((lists[i] | set(far[i].tolist())) - {i}), np.int64) for i in range(n)]


def medoids(x: np.ndarray) -> np.ndarray:
    """Members nearest to the middle of all and to the middles of a few groups."""
    middle = [int((x @ x.mean(axis=0)).argmax())]
    seeds = np.random.RandomState(SEED).choice(len(x), min(MEDOIDS, len(x)), replace=False)
    group = (x @ x[seeds].T).argmax(axis=1)
    for k in range(len(seeds)):
        own = np.flatnonzero(group == k)
        if len(own):
            middle.append(int(own[(x[own] @ x[own].mean(axis=0)).argmax()]))
    return np.unique(middle)


def range_search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and member of every pair found with a product of at least ``least``."""
    n, width = len(x), max((len(r) for r in lists), default=0)
    beam = min(beam, n)
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i, r in enumerate(lists):
        table[i, : len(r)] = r
    found = []
    starts = medoids(x)
    for first in range(0, len(queries), 256):
        q = queries[first : first + 256]
        score = np.full((len(q), n), -np.inf)
        score[:, starts] = q @ x[starts].T
        done = np.zeros((len(q), n), bool)
        active = np.arange(len(q))
        while len(active):
            s = score[active]
            edge = np.partition(s, n - beam, axis=1)[:, n - beam]
            edge = np.minimum(edge, least - SLACK)  # within the range everything is expanded
            open_ = np.where(done[active] | (s < edge[:, None]), -np.inf, s)
            take = min(AT_ONCE, n)
            best = np.argpartition(-open_, take - 1, axis=1)[:, :take]
            good = np.take_along_axis(open_, best, axis=1) > -np.inf
            active, best, good = active[good.any(axis=1)], best[good.any(axis=1)], good[good.any(axis=1)]
            if not len(active):
                break
            row, node = np.repeat(active, take)[good.ravel()], best.ravel()[good.ravel()]
            done[row, node] = True
            next_ = table[node]
            row = np.repeat(row, next_.shape[1])[next_.ravel() >= 0]
            next_ = next_.ravel()[next_.ravel() >= 0]
            new = score[row, next_] == -np.inf
            row, next_ = row[new], next_[new]
            for cut in range(0, len(row), 50_000):
                i, j = row[cut : cut + 50_000], next_[cut : cut + 50_000]
                score[i, j] = np.einsum("rd,rd->r", q[i], x[j])
        i, j = np.nonzero(score >= least - 1e-9)
        # Verified with the sum in one order for all.
        exact = (q[i] * x[j]).sum(axis=1) >= least
        found.append(np.stack([i[exact] + first, j[exact]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _built(key: tuple, table: pa.Table) -> pa.Table:
    ids, x = table["id"].to_numpy(), matrix(table["v"])
    lists = [ids[r] for r in robust_prune(x)]
    return pa.table([pa.array(ids), pa.array(lists, pa.list_(pa.int64()))], names=["id", "neighbours"])


def _searched(least: float):
    def run(key: tuple, members: pa.Table, searches: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        if members.num_rows and searches.num_rows:
            ids, counts, x = members["id"].to_numpy(), members["n"].to_numpy(), matrix(members["v"])
            names, copies, q = searches["id"].to_numpy(), searches["n"].to_numpy(), matrix(searches["v"])
            place = {i: k for k, i in enumerate(ids.tolist())}
            lists = [np.array([place[j] for j in r if j in place], np.int64) for r in members["neighbours"].to_pylist()]
            audit = np.random.RandomState(SEED).permutation(len(q))[:AUDITED]
            true = q[audit] @ x.T >= least
            beam = BEAM
            while True:
                i, j = range_search(x, lists, q[audit], least, beam)
                if len(i) >= WANTED_RECALL * true.sum() or beam >= len(x):
                    break
                beam *= 2
            i, j = range_search(x, lists, q, least, beam)
            other = names[i] != ids[j]
            i, j = i[other], j[other]
            links = np.bincount(i, counts[j], len(names)).astype(np.int64)
            # The other end's search, in its own shard, does not see vectors that are not in that shard.
            home, within = padded(members["shards"], np.int64, fill=-1)[:, 0], padded(searches["shards"], np.int64, fill=-1)
            unseen = ~(within[i] == home[j][:, None]).any(axis=1)
            back = np.bincount(j[unseen], copies[i[unseen]], len(ids)).astype(np.int64)
            # The smallest node of what is joined in this block; one edge to it per search and member.
            low_i, low_j = names.copy(), ids.copy()
            while True:
                next_i, next_j = low_i.copy(), low_j.copy()
                np.minimum.at(next_i, i, low_j[j])
                np.minimum.at(next_j, j, next_i[i])
                if (next_i == low_i).all() and (next_j == low_j).all():
                    break
                low_i, low_j = next_i, next_j
            out = [np.concatenate([names, ids]), np.concatenate([links, back]), np.concatenate([low_i, low_j])]
            keep = (out[1] > 0) | (out[0] != out[2])
            out = [c[keep] for c in out]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "links", "to"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id of every vector of ``vectors`` (id, v)."""
    nodes = stored(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    count = nodes.count()
    if not count:
        return vectors.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    assigned = stored(nodes.mapInArrow(_assigned(centroids_of(nodes, count), cosine), "id long, n long, shards array<int>, v array<double>, shard int, home boolean"), "assigned")
    # As many rows as there are centroids; sent along.
    sizes = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("h"))
    sizes = stored(sizes.select("shard", F.ceil(F.col("m") / MEMBERS).cast("int").alias("m"), F.ceil(F.col("h") / SEARCHES).cast("int").alias("h")), "sizes")
    cut = assigned.join(F.broadcast(sizes), "shard")
    members = cut.withColumn("member_block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    lists = members.groupBy("shard", "member_block").applyInArrow(_built_columns, "id long, neighbours array<bigint>")
    # At most OVERLAP lists for a vector.
    joined = stored(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "lists")
    graph = members.join(joined, "id")
    graph = graph.withColumn("search_block", F.explode(F.sequence(F.lit(0), F.greatest(F.col("h"), F.lit(1)) - 1)))
    graph = graph.select(*[F.col(c).alias(c) for c in ("shard", "member_block", "search_block", "id", "n", "shards", "v", "neighbours")])
    searches = cut.where("home").withColumn("search_block", F.pmod(F.xxhash64("id", F.lit(9)), F.greatest(F.col("h"), F.lit(1))).cast("int"))
    searches = searches.withColumn("member_block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    searches = searches.select(*[F.col(c).alias(c) for c in ("shard", "member_block", "search_block", "id", "n", "shards", "v")])
    by = ["shard", "member_block", "search_block"]
    found = stored(graph.groupBy(*by).cogroup(searches.groupBy(*by)).applyInArrow(_searched(cosine), "id long, links long, to long"), "found")
    edges = found.where("id != to").select(F.col("id").alias("a"), F.col("to").alias("b"))
    label = components(edges, "a", "b")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_node = nodes.join(linked.withColumnRenamed("id", "_l"), F.col("id") == F.col("_l"), "left")
    per_node = per_node.join(label, F.col("id") == F.col("node"), "left").select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    return vectors.join(per_node, F.col("v") == F.col("_v")).select("id", "n_links", "component_id")


def _built_columns(key: tuple, table: pa.Table) -> pa.Table:
    return _built(key, table.select(["id", "v"]))


def embedding_components(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_e"))
    vectors = stored(valid_vectors(embeddings), "vectors")
    found = near_duplicates(vectors, cosine).join(vectors, "id").select(F.col("id").alias("_id"), F.col("v").alias("_v"), "n_links", "component_id")
    joined = rows.join(found, (F.col("vec_id") == F.col("_id")) & (F.col("_e") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
