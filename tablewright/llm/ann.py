"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes all norms 1, so
the largest inner product is the smallest distance. A table hashes a vector with several functions
floor((a x + b) / w), a normal, to a bucket. A query visits, in each table, its own bucket and
perturbed ones in falling order of the estimated probability that a neighbour lies there: under a
distance d the difference of two projections is normal, which gives the probability of every slot.
It goes on until the visited buckets together reach a fixed probability per table. The distance
d is that of the wanted neighbours in a bounded sample.

Buckets are dealt out to cells. A cell multiplies the queries that visit it with its vectors; the best
of every cell are merged, without repeats from several tables, by their exact product on the original
vectors. Queries that find fewer than wanted are multiplied with all vectors. Buckets with many vectors are split over cells and their queries sent to each; queries are
sent in blocks. All vectors are indexed; nothing is cut off.

Defined cases: see ``valid_vectors`` for vectors that take no part; ties go to the smaller id; fewer
candidates than wanted give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import mix, stored
from tablewright.llm.vectors import matrix, valid_vectors

NEAREST = 20
TABLES = 5
# Estimated probability, per table, that a neighbour lies in a visited bucket: 0.97 in five tables.
VISITED = 0.5
WIDTH = 2.1  # slot width in units of the neighbours' distance
BUCKET_ROWS = 100
# Perturbed buckets kept in the search for the most probable ones, per query and table, and queries searched at once;
# where they do not reach VISITED, four times as many are kept for a quarter of the queries, and so on.
FRONT, PROBED = 1024, 200
# Rows of the bounded sample that distances are estimated on.
SAMPLE = 2_000
# Bytes of vectors in a cell: every cell returns its best for each query that visits it, so cells are large.
CELL_BYTES, QUERY_BLOCK = 32 << 20, 2_048
SEED = 1


@dataclass
class Tables:
    """Projections, offsets and slot width of all tables."""

    directions: np.ndarray  # table, function, coordinate
    offsets: np.ndarray  # table, function
    width: float
    distance: float
    norm: float
    multipliers: np.ndarray

    def slots(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Position of each vector in units of slots: vector, table, function."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            lifted = np.concatenate([x / length, np.zeros((len(x), 1))], axis=1)
        else:
            lifted = np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - length**2, 0))], axis=1) / self.norm
        return np.einsum("nd,tkd->ntk", lifted, self.directions) / self.width + self.offsets

    def buckets(self, slots: np.ndarray) -> np.ndarray:
        """Number of the bucket of each vector and table; a sum over functions, so that perturbations add up."""
        return (np.floor(slots).astype(np.int64).view(np.uint64) * self.multipliers).sum(axis=2, dtype=np.uint64)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def fit_tables(vectors: DataFrame, wanted: int) -> Tables | None:
    """Tables for ``vectors`` (id, v), from their number, largest norm and a bounded sample."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    count, largest = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not count:
        return None
    rows = vectors.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in rows])
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    near = 2 - 2 * (x[:400] / lengths[:400]) @ (x / largest).T
    np.fill_diagonal(near, np.inf)
    place = min(max(1, round(wanted * len(x) / count)), len(x) - 1)
    distance = 0.5 if place < 1 else float(np.sqrt(np.quantile(np.maximum(np.partition(near, place - 1, axis=1)[:, place - 1], 1e-6), 0.9)))
    # A function has about 2.6 slots in use; buckets of about BUCKET_ROWS are wanted.
    functions = max(2, round(math.log(max(count / BUCKET_ROWS, 2)) / math.log(2.6)))
    random = np.random.RandomState(SEED)
    size = x.shape[1] + 1
    multipliers = mix(np.arange(1, TABLES * functions + 1, dtype=np.uint64)).reshape(TABLES, functions) | np.uint64(1)
    return Tables(random.standard_normal((TABLES, functions, size)), random.random_sample((TABLES, functions)), WIDTH * distance, distance, largest, multipliers)


def probes(tables: Tables, slots: np.ndarray, visited: float = VISITED, front: int = FRONT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets to visit, most probable first: bucket numbers and query of each, and the probability reached.

    ``tables`` holds one table, ``slots`` is query by function. Functions are added one by one, keeping the most
    probable combinations of slots so far; as probabilities multiply, none of the best is lost. Queries that these do
    not bring to ``visited`` are searched again with more of them.
    """
    n, functions = slots.shape
    base = np.floor(slots)
    inside = slots - base
    scale = tables.width / tables.distance
    steps = np.arange(-2, 3)
    code, p = np.zeros((n, 1), np.uint64), np.ones((n, 1))
    for k in range(functions):
        edges = (np.arange(-2, 4)[None, :] - inside[:, k : k + 1]) * scale
        share = np.diff(normal_cdf(edges), axis=1)
        number = (base[:, k : k + 1] + steps).astype(np.int64).view(np.uint64) * tables.multipliers[0, k]
        code = (code[:, :, None] + number[:, None, :]).reshape(n, -1)
        p = (p[:, :, None] * share[:, None, :]).reshape(n, -1)
        if p.shape[1] > front:
            best = np.argpartition(-p, front - 1, axis=1)[:, :front]
            code, p = np.take_along_axis(code, best, axis=1), np.take_along_axis(p, best, axis=1)
    order = np.argsort(-p, axis=1, kind="stable")
    code, p = np.take_along_axis(code, order, axis=1), np.take_along_axis(p, order, axis=1)
    reached = np.cumsum(p, axis=1)
    take = (reached - p) < visited
    query, _ = np.nonzero(take)
    code, reached = code[take], reached[np.arange(n), take.sum(axis=1) - 1]
    short = np.flatnonzero(reached < visited) if len(steps) ** functions > front else np.zeros(0, np.int64)
    at_once = max(1, PROBED * FRONT // (4 * front))
    codes, queries = [code[~np.isin(query, short)]], [query[~np.isin(query, short)]]
    for start in range(0, len(short), at_once):
        some = short[start : start + at_once]
        more, whose, reached[some] = probes(tables, slots[some], visited, 4 * front)
        codes.append(more)
        queries.append(some[whose])
    return np.concatenate(codes), np.concatenate(queries), reached


def _one_table(tables: Tables, t: int) -> Tables:
    return Tables(tables.directions[t : t + 1], tables.offsets[t : t + 1], tables.width, tables.distance, tables.norm, tables.multipliers[t : t + 1])


def _bucket_name(t: int, buckets: np.ndarray) -> np.ndarray:
    return mix(buckets + np.uint64(t + 1)).view(np.int64)


def _indexed(tables: Tables):
    def run(stream):
        for batch in stream:
            x = matrix(batch.column("v"))
            buckets = tables.buckets(tables.slots(x, query=False))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket_name(t, buckets[:, t])), batch.column("id"), batch.column("v")], ["bucket", "id", "v"])

    return run


def _probed(tables: Tables):
    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, PROBED):
                part = batch.slice(start, PROBED)
                slots, ids = tables.slots(matrix(part.column("v")), query=True), part.column("id").to_numpy()
                for t in range(TABLES):
                    code, query, _ = probes(_one_table(tables, t), slots[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket_name(t, code)), pa.array(ids[query])], ["bucket", "query_id"])

    return run


class Best:
    """The best products of each query so far, exact, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, wanted: int):
        self.queries, self.query_ids, self.wanted = queries, query_ids, wanted
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def offer(self, chosen: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Products of some queries with some vectors."""
        for start in range(0, len(chosen), 256):
            some = chosen[start : start + 256]
            s = self.queries[some] @ vectors.T
            # A margin for rounding: kept pairs are multiplied again, always in the same order.
            q, v = np.nonzero(s >= (self.least[some] - 1e-9 * (1 + np.abs(self.least[some])))[:, None])
            for cut in range(0, len(q), 100_000):
                i, j = some[q[cut : cut + 100_000]], v[cut : cut + 100_000]
                exact = (self.queries[i] * vectors[j]).sum(axis=1)
                other = self.query_ids[i] != ids[j]
                self.held.append((i[other], ids[j[other]], exact[other]))
                self.waiting += int(other.sum())
                if self.waiting > 400_000:
                    self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, v, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((v, -s, i))
        i, v, s = i[order], v[order], s[order]
        # Copies of a vector in several tables.
        order = np.concatenate([[True], (i[1:] != i[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])])[: len(i)]
        i, v, s = i[order], v[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < self.wanted
        last = place == self.wanted - 1
        self.least[i[last]] = s[last]
        self.held, self.waiting = [(i[kept], v[kept], s[kept])], 0
        return self.held[0]


def _cell(wanted: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and queries.num_rows:
            bucket, ids, x = index["bucket"].to_numpy(), index["id"].to_numpy(), matrix(index["v"])
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], ids[order], x[order]
            names = queries["query_id"].to_numpy()
            best = Best(matrix(queries["v"]), names, wanted)
            visits = queries["buckets"].combine_chunks()
            flat = visits.flatten().to_numpy()
            owner = np.repeat(np.arange(len(names)), visits.value_lengths().to_numpy())
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for b, e in zip(first, np.append(first[1:], len(bucket)), strict=True):
                chosen = owner[np.searchsorted(flat, bucket[b], "left") : np.searchsorted(flat, bucket[b], "right")]
                if len(chosen):
                    best.offer(chosen, ids[b:e], x[b:e])
            i, v, s = best.settle()
            out = (names[i], v, s)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    return run


def _against_all(vectors: DataFrame, queries: DataFrame, wanted: int, cells: int, blocks: int) -> DataFrame:
    """query_id, id, score of the best of all vectors in each cell, all vectors of a cell in one bucket."""
    zero = F.lit(0).cast("bigint")
    placed = vectors.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.select("cell", "block", zero.alias("bucket"), "id", "v")
    asking = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"))
    asking = asking.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))
    asking = asking.select("cell", "block", F.col("id").alias("query_id"), "v", F.array(zero).alias("buckets"))
    return placed.groupBy("cell", "block").cogroup(asking.groupBy("cell", "block")).applyInArrow(
        _cell(wanted), "query_id long, id long, score double"
    )


def nearest(vectors: DataFrame, queries: DataFrame, wanted: int = NEAREST) -> DataFrame:
    """query_id, rank, id, score of the nearest found of ``vectors`` for each of ``queries``; both are (id, v)."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, id bigint, score double"
    tables = fit_tables(vectors, wanted)
    if tables is None:
        return spark.createDataFrame([], schema)
    index = stored(vectors.mapInArrow(_indexed(tables), "bucket long, id long, v array<double>"), "index")
    rows, asked = index.count(), queries.count()
    total = rows // TABLES
    cell_rows = max(1, CELL_BYTES // (8 * (tables.directions.shape[2] - 1)))
    cells, blocks = max(1, math.ceil(rows / cell_rows)), max(1, math.ceil(asked / QUERY_BLOCK))
    # Buckets too large for one cell, with the number of pieces they are split into.
    piece_rows = max(1, cell_rows // 4)
    split = index.groupBy("bucket").count().where(F.col("count") > piece_rows)
    split = stored(split.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("count") / piece_rows).cast("int").alias("pieces")), "split")

    def cell_of(piece: Column) -> Column:
        return F.pmod(F.xxhash64("bucket", piece), F.lit(cells))

    def with_pieces(df: DataFrame) -> DataFrame:
        return df.join(split, F.col("bucket") == F.col("_bucket"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).drop("_bucket")

    def block_of(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name), F.lit(5)), F.lit(blocks)).cast("int")

    placed = with_pieces(index).withColumn("cell", cell_of(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("cell", "block", "bucket", "id", "v")
    visits = with_pieces(queries.mapInArrow(_probed(tables), "bucket long, query_id long"))
    visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("cell", cell_of(F.col("piece")))
    visits = visits.groupBy("cell", "query_id").agg(F.collect_set("bucket").alias("buckets"))
    asking = visits.join(queries.select(F.col("id").alias("query_id"), "v"), "query_id").withColumn("block", block_of("query_id"))
    asking = asking.select("cell", "block", "query_id", "v", "buckets")
    found = placed.groupBy("cell", "block").cogroup(asking.groupBy("cell", "block")).applyInArrow(
        _cell(wanted), "query_id long, id long, score double"
    )
    once = stored(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), "once")
    # Queries whose buckets hold fewer than wanted, though there are more candidates.
    counts = once.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    own = vectors.select(F.col("id").alias("_own"))
    short = queries.join(counts, F.col("id") == F.col("_q"), "left").where(F.coalesce("_n", F.lit(0)) < min(wanted, total)).join(own, F.col("id") == F.col("_own"), "left")
    short = short.where(F.coalesce("_n", F.lit(0)) < F.least(F.lit(wanted), total - F.col("_own").isNotNull().cast("int")))
    short = stored(short.select("id", "v"), "short")
    if lacking := short.count():
        once = once.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_against_all(vectors, short, wanted, math.ceil(total / cell_rows), math.ceil(lacking / QUERY_BLOCK)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select("query_id", "rank", "id", "score")


def recall(vectors: DataFrame, queries: DataFrame, found: DataFrame, wanted: int = NEAREST) -> float:
    """Share of the true nearest that ``found`` holds, by brute force; for a bounded number of queries."""
    x = [(r["id"], np.array(r["v"])) for r in queries.orderBy(F.xxhash64("id"), "id").limit(200).collect()]
    names, q = np.array([i for i, _ in x]), np.array([v for _, v in x])

    def run(stream):
        best = Best(q, names, wanted)
        for batch in stream:
            best.offer(np.arange(len(names)), batch.column("id").to_numpy(), matrix(batch.column("v")))
        i, v, s = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(v), pa.array(s)], ["query_id", "id", "score"])

    partial = vectors.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    true = stored(partial.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= wanted), "true")
    return true.join(found, ["query_id", "id"], "left_semi").count() / max(true.count(), 1)


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    """The nearest of all embeddings for those whose vec_id is divisible by 20."""
    vectors = stored(valid_vectors(embeddings), "vectors")
    found = nearest(vectors, vectors.where("id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
