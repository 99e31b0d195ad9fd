"""Operators over embeddings against brute force."""

import numpy as np
import pytest

from tablewright.llm import ann, vector_dedup
from tablewright.llm.common import stored
from tablewright.llm.vectors import valid_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.RandomState(2)
    x = r.randn(900, 16)
    x[100:160] = x[100] + 0.05 * r.randn(60, 16)
    x[200:230] = x[200]
    x[300] *= 7
    return [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x.astype(np.float32))]


def broken():
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [1.0] * 7]
    return [(2000 + 20 * k, v, None) for k, v in enumerate(bad)] + [(None, [1.0] * 16, 1)]


def test_vectors_that_take_no_part(spark, rows):
    df = spark.createDataFrame([*rows, *broken()], SCHEMA)
    assert {r["id"] for r in valid_vectors(df).collect()} == set(range(900))


def test_nearest(spark, rows):
    df = spark.createDataFrame([*rows, *broken(), rows[40]], SCHEMA).repartition(3)
    got = ann.embedding_neighbours(df).collect()
    x = np.array([v for _, v, _ in rows])
    found = right = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(range(0, 900, 20))
    for q, hits in by_query.items():
        hits.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in hits] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in hits] == sorted((-r["score"], r["vec_id"]) for r in hits)
        assert all(np.isclose(r["score"], x[q] @ x[r["vec_id"]], rtol=1e-12) for r in hits)
        s = x @ x[q]
        s[q] = -np.inf
        true = set(np.lexsort((np.arange(900), -s))[:20].tolist())
        found += len(true)
        right += len(true & {r["vec_id"] for r in hits})
    assert right >= 0.9 * found
    # Copies of one vector: ties go to the smaller id.
    assert [r["vec_id"] for r in by_query[220][:20]] == [i for i in range(200, 222) if i != 220][:20]


def test_isolated_queries_get_all_they_want(spark):
    r = np.random.RandomState(7)
    x = r.randn(16) + 0.01 * r.randn(400, 16)
    x[::20] = r.randn(20, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.embedding_neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect()
    for q in range(0, 400, 20):
        assert sorted(h["rank"] for h in got if h["query_id"] == q) == list(range(1, 21))


def test_few_and_no_vectors(spark, rows):
    few = ann.embedding_neighbours(spark.createDataFrame(rows[:5], SCHEMA)).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert ann.embedding_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.embedding_neighbours(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert vector_dedup.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probes_fall_in_probability(spark, rows):
    vectors = stored(valid_vectors(spark.createDataFrame(rows, SCHEMA)), "vectors")
    tables = ann._one_table(ann.fit_tables(vectors, 20), 0)
    slots = tables.slots(np.array([rows[3][1]], np.float64), query=True)
    code, _, reached = ann.probes(tables, slots[:, 0])
    assert code[0] == tables.buckets(slots)[0, 0] or len(code) > 1
    assert len(set(code.tolist())) == len(code) and reached[0] >= ann.VISITED


def test_probes_reach_the_probability_with_many_functions():
    r = np.random.RandomState(6)
    multipliers = (ann.mix(np.arange(1, 13, dtype=np.uint64)) | np.uint64(1)).reshape(1, 12)
    tables = ann.Tables(np.zeros((1, 12, 2)), np.zeros((1, 12)), ann.WIDTH, 1.0, 1.0, multipliers)
    code, query, reached = ann.probes(tables, 10 * r.randn(6, 12))
    assert (reached >= ann.VISITED).all() and set(query.tolist()) == set(range(6))
    assert all(len(set(code[query == k].tolist())) == (query == k).sum() for k in range(6))


def test_near_duplicates(spark, rows):
    df = spark.createDataFrame([*rows, *broken()], SCHEMA).repartition(3)
    got = {r["vec_id"]: r for r in vector_dedup.embedding_components(df).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.95
    parent = list(range(900))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(s), strict=True):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    for i in range(900):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (s[i].sum() - 1, root(i), root(i) == i)
    for i, _, _ in broken()[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_links_across_shards_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 200)
    r = np.random.RandomState(0)
    centres, ends, at = r.randn(60, 32), r.randint(0, 60, (40, 2)), r.rand(2000, 1)
    line = ends[r.randint(0, 40, 2000)]
    x = centres[line[:, 0]] * at + centres[line[:, 1]] * (1 - at) + 0.02 * r.randn(2000, 32)
    x[1900:] = x[:100]  # copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {q["vec_id"]: q["n_links"] for q in vector_dedup.embedding_components(df).collect()}
    unit = vector_dedup.unit(x)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(2000)])
    print("links", found.sum(), "of", want.sum(), "vectors short", (found < want).sum())
    assert (found <= want).all()
    assert (found == want).mean() > 0.999 and found.sum() >= 0.9999 * want.sum()


def test_pruned_lists_keep_the_nearest():
    x = vector_dedup.unit(np.random.RandomState(0).randn(300, 8))
    lists = vector_dedup.robust_prune(x)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    assert all(s[i].argmax() in lists[i] for i in range(300))
    i, j = vector_dedup.range_search(x, lists, x, 0.9, 32)
    want = (x @ x.T >= 0.9).sum()
    assert len(i) >= 0.99 * want
