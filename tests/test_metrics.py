"""Ranks, metrics, folds and samples against brute force."""

import hashlib
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import sampling
from tablewright.operators.metrics import (
    auc,
    auc_spread,
    bootstrap_auc,
    classification_report,
    ks,
    poisson_limits,
    resample_weights,
)
from tablewright.operators.prep import medians
from tablewright.operators.running import distinct_ranks, running_sums
from tablewright.operators.sampling import hash_sample, stratified_folds
from tablewright.operators.screen import keep_count, screen_univariate, top_k, weakest


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg)) if pos and neg else None


def brute_ks(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    best, at = 0.0, 0.5
    for t in sorted({s for _, s in pairs}):
        gap = abs(sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg))
        if gap > best:
            best, at = gap, t
    return best, at


def scored(spark, pairs):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(pairs)], "id long, y int, s double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=60))
def test_report_against_brute_force(spark, pairs):
    pairs = [*pairs, (0, 3), (1, 3)]
    row = classification_report(scored(spark, pairs), "y", "s").first()
    best, at = brute_ks(pairs)
    assert row["auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)
    assert row["ks"] == pytest.approx(best, abs=1e-12) and row["threshold"] == at
    assert row["tp"] == sum(y == 1 and s >= at for y, s in pairs)
    assert row["fp"] == sum(y == 0 and s >= at for y, s in pairs)
    assert row["tp"] + row["fn"] == row["n_pos"] and row["fp"] + row["tn"] == row["n_neg"]


def test_ties_and_absent_class(spark):
    assert auc(scored(spark, [(0, 1), (1, 1)]), "y", "s").first()["auc"] == 0.5
    assert auc(scored(spark, [(1, 1), (1, 2)]), "y", "s").first()["auc"] is None
    row = ks(scored(spark, [(0, 1), (1, 1)]), "y", "s").first()
    assert row["ks"] == 0.0 and row["threshold"] == 0.5 and row["tp"] == 1 and row["fp"] == 1


def test_groups_and_missing_scores(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 1.0), ("b", 1, None), ("b", 1, float("nan"))],
        "g string, y int, s double",
    )
    assert {r["g"]: (r["auc"], r["n_pos"]) for r in auc(df, "y", "s", ["g"]).collect()} == {"a": (1.0, 1), "b": (0.0, 1)}


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), ("b", 0, 2.0), ("b", 1, 1.0)], "g string, y int, s double")
    assert {r["g"]: r["auc"] for r in auc(df, "y", "s", ["g"]).collect()} == {None: 1.0, "b": 0.0}


def test_rows_without_label_keep_a_fold(spark):
    df = spark.range(30).select("id", F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("y"))
    folds = stratified_folds(df, ["id"], "y")
    counts = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert folds.count() == 30 and len(counts) == 9 and all(3 <= n <= 4 for n in counts.values())


def test_running_sums_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        random.seed(3)
        values = [(g, v, random.randint(0, 9)) for g in "ab" for v in random.sample(range(10_000), 700)]
        df = spark.createDataFrame(values, "g string, v long, n long")
        out = running_sums(df, ["v"], ["n"], ["g"])
        got = {(r["g"], r["v"]): (r["n_upto"], r["n_total"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for g in "ab":
        total = sum(n for h, _, n in values if h == g)
        run = 0
        for _, v, n in sorted(x for x in values if x[0] == g):
            run += n
            want[g, v] = (run, total)
    assert got == want


def test_no_single_task_window(spark):
    df = spark.range(100).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    plan = running_sums(df, ["v"], ["n"])._jdf.queryExecution().executedPlan().toString()
    # Only the totals per range meet in one place; the rows themselves are windowed per range.
    lines = plan.splitlines()
    (single,) = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert "HashAggregate(keys=[_part" in lines[single + 1]
    rows = [i for i, line in enumerate(lines) if "Window" in line and "sum(n#" in line]
    assert rows and "hashpartitioning(_part" in plan


def test_distinct_ranks(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "b", "c", "B"]], "t string")
    assert {r["t"]: r["code"] for r in distinct_ranks(df, "t").collect()} == {"B": 0, "a": 1, "b": 2, "c": 3}


def test_medians(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 7), (10.0, None), (None, 9), (4.0, None)], "a double, b int")
    got = {r["feature"]: r["median"] for r in medians(df, ["a", "b"]).collect()}
    assert got == {"a": statistics.median([1, 2, 10, 4]), "b": 7.0}


def test_folds(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    folds = stratified_folds(df, ["id"], "y")
    counts = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert all(abs(n - (100 if y else 900) / 3) < 1 for (y, _), n in counts.items()) and len(counts) == 6
    again = stratified_folds(df.repartition(13), ["id"], "y")
    assert folds.exceptAll(again).count() == 0
    order = sorted(range(0, 1000, 10), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    want = {k: (n + 1) % 3 for n, k in enumerate(order)}
    assert {r["id"]: r["fold"] for r in folds.filter("y = 1").collect()} == want
    loose = stratified_folds(df, ["id"], "y", exact=False)
    assert loose.columns == folds.columns and loose.select("fold").distinct().count() == 3


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
@pytest.mark.parametrize("digits", [1, 3])
def test_hash_sample(spark, monkeypatch, n, digits):
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", digits)
    monkeypatch.setattr(sampling, "SPARE_ROWS", 2)
    df = spark.range(500)
    got = sorted(r["id"] for r in hash_sample(df, ["id"], n).collect())
    want = sorted(sorted(range(500), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())[:n])
    assert got == want


def test_resample_weights(spark):
    limits = poisson_limits()
    assert limits == sorted(limits) and int(limits[0], 16) / 16**6 == pytest.approx(0.367879, abs=1e-6)
    weights = resample_weights(spark.range(20_000), ["id"], ["id"], 7, 42)
    stats = weights.groupBy("replicate").agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).collect()
    assert len(stats) == 7 and all(abs(r["m"] - 1) < 0.05 and abs(r["v"] - 1) < 0.1 for r in stats)


def test_bootstrap_against_repeated_rows(spark):
    random.seed(5)
    df = scored(spark, [(random.randint(0, 1), random.randint(0, 20)) for _ in range(200)])
    drawn = resample_weights(df, ["id"], ["id", "y", "s"], 3, 42).collect()
    got = {r["replicate"]: r["auc"] for r in bootstrap_auc(df, ["id"], "y", "s", 3).collect()}
    for rep in range(3):
        pairs = [(r["y"], r["s"]) for r in drawn if r["replicate"] == rep for _ in range(r["w"])]
        assert got[rep] == pytest.approx(brute_auc(pairs), abs=1e-12)
    spread = auc_spread(bootstrap_auc(df, ["id"], "y", "s", 3)).first()
    assert spread["auc_std"] == pytest.approx(statistics.pstdev(got.values()))


def test_screening(spark):
    data = [(i % 2, float(i % 2), i, "ab"[i % 2], None) for i in range(60)]
    df = spark.createDataFrame(data, "y int, perfect double, noise long, text string, empty double")
    scores = screen_univariate(df, "y", ["noise", "perfect", "text", "empty"])
    got = {r["feature"]: r["auc"] for r in scores.collect()}
    assert got["perfect"] == 1.0 and got["text"] == 1.0 and 0.4 < got["noise"] < 0.6 and "empty" not in got
    assert [r["feature"] for r in top_k(scores, 2).collect()] == ["perfect", "text"]
    assert weakest(scores).first()["feature"] == "noise"
    binned = {r["feature"]: r["auc"] for r in screen_univariate(df, "y", ["noise", "perfect"], bins=4).collect()}
    assert binned["perfect"] == 1.0 and 0.4 < binned["noise"] < 0.6


@pytest.mark.parametrize(("n", "ratio", "k"), [(100, 0.25, 25), (10, 0.25, 5), (3, 0.25, 3), (40, 0.35, 14)])
def test_keep_count(n, ratio, k):
    assert keep_count(n, ratio) == k
