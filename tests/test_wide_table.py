"""Semantics of features on hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators.joins import group_feature, hot_keys, left_join_all, orphan_keys
from tablewright.plans import compile as compiler
from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, PlanError, Relationship

OPS = ("AVG", "SUM", "COUNT", "MAX", "MIN")


def wide(spark, main, fact, specs, rel=None, **kw):
    plan_args = {k: kw.pop(k) for k in ("as_of", "upper_bound", "null_sum", "filters", "passthrough") if k in kw}
    grain = kw.pop("grain", "key")
    plan = FeaturePlan(
        MainSpec("m", "k", grain=grain), specs, [rel or Relationship("f", "k", "k", time_column="days")], **plan_args
    )
    return build_wide_table(plan, {"m": main, "f": fact}, **kw)


def rows(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


def mains(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k long")


def test_null_key_never_matches(spark):
    fact = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (None, 9.0)], "k long, v double")
    got = rows(wide(spark, mains(spark, 1, 2, 3, None), fact, [FeatureSpec("SUM", "f", "v"), FeatureSpec("COUNT", "f")]))
    assert got[1]["SUM_f_v"] == 3.0 and got[2]["COUNT_f_rows"] == 1
    assert got[3]["SUM_f_v"] is None and got[3]["COUNT_f_rows"] is None
    assert got[None]["SUM_f_v"] is None


def test_all_null_group(spark):
    fact = spark.createDataFrame([(1, None), (1, None)], "k long, v double")
    specs = [FeatureSpec(op, "f", "v") for op in OPS]
    got = rows(wide(spark, mains(spark, 1), fact, specs))[1]
    assert got["COUNT_f_v"] == 0 and got["SUM_f_v"] is None and got["AVG_f_v"] is None
    zero = rows(wide(spark, mains(spark, 1, 2), fact, specs, null_sum="zero"))
    assert zero[1]["SUM_f_v"] == 0.0 and zero[2]["SUM_f_v"] is None


def test_nan_is_missing(spark):
    fact = spark.createDataFrame([(1, math.nan), (1, 4.0)], "k long, v double")
    got = rows(wide(spark, mains(spark, 1), fact, [FeatureSpec(op, "f", "v") for op in OPS]))[1]
    assert [got[f"{op}_f_v"] for op in OPS] == [4.0, 4.0, 1, 4.0, 4.0]


FACT = [(1, 1.0, -5), (1, 2.0, -40), (1, 4.0, 3), (1, 8.0, None), (2, 1.0, -400), (3, None, -1)]


@pytest.mark.parametrize("buffers", [3, 80])
def test_windows(spark, monkeypatch, buffers):
    monkeypatch.setattr(compiler, "PASS_BUFFERS", buffers)
    fact = spark.createDataFrame(FACT, "k long, v double, days int")
    specs = [FeatureSpec(op, "f", "v", w) for w in (10, 90) for op in OPS] + [FeatureSpec("SUM", "f", "v")]
    got = rows(wide(spark, mains(spark, 1, 2, 3), fact, specs))
    assert [got[1][f"{op}_f_v_10d"] for op in OPS] == [1.0, 1.0, 1, 1.0, 1.0]
    assert [got[1][f"{op}_f_v_90d"] for op in OPS] == [1.5, 3.0, 2, 2.0, 1.0]
    assert got[1]["SUM_f_v"] == 15.0
    assert [got[2][f"{op}_f_v_90d"] for op in OPS] == [None] * 5  # rows, but none in the window
    assert got[3]["COUNT_f_v_10d"] == 0 and got[3]["SUM_f_v_10d"] is None  # in the window, all missing
    future = rows(wide(spark, mains(spark, 1), fact, specs, upper_bound=False))[1]
    assert future["SUM_f_v_10d"] == 5.0 and future["COUNT_f_v_90d"] == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_window_over_dates(spark, kind):
    days = [(1, 1.0, "2024-01-31 23:59:59"), (1, 2.0, "2024-01-24 00:00:00"), (1, 4.0, "2024-01-23 23:59:59"), (1, 8.0, "2024-02-01 00:00:00")]
    fact = spark.createDataFrame(days, "k long, v double, t string").withColumn("t", F.col("t").cast(kind))
    rel = Relationship("f", "k", "k", time_column="t")
    got = rows(wide(spark, mains(spark, 1), fact, [FeatureSpec("SUM", "f", "v", 7)], rel, as_of=dt.date(2024, 1, 31)))[1]
    assert got["SUM_f_v_7d"] == 3.0


def test_many_aggregates_are_split_into_passes(spark, monkeypatch):
    monkeypatch.setattr(compiler, "PASS_BUFFERS", 2)
    fact = spark.createDataFrame([(1, 1.0, 2.0)], "k long, v double, w double")
    specs = [FeatureSpec(op, "f", c) for c in ("v", "w") for op in OPS]
    got = rows(wide(spark, mains(spark, 1), fact, specs))[1]
    assert got["SUM_f_v"] == 1.0 and got["MAX_f_w"] == 2.0 and len(got) == 11


def test_latest_tie_and_order(spark):
    fact = spark.createDataFrame([(1, 7, 1, "a"), (1, 7, 2, "b"), (1, 3, 9, "c"), (2, None, 1, "d")], "k long, t int, id int, s string")
    got = rows(wide(spark, mains(spark, 1, 2, 3), fact, [FeatureSpec("LATEST", "f", "s", order_by=("t", "id"))]))
    assert [got[k]["LATEST_f_s"] for k in (1, 2, 3)] == ["b", "d", None]


def test_grains(spark):
    main = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, "z")], "k long, a int, city string")
    fact = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    specs = [FeatureSpec("LATEST", "m", "a"), FeatureSpec("SUM", "f", "v")]
    with pytest.raises(PlanError, match="occurs 2 times"):
        wide(spark, main, fact, specs)
    by_row = wide(spark, main, fact, specs, grain="row").collect()
    assert sorted((r["k"], r["LATEST_m_a"], r["SUM_f_v"]) for r in by_row) == [(1, 10, 1.0), (1, 20, 1.0), (2, 5, 2.0)]
    one = rows(wide(spark, main, fact, specs, grain="collapse", passthrough=("city",)))
    assert one[1] == {"k": 1, "city": "y", "LATEST_m_a": 20, "SUM_f_v": 1.0}


def test_snapshot_must_be_unique(spark):
    fact = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, v double")
    with pytest.raises(PlanError, match="snapshot"):
        wide(spark, mains(spark, 1), fact, [FeatureSpec("LATEST", "f", "v")], Relationship("f", "k", "k", unique=True))


def test_composite_key(spark):
    main = spark.createDataFrame([(1, "a"), (1, "b")], "k long, p string")
    fact = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (1, "b", 5.0)], "fk long, fp string, v double")
    plan = FeaturePlan(
        MainSpec("m", ("k", "p")), [FeatureSpec("SUM", "f", "v")], [Relationship("f", ("fk", "fp"), ("k", "p"))]
    )
    got = {r["p"]: r["SUM_f_v"] for r in build_wide_table(plan, {"m": main, "f": fact}).collect()}
    assert got == {"a": 3.0, "b": 9.0}


def test_scoring_keeps_the_promised_columns(spark):
    fact = spark.createDataFrame([(1, 1.0)], "k long, v double")
    specs = [FeatureSpec("SUM", "f", "v"), FeatureSpec("MAX", "f", "gone"), FeatureSpec("LATEST", "m", "also_gone")]
    with pytest.raises(PlanError, match="gone"):
        wide(spark, mains(spark, 1), fact, specs)
    got = wide(spark, mains(spark, 1), fact, specs, scoring=True)
    assert got.columns == ["k", "SUM_f_v", "MAX_f_gone", "LATEST_m_also_gone"]
    assert got.first().asDict() == {"k": 1, "SUM_f_v": 1.0, "MAX_f_gone": None, "LATEST_m_also_gone": None}


def test_exact_sums(spark):
    fact = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, -0.25)] * 10, "k long, v double")
    got = rows(wide(spark, mains(spark, 1), fact, [FeatureSpec(op, "f", "v", scale=2) for op in ("SUM", "AVG")]))[1]
    assert got["SUM_f_v"] == 0.5 and got["AVG_f_v"] == 0.5 / 30


@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, null_safe):
    main = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 100).cast("int").alias("k")
    )
    side = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(main, ["k"], task_rows=10)
    assert len(hot) == 2 and all(8 < pieces <= 16 for _, pieces in hot)  # the hot key and the null key
    salted = left_join_all(main, [side], ["k"], hot, null_safe)
    plain = left_join_all(main, [side], ["k"], (), null_safe)
    assert salted.count() == 6000
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hot_rows_are_spread(spark):
    main = spark.range(8000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    side = spark.range(8000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_join_all(main, [side], ["k"], hot_keys(main, ["k"], task_rows=10))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000 and max(sizes) < 2000  # one task would hold 2667 rows of the hot key alone


def test_group_feature_with_null_groups(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0)], "k long, g string, v double")
    got = rows(group_feature(df, ["g"], "mean", F.avg("v"), task_rows=0))
    assert [got[k]["mean"] for k in (1, 2, 3)] == [2.0, 2.0, 5.0]


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "fk long")
    parent = spark.createDataFrame([(1,), (1,)], "pk long")
    assert orphan_keys(child, parent, "fk", "pk", "r").first().asDict() == {"relation": "r", "orphan_keys": 1, "orphan_rows": 2}


def test_windowed_scan_is_pushed_down(spark, sf):
    plan = FeaturePlan(
        MainSpec("customer", "c_custkey"),
        [FeatureSpec("MAX", "orders", "o_totalprice", 30)],
        [Relationship("orders", "o_custkey", "c_custkey", time_column="o_orderdate")],
        "2001-08-01",
    )
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders")}
    text = build_wide_table(plan, tables)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_orderpriority" not in text and "SortAggregate" not in text
