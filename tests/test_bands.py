"""Windows added up from bands give what one condition per window gives."""

import pytest
from pyspark.sql import functions as F

from tablewright.plans import compile as compiler
from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, Relationship


@pytest.fixture(scope="module")
def tables(spark):
    # One key holds half of all rows, some rows are late, some values are missing.
    n = F.col("id")
    fact = spark.range(4000).select(
        F.when(n % 2 == 0, 0).otherwise(n % 37).alias("fk"),
        F.when(n % 5 != 0, (F.pmod(F.xxhash64("id"), F.lit(1000)) / 4).cast("double")).alias("x"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).alias("kind"),
        F.expr("date_add(date '2024-06-30', cast(40 - pmod(xxhash64(id, 2), 200) as int))").alias("day"),
    )
    return {"m": spark.range(45), "f": fact}


def plan(null_sum="null", upper_bound=True):
    specs = [
        FeatureSpec(op, "f", "x", window_days=d, predicate=p, scale=2 if op in ("SUM", "AVG") else None)
        for op in ("SUM", "AVG", "COUNT", "MAX", "MIN")
        for d in (None, 5, 30, 90)
        for p in (None, "kind > 4")
        if not (d is None and p)
    ]
    specs += [FeatureSpec("RATE", "f", predicate="x > 100", window_days=d, alias=f"rate_{d}") for d in (None, 5, 90)]
    specs += [FeatureSpec("COUNT", "f", window_days=d, alias=f"rows_{d}") for d in (None, 30)]
    specs = [FeatureSpec(**{**s.__dict__, "alias": f"f{i}"}) for i, s in enumerate(specs)]
    rel = Relationship("f", "fk", "id", time_column="day")
    return FeaturePlan(MainSpec("m", "id"), specs, [rel], "2024-06-30", null_sum=null_sum, upper_bound=upper_bound)


@pytest.mark.parametrize(("null_sum", "upper_bound"), [("null", True), ("zero", False)])
def test_bands_and_conditions_agree(tables, monkeypatch, null_sum, upper_bound):
    wanted = build_wide_table(plan(null_sum, upper_bound), tables)
    assert "_band" not in wanted._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(compiler, "PASS_BUFFERS", 10)
    got = build_wide_table(plan(null_sum, upper_bound), tables)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_band" in text and wanted.schema == got.schema
    assert wanted.exceptAll(got).count() == 0 and got.exceptAll(wanted).count() == 0


def test_distinct_counts_per_window(tables):
    days = (None, 5, 30)
    specs = [FeatureSpec("COUNT_DISTINCT", "f", c, window_days=d, alias=f"{c}_{d}") for c in ("kind", "x") for d in days]
    specs += [FeatureSpec("COUNT_DISTINCT", "f", "kind", window_days=30, predicate="x > 100", alias="some_30")]
    p = FeaturePlan(MainSpec("m", "id"), specs, [Relationship("f", "fk", "id", time_column="day")], "2024-06-30")
    got = build_wide_table(p, tables)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {}
    for r in tables["f"].collect():
        rows.setdefault(r["fk"], []).append(r)
    as_of = __import__("datetime").date(2024, 6, 30)
    for r in got.collect():
        mine = rows.get(r["id"])
        for s in specs:
            inside = [x for x in mine or [] if s.window_days is None or 0 <= (as_of - x["day"]).days <= s.window_days]
            values = {x[s.column] for x in inside if x[s.column] is not None and (s.predicate is None or (x["x"] or 0) > 100)}
            assert r[s.alias] == (len(values) if inside else None)
