"""As-of features against a plain loop, with a key that holds most rows and ranges cut through it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators.asof import asof_latest, asof_windows
from tablewright.operators.running import PART, in_ranges, running_sums
from tablewright.plans.spec import PlanError

DAY0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module", autouse=True)
def small_ranges_stay(spark):
    """Adaptive execution would put these few rows into one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


@pytest.fixture(scope="module")
def data():
    facts = [(7 if i % 3 else i % 5, DAY0 + dt.timedelta(hours=(i * 7919) % 2400), i, None if i % 11 == 0 else (i * 31 % 997) / 4) for i in range(900)]
    facts += [(None, DAY0, 9001, 1.0), (7, None, 9002, 1.0), (2, DAY0 + dt.timedelta(hours=5), 9003, 5.0), (2, DAY0 + dt.timedelta(hours=5), 9004, 6.0)]
    samples = [(i, 7 if i % 2 else i % 6, DAY0 + dt.timedelta(hours=(i * 577) % 2500 - 24), "text") for i in range(300)]
    samples += [(900, None, DAY0, "a"), (901, 7, None, "b"), (902, 50, DAY0, "c"), (903, 2, DAY0 + dt.timedelta(hours=5), "d"), samples[5]]
    return samples, facts


@pytest.fixture(scope="module")
def frames(spark, data):
    samples, facts = data
    s = spark.createDataFrame(samples, "id long, user long, at timestamp, _row string").repartition(3)
    return s, spark.createDataFrame(facts, "user long, at timestamp, number long, x double").repartition(4)


def test_latest(data, frames):
    samples, facts = data
    got = asof_latest(*frames, ["user"], ["user"], "at", "at", {"last_x": "x", "last_number": "number * 2"}, ["number"])
    assert got.columns == ["id", "user", "at", "_row", "last_x", "last_number"]
    rows = got.collect()
    assert len(rows) == len(samples)
    for r in rows:
        mine = [f for f in facts if None not in (r["user"], r["at"], f[0], f[1]) and f[0] == r["user"] and f[1] <= r["at"]]
        last = max(mine, key=lambda f: (f[1], f[2])) if mine else None
        assert (r["last_x"], r["last_number"]) == ((last[3], last[2] * 2) if last else (None, None))


def test_windows(data, frames):
    samples, facts = data
    features = {f"{op}_{c}_{d}": (op, c, d) for d in (0, 2, 30) for op, c in (("COUNT", None), ("COUNT", "x"), ("SUM", "x"), ("AVG", "x"))}
    rows = asof_windows(*frames, ["user"], ["user"], "at", "at", features).collect()
    assert len(rows) == len(samples)
    for r in rows:
        for name, (op, c, d) in features.items():
            mine = [
                f[3]
                for f in facts
                if None not in (r["user"], r["at"], f[0], f[1]) and f[0] == r["user"] and r["at"] - dt.timedelta(days=d) <= f[1] <= r["at"]
            ]
            present = [x for x in mine if x is not None]
            want = {"COUNT": len(mine) if c is None else len(present), "SUM": sum(present) if present else None, "AVG": sum(present) / len(present) if present else None}[op]
            assert r[name] == (pytest.approx(want) if mine else None), (name, r)


def test_hot_key_is_cut(spark, frames):
    """Ranges cut the key with most rows, so that it is no single task's."""
    placed = in_ranges(frames[1], ["user", "at", "number"])
    assert placed.filter("user = 7").select(PART).distinct().count() > 2


def test_empty_and_wrong(spark, frames):
    samples, facts = frames
    none = asof_latest(samples, facts.limit(0), ["user"], ["user"], "at", "at", {"v": "x"})
    assert none.count() == samples.count() and none.filter("v is not null").count() == 0
    assert asof_latest(samples.limit(0), facts, ["user"], ["user"], "at", "at", {"v": "x"}).count() == 0
    assert asof_windows(samples.limit(0), facts, ["user"], ["user"], "at", "at", {"v": ("SUM", "x", 3)}).count() == 0
    assert asof_windows(samples, facts.limit(0), ["user"], ["user"], "at", "at", {"v": ("SUM", "x", 3)}).filter(F.col("v").isNotNull()).count() == 0
    with pytest.raises(PlanError):
        asof_windows(samples, facts, ["user"], ["user"], "at", "at", {"v": ("MAX", "x", 3)})
    with pytest.raises(PlanError):
        asof_latest(samples, facts, ["user"], [], "at", "at", {"v": "x"})


def test_running_sums_over_cut_groups(spark):
    rows = [(i, None if i % 4 == 0 else i % 3 if i % 2 else 9, i % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g long, n long")
    for totals in (True, False):
        got = running_sums(df, ["id"], ["n"], ["g"], totals).collect()
        assert len(got) == 500
        for r in got:
            mine = [n for i, g, n in rows if g == r["g"]]
            assert r["n_upto"] == sum(n for i, g, n in rows if g == r["g"] and i <= r["id"])
            assert not totals or r["n_total"] == sum(mine)
    whole = running_sums(df, ["id"], ["n"]).collect()
    assert all(r["n_upto"] == sum(n for i, _, n in rows if i <= r["id"]) and r["n_total"] == sum(n for *_, n in rows) for r in whole)
