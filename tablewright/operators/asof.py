"""Features as of a date of each sample row: the latest state before it, and trailing windows that end on it.

Facts and sample rows are put in one order by key and time and dealt out by ranges of it. Within a
range the last fact's state is carried to the samples after it, or a running sum is; what a range
brings to the next one is joined on. A key with very many rows is so cut into ranges of time, and a
window is the difference of two running sums, whatever its length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted, sql_name, sql_no_nan, sql_whole
from tablewright.operators.joins import not_null
from tablewright.operators.running import PART, carried_over, in_ranges, running_sums, with_carried
from tablewright.plans.spec import PlanError
from tablewright.session import materialise

SUMMED = ("SUM", "COUNT", "AVG")


def _keys(key: Sequence[str]) -> list[Column]:
    return [quoted(k).alias(f"_k{i}") for i, k in enumerate(key)]


def _checked(key: Sequence[str], fact_key: Sequence[str]) -> list[str]:
    if len(key) != len(fact_key) or not key:
        raise PlanError(f"keys {list(key)} and {list(fact_key)} do not pair up")
    return [f"_k{i}" for i in range(len(key))]


def asof_latest(
    samples: DataFrame,
    facts: DataFrame,
    key: Sequence[str],
    fact_key: Sequence[str],
    sample_time: str,
    fact_time: str,
    values: Mapping[str, str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The samples with the values of the last fact of their key at or before their time.

    ``values`` maps new names to SQL of a fact's value; ``order_by`` decides between facts of one time.
    Samples without a key, a time or an earlier fact get nulls; facts without key or time match nothing.
    """
    group = _checked(key, fact_key)
    state = F.struct(*[F.expr(text).alias(name) for name, text in values.items()])
    tie = F.struct(*[quoted(c) for c in order_by]) if order_by else F.struct(F.lit(0))
    known = not_null(facts, [*fact_key, fact_time]).select(
        *_keys(fact_key), quoted(fact_time).alias("_time"), F.lit(0).alias("_side"), tie.alias("_tie"), state.alias("_state")
    )
    row = F.struct(*[quoted(c) for c in samples.columns])
    asked = samples.select(*_keys(key), quoted(sample_time).alias("_time"), F.lit(1).alias("_side"), row.alias("_row"))
    placed = in_ranges(known.unionByName(asked, allowMissingColumns=True), [*group, "_time", "_side", "_tie"])

    newest = F.max(F.when(F.col("_side") == 0, F.struct("_time", "_tie", "_state")))
    carried = carried_over(placed.groupBy(PART, *group).agg(newest.alias("_newest")), group, {"_carried": F.last("_newest", ignorenulls=True)})
    before = Window.partitionBy(PART, *group).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = with_carried(placed, carried, group).withColumn("_own", F.last("_state", ignorenulls=True).over(before))
    nothing = F.lit(False)
    for c in [*group, "_time"]:
        nothing = nothing | F.col(c).isNull()
    found = F.when(~nothing, F.coalesce("_own", F.col("_carried._state")))
    return (
        own.filter("_side = 1")
        .select("_row", found.alias("_found"))
        .select(
            *[F.col("_row").getField(c).alias(c) for c in samples.columns],
            *[F.col("_found").getField(name).alias(name) for name in values],
        )
    )


def asof_windows(
    samples: DataFrame,
    facts: DataFrame,
    key: Sequence[str],
    fact_key: Sequence[str],
    sample_time: str,
    fact_time: str,
    features: Mapping[str, tuple[str, str | None, int]],
    scale: int = 2,
) -> DataFrame:
    """The samples with sums, counts and averages over the days that end at their time.

    ``features`` maps new names to (SUM, COUNT or AVG; column, or None for rows; days). A window of N
    days holds facts from N days before the sample's time to that time. Values are added as whole
    numbers of ``scale`` decimals, so differences of running sums are exact. A window without rows
    gives null, as does a sample without key or time; one without values gives COUNT 0 and no sum.
    """
    group = _checked(key, fact_key)
    wrong = [f"{n}: {op}" for n, (op, _, _) in features.items() if op not in SUMMED]
    if wrong:
        raise PlanError(f"only {SUMMED} can be read off running sums, not {wrong}")
    columns = list(dict.fromkeys(c for _, c, _ in features.values() if c is not None))
    days = sorted({d for _, _, d in features.values()})
    # Rows are numbered once they are written, so that numbers stay.
    rows = materialise(samples).withColumn("_id", F.monotonically_increasing_id())
    sums = ["_n", *[f"{kind}{i}" for i in range(len(columns)) for kind in ("_s", "_c")]]
    values = [sql_no_nan(sql_name(c), facts.schema[c].dataType) for c in columns]
    known = not_null(facts, [*fact_key, fact_time]).select(
        *_keys(fact_key),
        quoted(fact_time).cast("timestamp").alias("_time"),
        F.lit(0).alias("_side"),
        F.lit(1).alias("_n"),
        *[F.expr(f"coalesce({sql_whole(v, scale)}, 0L) AS _s{i}") for i, v in enumerate(values)],
        *[F.expr(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END AS _c{i}") for i, v in enumerate(values)],
    )
    # A sample asks for the sums after all facts of its time, and before those at the start of each window.
    starts = F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("s")), *[F.struct(F.lit(d).alias("d"), F.lit(-1).alias("s")) for d in days])
    asked = not_null(rows, [*key, sample_time]).select("_id", *_keys(key), quoted(sample_time).cast("timestamp").alias("_t"), F.explode(starts).alias("_at"))
    asked = asked.select("_id", *group, F.expr("_t - make_dt_interval(_at.d) AS _time"), F.col("_at.s").alias("_side"), F.col("_at.d").alias("_days"))
    both = known.unionByName(asked, allowMissingColumns=True).fillna(0, sums).withColumn("_tie", F.monotonically_increasing_id())
    upto = running_sums(both, ["_time", "_side", "_tie"], sums, group, totals=False).filter("_side != 0")

    def inside(total: str, d: int) -> str:
        return f"sum(CASE WHEN _side = 1 THEN {total}_upto WHEN _days = {d} THEN -{total}_upto END)"

    parts = {f"{s}_{d}": F.expr(inside(s, d)) for s in sums for d in days}
    per_sample = upto.groupBy("_id").agg(*[v.alias(n) for n, v in parts.items()])
    chosen = []
    for name, (op, column, d) in features.items():
        if column is None:
            chosen.append(F.expr(f"nullif(_n_{d}, 0) AS {sql_name(name)}"))
            continue
        i = columns.index(column)
        total, count = f"_s{i}_{d} / {10**scale}.0D", f"_c{i}_{d}"
        text = {"SUM": f"CASE WHEN {count} > 0 THEN {total} END", "COUNT": count, "AVG": f"CASE WHEN {count} > 0 THEN {total} / {count} END"}[op]
        chosen.append(F.expr(f"CASE WHEN _n_{d} > 0 THEN {text} END AS {sql_name(name)}"))
    return rows.join(per_sample, "_id", "left").select(*[quoted(c) for c in samples.columns], *chosen)
