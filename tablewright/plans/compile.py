"""From a feature plan to one DataFrame.

Every related table is scanned once per batch of columns and reduced to one row
per key before it is joined, so no join multiplies rows and a key with many rows
costs one partial row per map task. The last step is a single projection in plan
order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tablewright.functions.columns import is_numeric, quoted, sql_name, sql_no_nan, type_class
from tablewright.operators.aggregates import feature_aggregate
from tablewright.operators.joins import hot_keys, latest_per_key, left_join_all, not_null, require_unique
from tablewright.plans.bands import banded, distinct_counts, window_days
from tablewright.plans.spec import (
    LATEST,
    FeaturePlan,
    FeatureSpec,
    MainSpec,
    PlanError,
    Relationship,
    short_aliases,
)
from tablewright.plans.validate import require_valid

# Aggregation buffers per pass. Beyond about 100 fields Spark gives up whole-stage
# code generation for a node.
PASS_BUFFERS = 80

# What each operation keeps per key while adding up.
BUFFERS = {"AVG": ("sum", "count"), "RATE": ("rows", "matched"), "COUNT": ("count", "rows")}

Numbered = list[tuple[int, FeatureSpec]]


def _feature(i: int) -> str:
    return f"_f{i}"


def window_bounds(rel: Relationship | MainSpec, df: DataFrame, plan: FeaturePlan, days: int) -> str:
    """SQL for rows at most ``days`` before the sample date, as bounds on the time column itself.

    Comparing the raw column (rather than a day difference) lets the scan skip
    row groups.
    """
    time, dtype = sql_name(rel.time_column), df.schema[rel.time_column].dataType
    if type_class(dtype) == "datetime":
        first, after = (
            f"CAST('{(plan.as_of + dt.timedelta(days=d)).isoformat()}' AS {dtype.simpleString()})" for d in (-days, 1)
        )
        upper = f" AND {time} < {after}"
    else:
        first, upper = f"{-days}", f" AND {time} <= 0"
    return f"{time} >= {first}{upper if plan.upper_bound else ''}"


def _value(spec: FeatureSpec, df: DataFrame) -> str | None:
    if spec.expr:
        return f"({spec.expr})"
    if spec.column is None:
        return None
    return sql_no_nan(sql_name(spec.column), df.schema[spec.column].dataType)


def _latest_value(spec: FeatureSpec, df: DataFrame) -> str:
    """SQL for a row's value, null where the predicate does not hold."""
    value = _value(spec, df)
    return f"CASE WHEN {spec.predicate} THEN {value} END" if spec.predicate else value


def _fixed_width(spec: FeatureSpec, df: DataFrame) -> bool:
    """Whether the aggregate's buffer can stay in a hash map (text maxima cannot)."""
    if spec.op not in ("MAX", "MIN"):
        return True
    dtype = df.selectExpr(spec.expr).schema[0].dataType if spec.expr else df.schema[spec.column].dataType
    return is_numeric(dtype) or type_class(dtype) != "string"


def _decimal(spec: FeatureSpec, df: DataFrame) -> bool:
    """Whether averages would be decimals, whose digits depend on the way they are added up."""
    value = _value(spec, df)
    return spec.op == "AVG" and value is not None and isinstance(df.selectExpr(value).schema[0].dataType, DecimalType)


def _buffers(specs: Numbered) -> set[tuple]:
    """Distinct buffers of a set of specs: equal ones are kept once."""
    return {
        (kind, s.column, s.expr, s.predicate, s.window_days)
        for _, s in specs
        for kind in BUFFERS.get(s.op, (s.op.lower(),))
    }


def _batches(specs: Numbered) -> Iterable[Numbered]:
    """Batches that fit one pass, specs over the same column together so that passes read disjoint columns."""
    batch: Numbered = []
    for item in sorted(specs, key=lambda s: (s[1].column or s[1].expr or "", s[0])):
        if batch and len(_buffers([*batch, item])) > PASS_BUFFERS:
            yield batch
            batch = []
        batch.append(item)
    if batch:
        yield batch


def _single_pass(fact: DataFrame, key: Sequence[str], specs: Numbered, rel: Relationship, plan: FeaturePlan) -> DataFrame:
    """One aggregation; windows are conditions inside the aggregates."""
    columns = []
    for i, spec in specs:
        in_window = window_bounds(rel, fact, plan, spec.window_days) if spec.window_days else None
        aggregate = feature_aggregate(spec, _value(spec, fact), in_window, plan.null_sum)
        columns.append(F.expr(f"{aggregate} AS {_feature(i)}"))
    return fact.groupBy(*[quoted(k) for k in key]).agg(*columns)


def _per_key(df: DataFrame, key: Sequence[str], specs: Numbered, rel: Relationship, plan: FeaturePlan) -> list[DataFrame]:
    """Frames with one row per key that together hold all features of a table."""
    out: list[DataFrame] = []
    latest: dict[tuple, Numbered] = {}
    distinct: dict[str, Numbered] = {}
    hashed: Numbered = []
    others: Numbered = []
    for i, spec in specs:
        if spec.op == LATEST:
            latest.setdefault((spec.order_by, spec.predicate if spec.order_by else None), []).append((i, spec))
        elif spec.op == "COUNT_DISTINCT":
            distinct.setdefault(_latest_value(spec, df), []).append((i, spec))
        elif not _fixed_width(spec, df):
            others.append((i, spec))
        else:
            hashed.append((i, spec))

    fact = not_null(df, key)

    def bounds(days: int) -> str:
        return window_bounds(rel, fact, plan, days)

    def within_longest(group: Numbered) -> DataFrame:
        return fact.filter(F.expr(bounds(max(window_days(group))))) if all(s.window_days for _, s in group) else fact

    for group in (hashed, others):
        batches = list(_batches(group))
        # More than one pass holds, because of many windows: one pass over bands instead.
        if len(batches) > 1 and len(window_days(group)) > 1 and not any(_decimal(s, df) for _, s in group):
            out.append(banded(within_longest(group), key, group, lambda s: _value(s, fact), bounds, _feature, plan.null_sum))
        else:
            out += [_single_pass(within_longest(group), key, batch, rel, plan) for batch in batches]
    for value, group in distinct.items():
        out.append(distinct_counts(within_longest(group), key, group, value, bounds, _feature))

    for (order_by, predicate), group in latest.items():
        if order_by:
            out.append(latest_per_key(fact, key, order_by, {_feature(i): _value(s, df) for i, s in group}, predicate))
        else:
            out.append(fact.selectExpr(*map(sql_name, key), *[f"{_latest_value(s, df)} AS {_feature(i)}" for i, s in group]))
    return out


def _collapsed_main(base: DataFrame, plan: FeaturePlan, specs: Numbered, label: Sequence[str]) -> DataFrame:
    """One row per main key: passthrough columns and unordered LATEST as maxima."""
    key = list(plan.main.key)
    plain = {c: f"max({sql_name(c)}) AS {sql_name(c)}" for c in [*plan.passthrough, *label]}
    for i, spec in specs:
        if spec.op == LATEST and not spec.order_by:
            plain[_feature(i)] = f"max({_latest_value(spec, base)}) AS {_feature(i)}"
        elif spec.op != LATEST:
            in_window = window_bounds(plan.main, base, plan, spec.window_days) if spec.window_days else None
            plain[_feature(i)] = f"{feature_aggregate(spec, _value(spec, base), in_window, plan.null_sum)} AS {_feature(i)}"
    out = not_null(base, key).groupBy(*key).agg(*[F.expr(e) for e in plain.values() or ["count(1) AS _rows"]])
    ordered = [(i, s) for i, s in specs if s.op == LATEST and s.order_by]
    for order_by, predicate in dict.fromkeys((s.order_by, s.predicate) for _, s in ordered):
        values = {_feature(i): _value(s, base) for i, s in ordered if (s.order_by, s.predicate) == (order_by, predicate)}
        out = out.join(latest_per_key(not_null(base, key), key, order_by, values, predicate), key, "left")
    return out


def build_wide_table(
    plan: FeaturePlan,
    tables: Mapping[str, DataFrame],
    bindings: Mapping[str, str] | None = None,
    where: Mapping[str, str] | str | None = None,
    short_alias: bool = False,
    keep_label: bool = True,
    scoring: bool = False,
    check_grain: bool = True,
) -> DataFrame:
    """Key, label, passthrough columns and all features, in plan order.

    ``bindings`` maps table names of the plan to names in ``tables``. ``where`` is
    one condition for every table or one per table, applied before anything is
    aggregated. ``scoring`` drops the label and yields null for a column that the
    data does not have, where training raises. ``check_grain`` verifies that the
    main key and unique relationships hold one row per key.
    """
    bound = {name: tables[name] for name in tables}
    for logical, physical in (bindings or {}).items():
        if physical not in tables:
            raise PlanError(f"{logical!r} is bound to unknown table {physical!r}")
        bound[logical] = tables[physical]

    numbered = list(enumerate(plan.specs))
    missing: set[int] = set()
    if scoring:
        missing = {
            i for i, s in numbered if s.column is not None and s.table in bound and s.column not in bound[s.table].columns
        }
    label = [plan.main.label] if plan.main.label and keep_label and not scoring else []
    checked = plan.with_specs(s for i, s in numbered if i not in missing)
    if scoring and plan.main.label and plan.main.label not in bound[plan.main.table].columns:
        checked = replace(checked, main=replace(plan.main, label=None))
    require_valid(checked, bound)

    def source(name: str) -> DataFrame:
        df = bound[name]
        conditions = [plan.filters.get(name), where if isinstance(where, str) else (where or {}).get(name)]
        for text in conditions:
            df = df.filter(F.expr(text)) if text else df
        return df

    present = [(i, s) for i, s in numbered if i not in missing]
    main, key = plan.main, list(plan.main.key)
    base = source(main.table)
    own = [(i, s) for i, s in present if s.table == main.table]
    others: dict[str, Numbered] = {}
    for i, s in present:
        if s.table != main.table:
            others.setdefault(s.table, []).append((i, s))
    foreign = [c for t in others for c in plan.relationship(t).main_key]

    if main.grain == "collapse":
        if any(c not in key for c in foreign):
            raise PlanError("a collapsed main table joins on its own key only")
        out = _collapsed_main(base, plan, own, label)
    else:
        if check_grain and main.grain == "key":
            require_unique(base, key, f"main table {main.table!r}")
        carried = list(dict.fromkeys([*key, *foreign, *label, *plan.passthrough]))
        out = base.selectExpr(*map(sql_name, carried), *[f"{_latest_value(s, base)} AS {_feature(i)}" for i, s in own])

    frames: dict[tuple[str, ...], list[DataFrame]] = {}
    for name, specs in others.items():
        rel = plan.relationship(name)
        side = source(name)
        if check_grain and rel.unique and any(s.op == LATEST and not s.order_by for _, s in specs):
            require_unique(side, rel.key, f"snapshot table {name!r}")
        renames = dict(zip(rel.key, rel.main_key))
        frames.setdefault(rel.main_key, []).extend(
            frame.withColumnsRenamed(renames) for frame in _per_key(side, rel.key, specs, rel, plan)
        )
    # Every frame has one row per key. Joins on the main key itself cannot be skewed
    # unless rows repeat it; any other key may be, and its rows are then spread.
    # The main key comes last: rows are still narrow when they move for another key.
    for on, sides in sorted(frames.items(), key=lambda f: f[0] == main.key):
        even = on == main.key and main.grain != "row"
        out = left_join_all(out, sides, on, () if even else hot_keys(base, on))

    names = plan.feature_names()
    shown = list(short_aliases(names)) if short_alias else names
    features = [
        f"{'CAST(NULL AS DOUBLE)' if i in missing else _feature(i)} AS {sql_name(shown[i])}" for i, _ in numbered
    ]
    kept = list(dict.fromkeys([*key, *label, *plan.passthrough]))
    return out.selectExpr(*map(sql_name, kept), *features)
