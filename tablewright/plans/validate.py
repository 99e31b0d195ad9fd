"""Checks of a plan against the tables, before any job runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import is_numeric, type_class
from tablewright.plans.spec import LATEST, OPS, FeaturePlan, FeatureSpec, PlanError


def _check_expr(df: DataFrame, text: str) -> str | None:
    """Let the analyzer judge an expression; nothing is executed."""
    try:
        df.select(F.expr(text))
    except AnalysisException as problem:
        return str(problem).split("\n", 1)[0]
    return None


def _check_window(plan: FeaturePlan, spec: FeatureSpec, df: DataFrame, time_column: str | None, owner: str) -> list[str]:
    """What keeps a spec's window from being computed."""
    name = spec.name
    if not spec.window_days:
        return []
    if spec.op == LATEST:
        return [f"{name}: LATEST takes no window"]
    if time_column is None:
        return [f"{name}: a window needs the {owner}'s time column"]
    if time_column not in df.columns:
        return [f"{name}: no time column {time_column!r} in {spec.table!r}"]
    if type_class(df.schema[time_column].dataType) == "datetime":
        return [] if plan.as_of else [f"{name}: a window over dates needs the plan's as_of"]
    if not is_numeric(df.schema[time_column].dataType):
        return [f"{name}: time column {time_column!r} is neither a date nor a number"]
    return []


def _check_spec(plan: FeaturePlan, spec: FeatureSpec, tables: Mapping[str, DataFrame]) -> list[str]:
    name, main = spec.name, plan.main
    if spec.op not in OPS:
        return [f"{name}: unknown operation {spec.op!r}"]
    if spec.table not in tables:
        return [f"{name}: unknown table {spec.table!r}"]
    df, out = tables[spec.table], []

    if spec.column is not None and spec.column not in df.columns:
        out.append(f"{name}: no column {spec.column!r} in {spec.table!r}")
    banned = {*plan.exclude, *main.key, *([main.label] if main.label else [])}
    if spec.column in banned:
        out.append(f"{name}: column {spec.column!r} is a key, the label or excluded")
    for text in (spec.expr, spec.predicate):
        problem = _check_expr(df, text) if text else None
        if problem:
            out.append(f"{name}: {problem}")
    if spec.column is None and spec.expr is None and spec.op not in ("COUNT", "RATE"):
        out.append(f"{name}: {spec.op} needs a column or an expression")
    if spec.op == "RATE" and not spec.predicate:
        out.append(f"{name}: RATE needs a predicate")

    if spec.table == main.table:
        if main.grain != "collapse" and spec.op != LATEST:
            out.append(f"{name}: only LATEST applies to the main table")
        if spec.op == LATEST:
            out += [f"{name}: no column {c!r} to order by" for c in spec.order_by if c not in df.columns]
        return out + _check_window(plan, spec, df, main.time_column, "main table")

    try:
        rel = plan.relationship(spec.table)
    except PlanError as problem:
        return [*out, f"{name}: {problem}"]
    if spec.column in rel.key:
        out.append(f"{name}: column {spec.column!r} is the join key")
    if spec.op == LATEST:
        if not spec.order_by and not rel.unique:
            out.append(f"{name}: LATEST on a table with many rows per key needs order_by")
        out += [f"{name}: no column {c!r} to order by" for c in spec.order_by if c not in df.columns]
    out += _check_window(plan, spec, df, rel.time_column, "relationship")
    if spec.op in ("SUM", "AVG") and spec.column in df.columns and not is_numeric(df.schema[spec.column].dataType):
        out.append(f"{name}: {spec.op} needs a numeric column")
    return out


def validate(plan: FeaturePlan, tables: Mapping[str, DataFrame]) -> list[str]:
    """Every rule the plan breaks, as text. An empty list means it can run."""
    main = plan.main
    if main.table not in tables:
        return [f"unknown main table {main.table!r}"]
    out: list[str] = []
    columns = tables[main.table].columns
    out += [f"no key column {c!r} in {main.table!r}" for c in main.key if c not in columns]
    if main.label and main.label not in columns:
        out.append(f"no label column {main.label!r} in {main.table!r}")
    if main.grain not in ("key", "row", "collapse"):
        out.append(f"unknown grain {main.grain!r}")
    out += [f"no passthrough column {c!r} in {main.table!r}" for c in plan.passthrough if c not in columns]

    for rel in plan.relationships:
        if rel.table not in tables:
            continue  # dropped: a relationship to an absent table is only an issue for specs that use it
        side = tables[rel.table]
        out += [f"no key column {c!r} in {rel.table!r}" for c in rel.key if c not in side.columns]
        out += [f"no key column {c!r} in {main.table!r}" for c in rel.main_key if c not in columns]
        if len(rel.key) != len(rel.main_key):
            out.append(f"relationship to {rel.table!r}: keys differ in length")
            continue
        for a, b in zip(rel.key, rel.main_key):
            if a in side.columns and b in columns:
                kinds = {type_class(side.schema[a].dataType), type_class(tables[main.table].schema[b].dataType)}
                if len(kinds) > 1 and kinds != {"integer", "number"}:
                    out.append(f"relationship to {rel.table!r}: {a!r} and {b!r} have unlike types")

    for table, text in plan.filters.items():
        if table not in tables:
            out.append(f"filter on unknown table {table!r}")
            continue
        problem = _check_expr(tables[table], text)
        if problem:
            out.append(f"filter on {table!r}: {problem}")

    for spec in plan.specs:
        out += _check_spec(plan, spec, tables)
    names = plan.feature_names()
    out += [f"feature name {n!r} is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
    kept = {*main.key, *plan.passthrough, *([main.label] if main.label else [])}
    out += [f"feature name {n!r} is a key, label or passthrough column" for n in names if n in kept]
    return out


def require_valid(plan: FeaturePlan, tables: Mapping[str, DataFrame]) -> None:
    issues = validate(plan, tables)
    if issues:
        raise PlanError("; ".join(issues))
