"""Feature plans as JSON, with what is needed to run them again."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, fields
from pathlib import Path

from pyspark.sql import SparkSession

from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, PlanError, Relationship

# Kinds of entries in a plan file. Fixed values.
FEATURE_KIND, MODEL_KIND, FILTER_KIND = "FeatureGene", "ModelGene", "FilterGene"


def _bare(value: object) -> dict:
    return {k: v for k, v in asdict(value).items() if v not in (None, (), "")}


def plan_to_dict(plan: FeaturePlan, model: Mapping | None = None) -> dict:
    entries = [{"_type": FEATURE_KIND, "path": f"{s.table}.{s.column or ''}", **_bare(s)} for s in plan.specs]
    if model:
        entries.append({"_type": MODEL_KIND, **model})
    return {
        "meta": {
            "join_key": list(plan.main.key),
            "main_table": plan.main.table,
            "target_column": plan.main.label,
            "grain": plan.main.grain,
            "time_column": plan.main.time_column,
            "as_of": plan.as_of.isoformat() if plan.as_of else None,
            "upper_bound": plan.upper_bound,
            "null_sum": plan.null_sum,
            "filters": dict(plan.filters),
            "exclude": list(plan.exclude),
            "passthrough": list(plan.passthrough),
            "relationships": [_bare(r) for r in plan.relationships],
        },
        "genes": entries,
    }


def _spec(entry: Mapping) -> FeatureSpec:
    known = {f.name for f in fields(FeatureSpec)}
    values = {k: v for k, v in entry.items() if k in known}
    if "table" not in values:  # the short form names table and column as one path
        table, _, column = entry["path"].partition(".")
        values |= {"table": table, "column": column or None, "window_days": entry.get("window")}
    return FeatureSpec(**values)


def _filter(condition: str, tables: set[str]) -> tuple[str, str]:
    """Table and condition over its own columns, from a condition that writes them as table.column."""
    outside = re.split(r"('(?:[^']|'')*')", condition)  # texts in quotes stay as they are
    named = {t for part in outside[::2] for t in tables if re.search(rf"(?<![\w.]){re.escape(t)}\.", part)}
    if len(named) != 1:
        raise PlanError(f"filter {condition!r} must name the columns of one table, found {sorted(named)}")
    table = named.pop()
    outside[::2] = [re.sub(rf"(?<![\w.]){re.escape(table)}\.", "", part) for part in outside[::2]]
    return table, "".join(outside)


def plan_from_dict(raw: Mapping) -> tuple[FeaturePlan, dict | None]:
    """The plan and the model entry, if any.

    Filter entries join the filters of the table that their condition names; an entry of another
    kind is refused, as leaving it out would change the result.
    """
    meta = raw["meta"]
    unknown = sorted({e["_type"] for e in raw["genes"]} - {FEATURE_KIND, MODEL_KIND, FILTER_KIND})
    if unknown:
        raise PlanError(f"entries of unknown kinds: {unknown}")
    filters = dict(meta.get("filters", {}))
    tables = {meta["main_table"], *(r["table"] for r in meta.get("relationships", []))}
    for entry in raw["genes"]:
        if entry["_type"] == FILTER_KIND:
            table, text = _filter(entry["condition"], tables)
            filters[table] = f"({filters[table]}) AND ({text})" if table in filters else text
    specs = [_spec(e) for e in raw["genes"] if e["_type"] == FEATURE_KIND]
    models = [{k: v for k, v in e.items() if k != "_type"} for e in raw["genes"] if e["_type"] == MODEL_KIND]
    plan = FeaturePlan(
        MainSpec(meta["main_table"], meta["join_key"], meta.get("target_column"), meta.get("grain", "key"), meta.get("time_column")),
        specs,
        [Relationship(**r) for r in meta.get("relationships", [])],
        meta.get("as_of"),
        filters,
        meta.get("exclude", ()),
        meta.get("passthrough", ()),
        meta.get("upper_bound", True),
        meta.get("null_sum", "null"),
    )
    return plan, models[0] if models else None


def save_plan(plan: FeaturePlan, path: str, model: Mapping | None = None, spark: SparkSession | None = None) -> None:
    """Write the plan to a file of the driver or, with ``spark``, to storage the cluster shares."""
    text = json.dumps(plan_to_dict(plan, model), ensure_ascii=False, indent=None if spark else 2)
    if spark is None:
        Path(path).write_text(text, encoding="utf-8")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_plan(path: str, spark: SparkSession | None = None) -> tuple[FeaturePlan, dict | None]:
    if spark is None:
        return plan_from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
    return plan_from_dict(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
