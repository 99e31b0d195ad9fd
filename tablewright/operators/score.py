"""Batch scoring of raw tables and of wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted, to_number
from tablewright.operators.boosting import BoostedModel
from tablewright.operators.model import model_scores
from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan

# Probability above which a row is predicted positive when no threshold is given.
# Fixed value.
DEFAULT_THRESHOLD = 0.5


def restore_names(df: DataFrame, alias_map: Mapping[str, str]) -> DataFrame:
    """Short column names back to the long ones."""
    return df.withColumnsRenamed(dict(alias_map))


def align_features(
    df: DataFrame,
    whitelist: Sequence[str],
    alias_map: Mapping[str, str] | None = None,
    fill: float | None = 0.0,
    carry: Sequence[str] = (),
    text: Sequence[str] = (),
) -> DataFrame:
    """Exactly the columns the model expects, in its order.

    Short names are restored; an absent column or a value that is no number
    becomes ``fill`` (or null). Columns named in ``text`` stay text. Works on a
    stream as well.
    """
    if alias_map and any(c in alias_map for c in df.columns):
        df = restore_names(df, alias_map)
    present, as_text = set(df.columns), set(text)

    def one(name: str):
        if name in as_text:
            return quoted(name).cast("string") if name in present else F.lit(None).cast("string")
        value = to_number(quoted(name)) if name in present else F.lit(None).cast("double")
        return value if fill is None else F.coalesce(value, F.lit(float(fill)))

    return df.select(*[quoted(c) for c in carry], *[one(c).alias(c) for c in whitelist])


def with_prediction(scored: DataFrame, score: str, threshold: float = DEFAULT_THRESHOLD, strict: bool = True) -> DataFrame:
    """Add ``prediction``: score > threshold, or >= when not strict."""
    hit = quoted(score) > threshold if strict else quoted(score) >= threshold
    return scored.withColumn("prediction", hit.cast("int"))


def score_wide(
    df: DataFrame,
    model: BoostedModel,
    key: Sequence[str],
    features: Sequence[str],
    alias_map: Mapping[str, str] | None = None,
    fill: float | None = None,
    text: Sequence[str] = (),
) -> DataFrame:
    """Key and ``p_value`` from a wide table, batch or stream.

    Missing numbers stay missing as in ``score_raw``; ``fill`` puts a value in their place.
    """
    aligned = align_features(df, features, alias_map, fill, key, text)
    return model_scores(aligned, model, features, key, "p_value")


def score_raw(
    plan: FeaturePlan,
    tables: Mapping[str, DataFrame],
    model: BoostedModel,
    bindings: Mapping[str, str] | None = None,
    where: Mapping[str, str] | str | None = None,
) -> DataFrame:
    """Key and ``p_value`` from the source tables: the training plan, then the model.

    Missing numbers stay missing, so the model's own medians fill them.
    """
    wide = build_wide_table(plan, tables, bindings, where, scoring=True)
    return model_scores(wide, model, plan.feature_names(), list(plan.main.key), "p_value")
