"""Boosted trees over a wide table: fitting, out-of-fold scores, importance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tablewright.functions.columns import is_numeric, key_hash, quoted, sql_category, sql_name, sql_no_nan
from tablewright.operators.boosting import (
    Bins,
    BoostedModel,
    Task,
    binned_blocks,
    compiled,
    feature_columns,
    find_bins,
    fit_models,
    fit_trees,
    predict,
    read_model,
    write_model,
)
from tablewright.operators.labels import require_two_classes
from tablewright.operators.metrics import auc
from tablewright.operators.sampling import stratified_folds
from tablewright.plans.spec import PlanError
from tablewright.session import materialise

# Model presets (fixed values): trees, learning rate, leaves, fewest rows per leaf, L1 and L2 penalties of leaf values.
PRESETS: dict[str, dict[str, float]] = {
    "balanced": {"trees": 200, "rate": 0.05, "leaves": 31, "min_rows": 20, "l1": 0.1, "l2": 0.1},
    "wide": {"trees": 150, "rate": 0.08, "leaves": 63, "min_rows": 50, "l1": 0.0, "l2": 0.0},
    "careful": {"trees": 300, "rate": 0.03, "leaves": 31, "min_rows": 100, "l1": 0.3, "l2": 0.3},
}
DEFAULT_PRESET = "balanced"
# The screening model (fixed values).
SCREEN_PRESET = {"trees": 100, "rate": 0.1, "leaves": 255, "min_rows": 20, "l1": 0.0, "l2": 0.0}
# Rows of a bucket in which rows are paired with shuffled ones.
PAIRED_ROWS = 50_000


def preset(name: str) -> dict[str, float]:
    """A preset by name, the default one for an unknown name."""
    return PRESETS.get(name, PRESETS[DEFAULT_PRESET])


def clean_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numbers as double with null for missing, categories as text."""
    chosen = set(features)

    def one(field: T.StructField) -> str:
        name = sql_name(field.name)
        if field.name not in chosen:
            return name
        if is_numeric(field.dataType):
            return f"CAST({sql_no_nan(name, field.dataType)} AS DOUBLE) AS {name}"
        return f"{sql_category(name)} AS {name}"

    return df.selectExpr(*map(one, df.schema))


def in_threads(spark: SparkSession, tasks: Sequence[Callable[[], object]], workers: int) -> list:
    """Run independent series of Spark jobs side by side."""
    carry = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return [f.result() for f in [pool.submit(carry(task)) for task in tasks]]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise PlanError(f"no columns {unknown}")


@dataclass(frozen=True)
class Prepared:
    """Cleaned rows with their fold, and the same rows binned: written once, used by every fit."""

    rows: DataFrame
    bins: Bins
    blocks: DataFrame
    folds: int

    def tasks(self, features: Sequence[str], settings: Mapping[str, float]) -> list[Task]:
        """One fit per fold, each without that fold's rows."""
        unknown = [c for c in features if c not in self.bins.names]
        if unknown or not features:
            raise PlanError(f"no columns {unknown}" if unknown else "no features to fit on")
        columns = tuple(self.bins.names.index(c) for c in features)
        return [Task(columns, settings, fold) for fold in range(self.folds)]


def with_folds(
    df: DataFrame, key: Sequence[str], label: str, features: Sequence[str], folds: int = 3, seed: int = 42, least_rows: int = 1
) -> Prepared:
    """Rows dealt to folds and binned. Bins and medians are those of all rows, labels apart.

    ``least_rows``: the fewest rows per leaf of the fits to come; rarer texts need no code.
    """
    columns = list(dict.fromkeys([*key, label, *features]))
    cleaned = clean_inputs(df.select(*[quoted(c) for c in columns]), features)
    rows = materialise(stratified_folds(cleaned, key, label, folds, seed))
    bins = find_bins(rows, list(dict.fromkeys(features)), least_rows)
    return Prepared(rows, bins, binned_blocks(rows, bins, label, "fold"), folds)


def fit_prepared(prepared: Prepared, tasks: Sequence[Task]) -> list[BoostedModel]:
    """Fit many models over the same binned rows in common passes."""
    fitted = fit_trees(prepared.blocks, prepared.bins, tasks)
    return [compiled(prepared.bins, task, first, trees) for task, (first, trees) in zip(tasks, fitted, strict=True)]


def held_out_scores(prepared: Prepared, key: Sequence[str], label: str, models: Sequence[BoostedModel]) -> DataFrame:
    """Every fold's rows scored by the model that did not see them; models in order of their folds."""
    carry = list(dict.fromkeys([*key, label, "fold"]))
    parts = [predict(prepared.rows.filter(F.col("fold") == fold), model, carry) for fold, model in enumerate(models)]
    return materialise(reduce(DataFrame.unionByName, parts))


def oof_scores(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    features: Sequence[str],
    settings: Mapping[str, float] | None = None,
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Key, label, fold and the probability from a model that did not see the row."""
    require_columns(df, [*key, label, *features])
    settings = settings or preset(DEFAULT_PRESET)
    prepared = with_folds(df, key, label, features, folds, seed, int(settings["min_rows"]))
    models = fit_prepared(prepared, prepared.tasks(features, settings))
    return held_out_scores(prepared, key, label, models)


def fit_final(
    df: DataFrame, label: str, features: Sequence[str], settings: Mapping[str, float] | None = None
) -> BoostedModel:
    """Fit on all rows."""
    train = materialise(clean_inputs(df.select(quoted(label), *[quoted(c) for c in features]), features))
    require_two_classes(train, label)
    columns = tuple(range(len(features)))
    return fit_models(train, label, features, [Task(columns, settings or preset(DEFAULT_PRESET))])[0]


def model_scores(
    df: DataFrame, model: BoostedModel, features: Sequence[str], carry: Sequence[str], name: str = "score"
) -> DataFrame:
    """Carried columns and the probability of class 1."""
    require_columns(df, list(features))
    return predict(df, model, carry, name)


def screen_gbt(
    df: DataFrame, label: str, features: Sequence[str], settings: Mapping[str, float] | None = None
) -> DataFrame:
    """``feature, position, score``: each column's share of the gains in a boosted model."""
    gains = fit_final(df, label, features, settings or SCREEN_PRESET).gains()
    total = float(gains.sum()) or 1.0
    rows = [(c, i, float(g) / total) for i, (c, g) in enumerate(zip(features, gains.tolist(), strict=True))]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, score double")


def permutation_importance(
    df: DataFrame, key: Sequence[str], label: str, features: Sequence[str], model: BoostedModel, seed: int = 42
) -> DataFrame:
    """``feature, position, auc, score``: AUC lost when a column is shuffled among all rows.

    Rows fall into buckets by a hash of their key and are shuffled within these, so no task orders
    more than one bucket. Rows are moved once, whatever the number of features: a bucket is coded
    once and scored with each column shuffled in turn.
    """
    columns = list(dict.fromkeys([*key, label, *features]))
    rows = materialise(clean_inputs(df.select(*[quoted(c) for c in columns]), features))
    buckets = max(1, math.ceil(rows.count() / PAIRED_ROWS))
    bucket = F.pmod(F.xxhash64(*[quoted(c) for c in key], F.lit(seed)), F.lit(buckets))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*[quoted(f"_k{i}") for i in range(len(key))]))
    keys = [quoted(c).alias(f"_k{i}") for i, c in enumerate(key)]
    told = rows.select(bucket.alias("_b"), *keys, key_hash(key, seed).alias("_h"), quoted(label).alias("_y"), *feature_columns(rows, model))
    placed = told.withColumn("_at", at).drop(*[f"_k{i}" for i in range(len(key))])
    # A key keeps its own value, as in the rows it names.
    moved = [(i, c, model.names.index(c)) for i, c in enumerate(features) if c in model.names and c not in key]

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        codes = model.codes([table[f"_f{i}"].combine_chunks() for i in range(len(model.features))])
        found = [(-1, model.margins(codes))]
        for i, name, place in moved:
            digests = b"".join(hashlib.md5(f"{h}|{name}".encode()).digest() for h in table["_h"].to_pylist())
            high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).T
            mixed = codes.copy()
            mixed[place] = codes[place][np.lexsort((low, high))]
            found.append((i, model.margins(mixed)))
        scores = [pa.array(1.0 / (1.0 + np.exp(-margin))) for _, margin in found]
        places = [pa.array(np.full(table.num_rows, i, np.int32)) for i, _ in found]
        return pa.table({"_y": pa.chunked_array([c for _ in found for c in table["_y"].chunks]), "position": pa.chunked_array(places), "score": pa.chunked_array(scores)})

    schema = T.StructType([T.StructField("_y", placed.schema["_y"].dataType), T.StructField("position", T.IntegerType()), T.StructField("score", T.DoubleType())])
    scored = placed.groupBy("_b").applyInArrow(score, schema)
    aucs = {row["position"]: row["auc"] for row in auc(scored, "_y", "score", ["position"]).collect()}  # one row each
    whole = aucs.get(-1)
    found = [aucs.get(i, whole) for i in range(len(features))]
    lost = [(c, i, found[i], None if found[i] is None else whole - found[i]) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(lost, "feature string, position int, auc double, score double")


def save_model(model: BoostedModel, path: str) -> None:
    write_model(SparkSession.active(), model, path)


def load_model(path: str) -> BoostedModel:
    return read_model(SparkSession.active(), path)
