"""Fitting, comparing and applying models on a small table with a known signal."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.operators.metrics import auc, classification_report
from tablewright.operators.model import (
    PRESETS,
    fit_final,
    load_model,
    model_scores,
    oof_scores,
    permutation_importance,
    preset,
    save_model,
    screen_gbt,
)
from tablewright.operators.report import evaluation_report
from tablewright.operators.score import score_raw, score_wide
from tablewright.jobs import score, train
from tablewright.operators.search import (
    best_candidate,
    build_pool,
    cost_penalty,
    leaderboard,
    refine_subset,
    round_stats,
    sample_subsets,
    search,
    size_range,
    spec_rows,
)
from tablewright.plans.compile import build_wide_table
from tablewright.plans.grid import default_specs, window_grid
from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, PlanError, Relationship
from tablewright.session import scratch_path
from tablewright.streaming.scoring import score_stream, wide_stream

SMALL = {"trees": 3, "rate": 0.3, "leaves": 7, "min_rows": 5}
FEATURES = ["signal", "noise", "kind"]


@pytest.fixture(scope="module")
def table(spark):
    noise = F.xxhash64("id", F.lit(1)) % 100
    return spark.range(600).select(
        "id",
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 3 == 0, 10.0).otherwise(0.0) + F.pmod(noise, F.lit(3))).alias("signal"),
        noise.cast("double").alias("noise"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), F.col("id") % 4)).alias("kind"),
    )


@pytest.fixture(scope="module")
def model(table):
    return fit_final(table, "y", FEATURES, SMALL)


def test_presets():
    assert preset("wide") == PRESETS["wide"] and preset("no such model") == PRESETS["balanced"]


def test_out_of_fold_scores(table):
    scored = oof_scores(table, ["id"], "y", FEATURES, SMALL)
    assert scored.count() == 600 and scored.select("id").distinct().count() == 600
    assert sorted(r["fold"] for r in scored.select("fold").distinct().collect()) == [0, 1, 2]
    assert auc(scored, "y", "score").first()["auc"] > 0.85
    row = evaluation_report(scored, ["id"], "y", "score", "demo", FEATURES).first()
    assert row["n_rows"] == 600 and row["n_features"] == 3 and row["dataset"] == "demo"
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == 600
    full = classification_report(scored, "y", "score").first()
    assert row["ks"] == round(full["ks"], 4) and row["auc"] == full["auc"] and 0 <= row["auc_std"] < 0.1


def test_one_class_is_refused(table):
    with pytest.raises(PlanError):
        fit_final(table.filter("y = 1"), "y", FEATURES, SMALL)


def test_importance(table, model):
    by_model = {r["feature"]: r["score"] for r in screen_gbt(table, "y", FEATURES, SMALL).collect()}
    assert max(by_model, key=by_model.get) == "signal" and sum(by_model.values()) == pytest.approx(1.0)
    shuffled = permutation_importance(table, ["id"], "y", FEATURES, model)
    scores = {r["feature"]: r["score"] for r in shuffled.collect()}
    assert list(scores) == FEATURES and scores["signal"] > 0.2 and abs(scores["noise"]) < 0.1


def test_model_round_trip(spark, table, model):
    path = scratch_path(spark, "model")
    save_model(model, path)
    before = model_scores(table, model, FEATURES, ["id"])
    after = model_scores(table, load_model(path), FEATURES, ["id"])
    assert before.exceptAll(after).count() == 0


def test_unseen_categories_and_missing_numbers_score(spark, model):
    new = spark.createDataFrame([(1, None, None, "new"), (2, 11.0, 5.0, None)], "id long, signal double, noise double, kind string")
    scored = {r["id"]: r["p_value"] for r in score_wide(new, model, ["id"], FEATURES, fill=None, text=["kind"]).collect()}
    assert len(scored) == 2 and scored[2] > 0.5


def test_raw_wide_and_stream_scores_agree(spark, table):
    main = table.select("id", "y", "kind")
    fact = table.select(F.col("id").alias("fk"), "signal", "noise")
    specs = [
        FeatureSpec("SUM", "f", "signal", alias="signal"),
        FeatureSpec("MAX", "f", "noise", alias="noise"),
        FeatureSpec("LATEST", "m", "kind", alias="kind"),
    ]
    plan = FeaturePlan(MainSpec("m", "id", "y"), specs, [Relationship("f", "fk", "id")])
    tables = {"m": main, "f": fact}
    wide = build_wide_table(plan, tables)
    model = fit_final(wide, "y", plan.feature_names(), SMALL)
    raw = score_raw(plan, {"m": main.drop("y"), "f": fact}, model)  # no label when scoring
    assert raw.columns == ["id", "p_value"] and raw.count() == 600
    batch = score_wide(wide, model, ["id"], plan.feature_names(), fill=None, text=["kind"])
    assert raw.exceptAll(batch).count() == 0
    arriving, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    progress = scratch_path(spark, "progress")
    plain = build_wide_table(plan, tables, scoring=True)
    for part in ("id < 300", "id >= 300"):  # the second run scores only what is new
        plain.filter(part).write.mode("append").parquet(arriving)
        stream = wide_stream(spark, arriving, plain.schema, files_per_trigger=1)
        score_stream(stream, model, ["id"], plan.feature_names(), out, progress, fill=None, text=["kind"]).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.count() == 600 and raw.exceptAll(streamed).count() == 0


def test_leaderboard(table):
    board = leaderboard(
        table, ["id"], "y", {1: ["signal"], 2: ["noise", "kind"], 3: ["nothing"]}, {s: SMALL for s in (1, 2, 3)}
    ).withColumn("round", F.lit(1))
    got = {r["subset_id"]: r for r in board.collect()}
    assert got[1]["auc"] > 0.85 > got[2]["auc"] and got[1]["error"] is None
    assert got[3]["auc"] == 0.0 and "nothing" in got[3]["error"]
    assert best_candidate(board).first()["subset_id"] == 1
    stats = round_stats(board).first()
    assert stats["best_auc"] == got[1]["auc"] and stats["mean_auc"] == pytest.approx(sum(r["auc"] for r in got.values()) / 3)


def test_earliest_of_equals_is_best(spark):
    rows = [(2, 1, 0.7, 0.7), (1, 2, 0.7, 0.7), (1, 1, 0.6, 0.6)]
    board = spark.createDataFrame(rows, "round int, subset_id int, auc double, composite double")
    assert tuple(best_candidate(board).first())[:2] == (1, 2)


def test_cost_penalty(spark):
    costs = spark.createDataFrame([(50.0, 1), (350.0, 5)], "ms double, n int")
    got = [r[0] for r in costs.select(cost_penalty(F.col("ms"), F.col("n"))).collect()]
    assert got == [0.0, pytest.approx(0.065)]


@pytest.mark.parametrize(("n", "sizes"), [(100, (15, 45)), (48, (7, 21)), (10, (1, 10)), (1, (1, 1))])
def test_size_range(n, sizes):
    assert size_range(n) == sizes


def test_subsets_and_refinement(spark):
    pool = spark.createDataFrame([(f"f{i}", i) for i in range(40)], "feature string, position int")
    subsets = sample_subsets(pool, 4, 40)
    sizes = {r["subset_id"]: r["count"] for r in subsets.groupBy("subset_id").count().collect()}
    assert set(sizes) == {1, 2, 3, 4} and all(6 <= n <= 18 for n in sizes.values())
    assert subsets.exceptAll(sample_subsets(pool.repartition(5), 4, 40)).count() == 0
    one = subsets.filter("subset_id = 1")
    members = {r["feature"] for r in one.collect()}
    importance = pool.select("feature", "position", F.col("position").cast("double").alias("score"))
    refined = {r["feature"]: r["replaced"] for r in refine_subset(one, importance, pool).collect()}
    lost = members - set(refined)
    assert lost == {min(members, key=lambda f: int(f[1:]))} and len(refined) == len(members)
    assert sum(refined.values()) == 1 and not (set(refined) - members) & members
    whole = refine_subset(pool, importance, pool)
    assert whole.count() == 40 and whole.agg(F.sum("replaced")).first()[0] == 0


def test_pool(spark, table):
    main = table.select("id", "y", "signal", F.lit("x").alias("shop_id"))
    snapshot = table.select("id", "noise", "kind")
    fact = table.select(F.col("id") % 50, "noise", (-F.col("id")).alias("days")).toDF("id", "amount", "days")
    rels = [Relationship("snap", "id", "id"), Relationship("fact", "id", "id", time_column="days")]
    plan = FeaturePlan(MainSpec("m", "id", "y"), (), rels)
    tables = {"m": main, "snap": snapshot, "fact": fact}
    good = FeatureSpec("COUNT", "fact", "amount")
    with pytest.raises(PlanError, match="no_such"):
        build_pool(plan, tables, [good, FeatureSpec("AVG", "fact", "no_such")])
    pool = build_pool(plan, tables, [good, FeatureSpec("SUM", "fact", "amount", 30)])
    names = [s.name for s in pool]
    assert names[0] == "LATEST_m_signal" and {"LATEST_snap_noise", "LATEST_snap_kind"} <= set(names[1:3])
    assert len(names) == 3 + 12 + 1 and names[-1] == "COUNT_fact_amount"
    assert spec_rows(spark, pool).count() == 16
    bare = FeaturePlan(MainSpec("m", "id"), ())
    with pytest.raises(PlanError, match="passes the screen"):
        build_pool(bare, {"m": main})
    assert [s.column for s in build_pool(bare, {"m": main}, default_columns=15)] == ["y", "signal", "shop_id"]
    assert len(default_specs(main, "m", ["id"], 2)) == 2
    assert window_grid(tables, [Relationship("snap", "id", "id", unique=True)]) == []


def test_search_refines_the_winner(table):
    found = search(table, ["id"], "y", FEATURES, rounds=2, subsets=2, settings=SMALL)
    rows = found.board.collect()
    assert sorted((r["round"], r["subset_id"]) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert max(r["auc"] for r in rows) > 0.85 and "signal" in found.features
    best = max(r["auc"] for r in rows)
    assert auc(found.scores, "y", "score").first()["auc"] == best and found.settings == SMALL


def test_train_then_score(spark, table):
    main = table.select("id", F.when(F.col("y") == 1, "yes").otherwise("no").alias("churn"), "kind")
    fact = table.select(F.col("id").alias("fk"), "signal", "noise", F.lit(None).cast("double").alias("empty"))
    specs = [FeatureSpec("LATEST", "m", "kind")] + [FeatureSpec("SUM", "f", c) for c in ("signal", "noise", "empty")]
    plan = FeaturePlan(MainSpec("m", "id", "churn"), specs, [Relationship("f", "fk", "id")])
    out = scratch_path(spark, "trained")
    trained = train(plan, {"m": main, "f": fact}, out, rounds=1, subsets=2, settings=SMALL)
    assert trained.report.first()["n_rows"] == 600 and trained.leaderboard.count() == 2
    assert "SUM_f_empty" not in trained.plan.feature_names()
    scores = scratch_path(spark, "scores")
    score(out, {"m_202509": main.drop("churn"), "f_202509": fact}, scores, {"m": "m_202509", "f": "f_202509"}, fmt="parquet")
    assert trained.plan.table_names()[0] == "m"
    result = spark.read.parquet(scores)
    assert result.columns == ["id", "p_value"] and result.count() == 600
    assert spark.read.json(f"{out}/report").first()["dataset"] == "m"


def test_importance_moves_rows_once_and_scores_them_as_shuffled(spark, table, model, monkeypatch):
    def repeated(*_):
        raise AssertionError("rows repeated for each feature")

    monkeypatch.setattr(F, "explode", repeated)
    rows = [(r["id"], r["y"], *[r[c] for c in FEATURES]) for r in table.select("id", "y", *FEATURES).collect()]
    rows.sort(key=lambda r: r[0])
    got = {r["feature"]: r for r in permutation_importance(table, ["id"], "y", FEATURES, model).collect()}
    whole = auc(model_scores(table, model, FEATURES, ["y"]), "y", "score").first()["auc"]
    for place, name in enumerate(FEATURES, start=2):
        hashed = {r[0]: hashlib.md5(f"{hashlib.md5(f'{r[0]}|42'.encode()).hexdigest()}|{name}".encode()).hexdigest() for r in rows}
        others = sorted(rows, key=lambda r: hashed[r[0]])
        mixed = [(*r[:place], o[place], *r[place + 1 :]) for r, o in zip(rows, others, strict=True)]
        scored = model_scores(spark.createDataFrame(mixed, table.select("id", "y", *FEATURES).schema), model, FEATURES, ["y"])
        want = auc(scored, "y", "score").first()["auc"]
        assert got[name]["auc"] == pytest.approx(want, abs=1e-12) and got[name]["score"] == pytest.approx(whole - want, abs=1e-12)
