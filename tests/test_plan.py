"""Specs, windows, names, validation, configuration and stored plans: no jobs."""

import json

import pytest

from tablewright.plans.config import load_config, parse_config
from tablewright.plans.spec import (
    FeaturePlan,
    FeatureSpec,
    MainSpec,
    PlanError,
    Relationship,
    clean_name,
    infer_main_table,
    parse_window,
    plan_diff,
    short_aliases,
)
from tablewright.plans.store import load_plan, plan_from_dict, save_plan
from tablewright.plans.validate import validate


@pytest.mark.parametrize(
    ("given", "days"), [(None, None), (90, 90), ("90", 90), ("90d", 90), (" 90D ", 90), ({"days": 90}, 90), (90.0, 90)]
)
def test_window_forms(given, days):
    assert parse_window(given) == days


@pytest.mark.parametrize("given", [0, -1, "x", "0d", {"weeks": 1}, 1.5, True])
def test_bad_windows(given):
    with pytest.raises(PlanError):
        parse_window(given)


def test_names():
    assert FeatureSpec("avg", "fact", "amount", "30d").name == "AVG_fact_amount_30d"
    assert FeatureSpec("LATEST", "my table", "a b").name == "LATEST_my_table_a_b"
    assert FeatureSpec("COUNT", "fact").name == "COUNT_fact_rows"
    assert clean_name("a--b 价") == "a_b_"
    assert short_aliases(["x", "y"]) == {"f001": "x", "f002": "y"}


def test_specs_are_distinct_in_order():
    a, b = FeatureSpec("AVG", "t", "x"), FeatureSpec("SUM", "t", "x")
    plan = FeaturePlan(MainSpec("m", "k"), [a, b, FeatureSpec("avg", "t", "x")])
    assert plan.specs == (a, b)
    assert plan.feature_names() == ["AVG_t_x", "SUM_t_x"]


def test_main_table_by_vote():
    specs = [FeatureSpec("LATEST", t, "c") for t in ("b", "a", "a", "b")]
    assert infer_main_table(specs) == "b"
    with pytest.raises(PlanError):
        infer_main_table([])


def test_plan_diff():
    a, b, c = (FeatureSpec("AVG", "t", x) for x in "abc")
    assert plan_diff([a, b], [b, c]) == {"common": [b], "only_left": [a], "only_right": [c]}


def _tables(spark):
    return {
        "m": spark.createDataFrame([(1, 0, "x")], "k long, y int, c string"),
        "f": spark.createDataFrame([(1, 2.0, -3, "a")], "k long, v double, days int, s string"),
        "snap": spark.createDataFrame([("1", 5)], "k string, w int"),
    }


@pytest.mark.parametrize(
    ("spec", "complaint"),
    [
        (FeatureSpec("MEDIAN", "f", "v"), "unknown operation"),
        (FeatureSpec("AVG", "g", "v"), "unknown table"),
        (FeatureSpec("AVG", "f", "z"), "no column"),
        (FeatureSpec("AVG", "f"), "needs a column"),
        (FeatureSpec("RATE", "f"), "needs a predicate"),
        (FeatureSpec("SUM", "f", "s"), "numeric"),
        (FeatureSpec("COUNT", "f", "k"), "key"),
        (FeatureSpec("LATEST", "m", "y"), "label"),
        (FeatureSpec("AVG", "m", "c"), "only LATEST"),
        (FeatureSpec("LATEST", "f", "v"), "order_by"),
        (FeatureSpec("AVG", "f", expr="v / nothing"), "nothing"),
        (FeatureSpec("LATEST", "snap", "w"), "unlike types"),
    ],
)
def test_validation(spark, spec, complaint):
    rels = [Relationship("f", "k", "k", time_column="days")]
    if spec.table == "snap":
        rels = [Relationship("snap", "k", "k", unique=True)]
    plan = FeaturePlan(MainSpec("m", "k", "y"), [spec], rels)
    assert any(complaint in issue for issue in validate(plan, _tables(spark)))


def test_window_needs_a_time_column(spark):
    spec = FeatureSpec("AVG", "f", "v", 30)
    no_time = FeaturePlan(MainSpec("m", "k"), [spec], [Relationship("f", "k", "k")])
    text_time = FeaturePlan(MainSpec("m", "k"), [spec], [Relationship("f", "k", "k", time_column="s")])
    good = FeaturePlan(MainSpec("m", "k"), [spec], [Relationship("f", "k", "k", time_column="days")])
    assert validate(no_time, _tables(spark)) and validate(text_time, _tables(spark))
    assert validate(good, _tables(spark)) == []


def test_names_must_not_clash(spark):
    twice = [FeatureSpec("SUM", "f", "v", alias="a"), FeatureSpec("MAX", "f", "v", alias="a")]
    own = [FeatureSpec("SUM", "f", "v", alias="y")]
    rels = [Relationship("f", "k", "k")]
    assert any("twice" in i for i in validate(FeaturePlan(MainSpec("m", "k", "y"), twice, rels), _tables(spark)))
    assert any("is a key" in i for i in validate(FeaturePlan(MainSpec("m", "k", "y"), own, rels), _tables(spark)))


def test_unknown_relationship_and_filter(spark):
    plan = FeaturePlan(MainSpec("m", "k"), [FeatureSpec("AVG", "f", "v")], filters={"m": "nope > 1", "q": "1 = 1"})
    issues = " ".join(validate(plan, _tables(spark)))
    assert "no relationship" in issues and "nope" in issues and "'q'" in issues


CONFIG = {
    "tables": {
        "app": {"primary_key": "id", "fields": {"id": {"is_join_key": True}, "y": {"is_target": True}}},
        "hist": {"fields": {"id": {}, "days": {"time_relative": True}}, "physical_table": "hist_202508"},
    },
    "relationships": [{"from_entity": "hist", "to_entity": "app", "from_key": "id", "to_key": "id"}],
}


def test_config(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG))
    config = load_config(str(path))
    assert config.target() == ("app", "y")
    assert config.table_for("hist_202508") == "hist"
    assert config.columns()["hist"] == ["id", "days"]
    (rel,) = config.relationships("app")
    assert (rel.table, rel.key, rel.main_key, rel.time_column) == ("hist", ("id",), ("id",), "days")
    assert config.relationships("app", present=["app"]) == []
    with pytest.raises(PlanError):
        config.table_for("his")


def test_relations_from_key_flags():
    raw = {"tables": {"a": {"primary_key": "id", "fields": {"id": {}}}, "b": {"fields": {"id": {"is_foreign_key": True}}}}}
    (rel,) = parse_config({**raw, "relationships": []}).relationships("a")
    assert rel.table == "b"


@pytest.mark.parametrize(
    "raw",
    [
        {"tables": {}},
        {"tables": {"a": {}}, "relationships": [{"from_table": "a", "to_table": "zz", "from_key": "x", "to_key": "x"}]},
        {"tables": {"a": {}}, "relationships": [{"from_table": "a", "to_table": "a"}]},
        {"tables": {"a": {"primary_key": "k", "fields": {"c": {}}}}, "relationships": []},
    ],
)
def test_bad_config(raw):
    with pytest.raises(PlanError):
        parse_config(raw)


def test_plan_round_trip(tmp_path):
    plan = FeaturePlan(
        MainSpec("m", "k", "y"),
        [FeatureSpec("SUM", "f", "v", 30, scale=2), FeatureSpec("COUNT", "f", predicate="v > 1", alias="n")],
        [Relationship("f", "k", "k", time_column="t")],
        "2024-01-31",
        {"m": "k > 0"},
        exclude=("z",),
    )
    path = str(tmp_path / "plan.json")
    save_plan(plan, path, {"alg": "trees", "params": {"trees": 5}})
    assert load_plan(path) == (plan, {"alg": "trees", "params": {"trees": 5}})


def test_plan_in_short_form():
    plan, model = plan_from_dict(
        {
            "meta": {"join_key": "k", "main_table": "m", "target_column": "y"},
            "genes": [
                {"_type": "FeatureGene", "op": "LATEST", "path": "m.c", "window": None},
                {"_type": "FeatureGene", "op": "AVG", "path": "f.v", "window": "30d"},
                {"_type": "FilterGene", "condition": "m.c > 18 and m.s <> 'm.x'"},
            ],
        }
    )
    assert plan.feature_names() == ["LATEST_m_c", "AVG_f_v_30d"] and model is None
    assert plan.filters == {"m": "c > 18 and s <> 'm.x'"}


@pytest.mark.parametrize("entry", [{"_type": "OtherGene", "x": 1}, {"_type": "FilterGene", "condition": "c > 18"}])
def test_stored_entries_that_would_be_lost_are_refused(entry):
    with pytest.raises(PlanError):
        plan_from_dict({"meta": {"join_key": "k", "main_table": "m"}, "genes": [entry]})
