"""Labels, preparation, profiles, sources, sinks and logs."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewright.functions.columns import is_key_like, bands, nan_as_null, to_number
from tablewright.operators.derive import cross_feature, ratio_bands
from tablewright.operators.labels import (
    class_check,
    normalise_label,
    require_two_classes,
    resolve_label,
    text_label_codes,
)
from tablewright.operators import prep
from tablewright.operators.prep import (
    categories_as_text,
    category_codes,
    hot_texts,
    impute_median,
    label_encode,
    log_scale,
    mixed_encode,
    one_hot,
    split_kinds,
    standard_scale,
)
from tablewright.operators.profile import (
    candidate_columns,
    column_coverage,
    drop_empty_columns,
    is_snapshot,
    logical_view,
    reconcile,
    relation_cardinality,
    schema_rows,
)
from tablewright.operators.score import align_features, restore_names, with_prediction
from tablewright.plans.spec import PlanError, Relationship
from tablewright.session import scratch_path
from tablewright.sources.csv import look_through, read_csv_table, read_csv_tables, sniff_separator
from tablewright.sources.logs import parse_training_log
from tablewright.sources.sinks import as_json, write_predictions, write_report, write_wide_table
from tablewright.sources.tables import (
    catalog_source,
    list_tables,
    parquet_source,
    read_table,
    read_tables,
    sample_rows,
    split_names,
    table_schema,
)


def test_resolve_label():
    assert resolve_label(["a", "TARGET"], "TARGET") == "TARGET"
    assert resolve_label(["a", "is_Churn"], "ISCHURN") == "is_Churn"
    with pytest.raises(PlanError):
        resolve_label(["a"], "b")


def test_bad_labels(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None), (4, "2"), (5, "0.7")], "k long, y string")

    def labels(mode):
        return {r["k"]: r["y"] for r in normalise_label(df, "y", on_bad_label=mode).collect()}

    assert labels("zero") == {1: 1, 2: 0, 3: 0, 5: 0}
    assert labels("drop") == {1: 1, 5: 0}
    with pytest.raises(PySparkException, match="bad label in y"):
        labels("error")
    with pytest.raises(PlanError):
        normalise_label(df, "y", on_bad_label="ignore")
    good = spark.createDataFrame([(1, "yes"), (2, "0")], "k long, y string")
    assert [r["y"] for r in normalise_label(good, "y", {"yes": 1}).orderBy("k").collect()] == [1, 0]


def test_text_labels(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "n"), (3, "maybe"), (4, "y")], "k long, y string")
    assert [r["label_code"] for r in text_label_codes(df, "y").orderBy("k").collect()] == [1, 0, 2, 1]


def test_class_checks(spark):
    df = spark.createDataFrame([(1,)] * 60, "y int")
    assert class_check(df, "y").first().asDict() == {"n_rows": 60, "n_classes": 1, "n_pos": 60, "usable": 0}
    with pytest.raises(PlanError):
        require_two_classes(df, "y")


def test_preparation(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 5.0, None), (4, 3.0, "b")], "k long, v double, c string")

    def column(frame, name):
        return [r[name] for r in frame.orderBy("k").collect()]

    assert column(impute_median(df, ["v"]), "v") == [1.0, 3.0, 5.0, 3.0]
    assert column(label_encode(df, ["c"]), "c_code") == [2, 1, 0, 2]  # the missing text sorts first
    assert column(label_encode(df, ["c"], task_rows=0), "c_code") == [2, 1, 0, 2]
    hot = one_hot(df, ["c"])
    assert hot.columns == ["k", "v", "c___missing__", "c_a", "c_b"] and column(hot, "c_b") == [1, 0, 0, 1]
    unseen = one_hot(df, ["c"], {"c": ["a", "z"]})
    assert column(unseen, "c_a") == [0, 1, 0, 0] and column(unseen, "c_z") == [0, 0, 0, 0]
    mixed = mixed_encode(df, ["c"], drop=["k"])
    assert mixed.columns == ["v", "c_a", "c_b"]
    assert sorted(map(tuple, mixed.collect())) == [(-99.0, 1, 0), (1.0, 0, 1), (3.0, 0, 1), (5.0, 0, 0)]
    with pytest.raises(PlanError):
        one_hot(df, ["c"], limit=2)
    logs = column(log_scale(df.withColumn("v", F.col("v") - 2), ["v"]), "log1p_v")
    assert logs == [None, None, math.log1p(3), math.log1p(1)]
    z = column(standard_scale(df, ["v"]), "z_v")
    assert z[0] == pytest.approx(-2 / math.sqrt(8 / 3)) and z[1] is None
    assert split_kinds(df, ["k"]) == (["v"], ["c"])
    assert column(categories_as_text(df, ["c"]), "c") == ["b", "a", "__missing__", "b"]


def test_a_text_most_rows_share_gets_its_code(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    plain, spread = label_encode(df, ["c"]), label_encode(df, ["c"], task_rows=10)
    assert hot_texts(category_codes(df, ["c"]), 10)["c"][0][1] > 8
    assert plain.exceptAll(spread).count() == 0 and spread.count() == 3000
    order = sorted({"hot", *(str(i) for i in range(3000) if i % 3)})
    codes = {r["id"]: r["c_code"] for r in spread.collect()}
    assert all(codes[i] == order.index(str(i) if i % 3 else "hot") for i in range(0, 3000, 37))


def test_wide_rows_are_not_moved_for_a_small_dictionary(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = label_encode(df, ["c"], task_rows=10)
        assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(prep, "SENT_BYTES", 0)
        moved = label_encode(df, ["c"], task_rows=10)
        assert "SortMergeJoin" in moved._jdf.queryExecution().executedPlan().toString()
        assert sent.columns == moved.columns and sent.count() == 3000 and sent.exceptAll(moved).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [1.5, None, None, None]
    nan = spark.createDataFrame([(math.nan, 1)], "a double, b int")
    assert tuple(nan_as_null(nan).first()) == (None, 1)
    rule = [(0.5, "warning"), (0.8, "danger")]
    values = spark.createDataFrame([(0.5,), (0.51,), (0.9,), (None,)], "v double")
    assert [r[0] for r in values.select(bands(F.col("v"), rule, "ok")).collect()] == ["ok", "warning", "danger", None]


def test_derived_features(spark):
    df = spark.createDataFrame([(6.0, 3.0, 0.0)], "a double, b double, c double")
    assert cross_feature(df, "divide", ["a", "b"], "x").first()["x"] == 2.0
    assert cross_feature(df, "divide", ["a", "c"], "x").first()["x"] is None
    assert cross_feature(df, "add", ["a", "b", "c"], "x").first()["x"] == 9.0
    with pytest.raises(PlanError):
        cross_feature(df, "power", ["a", "b"], "x")
    assert ratio_bands(df, "b", "a", {"warning": 0.4}, "r").first()["r_band"] == "warning"


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, None), (2, None, math.nan)], "k long, e string, v double")
    row = relation_cardinality(df, ["k"], "r").first()
    assert (row["n_rows"], row["n_keys"], row["kind"]) == (3, 2, "1:N") and not is_snapshot(df, ["k"])
    assert relation_cardinality(df, ["k"], "r", approx=True).first()["n_keys"] == 2
    assert is_snapshot(spark.range(50), ["id"])
    assert {r["feature"]: (r["non_null"], r["keep"]) for r in column_coverage(df).collect()} == {"k": (3, 1), "e": (0, 0), "v": (1, 1)}
    assert drop_empty_columns(df).columns == ["k", "v"]
    assert all(map(is_key_like, ("user_ID", "id", "SK_ID_PREV", "id_code"))) and not any(map(is_key_like, ("width", "ideal", "paid_sum")))
    assert candidate_columns(df.withColumn("x_id", F.lit(1)), ["k"], "v") == ["e"]
    kinds = {r["column"]: r["kind"] for r in schema_rows(spark, {"t": df.withColumn("d", F.current_date())}).collect()}
    assert kinds == {"k": "integer", "e": "string", "v": "number", "d": "datetime"}


def test_reconcile(spark):
    tables = {"a": spark.createDataFrame([(1, None)], "x int, y int"), "b": spark.createDataFrame([(1,)], "z int")}
    declared = {"a": ["x", "w"], "c": ["q"]}

    def status(autofill):
        return {(r["table"], r["column"]): (r["status"], r["non_null"]) for r in reconcile(spark, declared, tables, autofill).collect()}

    assert status(False) == {
        ("a", "x"): ("matched", 1),
        ("a", "y"): ("only_data", 0),
        ("a", "w"): ("only_config", 0),
        ("b", "z"): ("only_data", 1),
        ("c", "q"): ("only_config", 0),
    }
    assert status(True)["a", "y"] == ("added", 0) and status(True)["b", "z"] == ("only_data", 1)


def test_logical_view(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert logical_view(df, {"a": "x"}, ["c"]).columns == ["x", "b"]
    with pytest.raises(ValueError):
        logical_view(df, {"nope": "x"})


def test_alignment(spark):
    df = spark.createDataFrame([(7, "1.5", "x", "t")], "k long, f001 string, f002 string, extra string")
    names = {"f001": "long_a", "f002": "long_b"}
    assert restore_names(df, names).columns == ["k", "long_a", "long_b", "extra"]
    row = align_features(df, ["long_b", "gone", "long_a"], names, carry=["k"]).first()
    assert row.asDict() == {"k": 7, "long_b": 0.0, "gone": 0.0, "long_a": 1.5} and list(row.asDict()) == ["k", "long_b", "gone", "long_a"]
    kept = align_features(df, ["long_b", "gone"], names, fill=None, text=["long_b"]).first()
    assert tuple(kept) == ("x", None)
    scores = spark.createDataFrame([(0.5,), (0.51,)], "p double")
    assert [r["prediction"] for r in with_prediction(scores, "p").collect()] == [0, 1]
    assert [r["prediction"] for r in with_prediction(scores, "p", strict=False).collect()] == [1, 1]


@pytest.mark.parametrize("sep", [",", "$", "\t", "|", ";"])
@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_csv_variants(spark, tmp_path, sep, encoding):
    lines = [sep.join(["the key", "价格 a", "c"]), sep.join(["1", "高", "2.5"]), sep.join(["2", "低", ""])]
    (tmp_path / "prices.csv").write_bytes("\n".join(lines).encode(encoding))
    (tables,) = [read_csv_tables(spark, str(tmp_path))]
    df = tables["prices"]
    assert df.columns == ["the_key", "_a", "c"]
    assert [tuple(r) for r in df.orderBy("the_key").collect()] == [(1, "高", 2.5), (2, "低", None)]


def test_csv_folders_and_failures(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.option("header", "true").csv(str(tmp_path / "t.csv"))
    (tmp_path / "bad.csv").write_text("a b,a-b\n1,2\n")
    with pytest.raises(PlanError, match="collide"):
        read_csv_tables(spark, str(tmp_path))
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(PlanError, match="no readable"):
        read_csv_tables(spark, str(empty))


def test_whole_files_are_looked_through(spark, tmp_path):
    plain, late, quoted = tmp_path / "plain.csv", tmp_path / "late.csv", tmp_path / "quoted.csv"
    plain.write_bytes(("价" * 2000 + "\n").encode())
    late.write_bytes(b"a,b\n" + b"1,x\n" * 5000 + "2,国家\n".encode("gbk"))
    quoted.write_text('a,b\n1,"x ""y"", z"\n2,"two\nlines"\n')
    assert look_through(spark, str(plain)) == (True, False)
    assert look_through(spark, str(late)) == (False, False)
    assert look_through(spark, str(quoted)) == (True, True)
    assert read_csv_table(spark, str(late)).where("a = 2").first()["b"] == "国家"
    assert sorted(map(tuple, read_csv_table(spark, str(quoted)).collect())) == [(1, 'x "y", z'), (2, "two\nlines")]


def test_separators():
    assert sniff_separator("a") == "," and sniff_separator("a,b$c") == "," and sniff_separator("a|b|c,d") == "|"


def test_tables(spark, sf):
    source = parquet_source(spark, sf)
    df = read_table(source, "orders", ["o_orderkey"], "o_totalprice > 1000", 5, ["o_orderkey"])
    assert df.columns == ["o_orderkey"] and df.count() == 5
    assert split_names("a, b,,c") == ["a", "b", "c"] == split_names(["a", "b", "c"]) and split_names(None) == []
    rel = Relationship("orders", "o_custkey", "c_custkey")
    tables = read_tables(source, "customer", ["orders"], limit=3, relationships=[rel], order_by=["c_custkey"])
    keys = {r["c_custkey"] for r in tables["customer"].collect()}
    assert len(keys) == 3 and {r["o_custkey"] for r in tables["orders"].select("o_custkey").collect()} <= keys
    all_orders = source("orders").filter(F.col("o_custkey").isin(list(keys))).count()
    assert tables["orders"].count() == all_orders
    with pytest.raises(PlanError):
        read_tables(source, "customer", "orders", limit=3)
    source("nation").createOrReplaceTempView("nation_view")
    assert "nation_view" in list_tables(spark) and catalog_source(spark)("nation_view").count() == 25
    assert table_schema(source("nation"))[0][:2] == ("n_nationkey", "int")
    assert [r["n_nationkey"] for r in sample_rows(source("nation"), 2, ["n_nationkey"])] == [0, 1]


def test_column_pruning_reaches_the_scan(spark, sf):
    df = read_table(parquet_source(spark, sf), "orders", ["o_orderkey"], "o_totalprice > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.25, "b")], "k long, p double, period string")
    for _ in range(2):  # a second run replaces the first
        write_predictions(df.select("k", "p"), str(tmp_path / "scores"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "scores")).count() == 2
    path = str(tmp_path / "wide")
    write_wide_table(df, path, period=["period"])
    write_wide_table(df.filter("period = 'a'").withColumn("p", F.lit(9.0)), path, period=["period"])
    assert {r["k"]: r["p"] for r in spark.read.parquet(path).collect()} == {1: 9.0, 2: 0.25}
    write_report(df.limit(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    assert as_json(df.select("k")).orderBy("json").first()["json"] == '{"k":1}'
    with pytest.raises(ValueError):
        write_wide_table(df)


def test_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "start\n[统计] 平均基础AUC: 0.9 (最高: 0.95)\n--- 世代 1/3 ---\nnoise\n"
        "[统计] 平均基础AUC: 0.8123 (最高: 0.8456)\n[统计] 平均综合得分: 0.7 (最高: 0.81)\n"
        "[统计] 平均基础AUC: 0.1 (最高: 0.2)\n--- 世代 2/3 ---\nno result\n--- 世代 3/3 ---\n"
        "2024 INFO [统计] 平均基础AUC: 0.5 (最高: 0.6)\n"
    )
    (tmp_path / "b.log").write_text("--- 世代 1/1 ---\n[统计] 平均基础AUC: 0.3 (最高: 0.4)\n")
    got = {(r["file"][-5:], r["round"]): (r["best_auc"], r["mean_auc"], r["best_score"]) for r in parse_training_log(spark, str(tmp_path)).collect()}
    assert got == {("a.log", 1): (0.8456, 0.8123, 0.81), ("a.log", 3): (0.6, 0.5, 0.0), ("b.log", 1): (0.4, 0.3, 0.0)}


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_bucketed_table_joins_without_a_shuffle(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for name in ("wide_a", "wide_b"):
        write_wide_table(df, str(tmp_path / name), name, bucket_by=["k"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("wide_a").join(spark.table("wide_b"), "k", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("wide_a", "wide_b"):
            spark.sql(f"drop table {name}")
