"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import short_aliases
from tablewright.queries.base import CUSTOMER_AS_OF, ORDERS, customer_tables, exact, read, registry, within
from tablewright.queries.features import ALIAS_SPECS, FLAGSHIP, alias_sql, customer_plan
from tablewright.session import scratch_path
from tablewright.sources.csv import read_csv_table, read_csv_tables
from tablewright.sources.logs import parse_training_log
from tablewright.sources.sinks import write_predictions, write_wide_table
from tablewright.sources.tables import parquet_source, read_table, read_tables

QUERIES, query = registry()


@query("""
    select c_custkey, c_name, c_acctbal, c_mktsegment, '国' || n_name as n_label
    from customer join nation on c_nationkey = n_nationkey""")
def scan_csv_sniffed(spark, sf):
    """Two tables written with unlike separators and charsets, read back without being told."""
    folder = scratch_path(spark, "csv")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    nation = read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("国"), "n_name").alias("n label"))
    write = {"header": "true", "encoding": "GBK", "sep": "$"}
    nation.write.options(**write).csv(f"{folder}/nation.csv")
    customer = read(spark, sf, "customer").withColumnRenamed("c_name", "c name")
    customer.write.options(header="true", sep="\t").csv(f"{folder}/customer.csv")
    tables = read_csv_tables(spark, folder)
    joined = tables["customer"].join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment", "n_label")


@query("""
    select doc_id, lang, '"' || replace(replace(lang, 'e', '"'), 'n', ',') || chr(10) || source || '"' as quoted, md5(text) as text_md5
    from documents where text <> ''""")
def scan_csv_quoted(spark, sf):
    """Values with quotes, separators and line breaks inside, written as other tools write them and read back."""
    path = f"{scratch_path(spark, 'csv')}/documents.csv"
    marked = F.concat(
        F.lit('"'), F.replace(F.replace("lang", F.lit("e"), F.lit('"')), F.lit("n"), F.lit(",")), F.lit("\n"), "source", F.lit('"')
    )
    rows = read(spark, sf, "documents").where("text <> ''").select("doc_id", "lang", marked.alias("quoted"), "text")
    rows.write.options(header="true", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    back = read_csv_table(spark, path, schema="doc_id long, lang string, quoted string, text string")
    return back.select("doc_id", "lang", "quoted", F.md5("text").alias("text_md5"))


@query("select c_custkey, c_name, case when c_custkey % 2 = 0 then '客户' else '' end || c_mktsegment as label from customer")
def scan_csv_late_charset(spark, sf):
    """GBK text that starts after many plain lines, in a folder whose first part has a header alone."""
    path = f"{scratch_path(spark, 'csv')}/customer.csv"
    even = F.col("c_custkey") % 2 == 0
    label = F.concat(F.when(even, F.lit("客户")).otherwise(F.lit("")), "c_mktsegment").alias("label")
    rows = read(spark, sf, "customer").orderBy(even, "c_custkey").select("c_custkey", "c_name", label)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for part in (rows.limit(0), rows):
        part.coalesce(1).write.mode("append").options(header="true", encoding="GBK").csv(path)
    return read_csv_table(spark, path, schema="c_custkey long, c_name string, label string")


@query("""
    select o_orderkey, o_custkey, o_totalprice from orders
    where o_orderdate >= timestamp '2000-01-01 00:00:00' and o_orderstatus = 'F'""")
def scan_pushdown(spark, sf):
    condition = "o_orderdate >= timestamp_ntz '2000-01-01 00:00:00' and o_orderstatus = 'F'"
    return read_table(parquet_source(spark, sf), "orders", ["o_orderkey", "o_custkey", "o_totalprice"], condition)


@query("""
    with m as (select * from customer where c_acctbal > 0 order by c_custkey limit 500)
    select m.c_custkey, count(o_orderkey) as n_orders, max(o_totalprice) as max_price
    from m left join orders on m.c_custkey = o_custkey group by m.c_custkey""")
def scan_many(spark, sf):
    """A limit on the main table carries over to the related one."""
    tables = read_tables(
        parquet_source(spark, sf), "customer", "orders", {"customer": "c_acctbal > 0"}, 500, [ORDERS], ["c_custkey"]
    )
    per_key = tables["orders"].groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("max_price"))
    joined = tables["customer"].join(per_key, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "max_price")


@query(alias_sql([s.name for s in ALIAS_SPECS]), name="write_wide_table")
def write_wide_table_bound(spark, sf):
    """A plan run on tables bound to other names, written and read back."""
    plan = customer_plan(*ALIAS_SPECS)
    physical = {f"prod_{n}": df for n, df in customer_tables(spark, sf).items()}
    bindings = {n.removeprefix("prod_"): n for n in physical}
    path = scratch_path(spark, "wide")
    write_wide_table(build_wide_table(plan, physical, bindings, short_alias=True), path)
    return spark.read.parquet(path).withColumnsRenamed(short_aliases(plan.feature_names()))


@query(f"""
    select c_custkey, {exact("o_totalprice")} as p_value from customer join orders on c_custkey = o_custkey
    group by c_custkey""")
def write_predictions_csv(spark, sf):
    """Key and value written as CSV parts and read back."""
    path = scratch_path(spark, "predictions")
    wide = build_wide_table(FLAGSHIP, customer_tables(spark, sf)).filter("sum_price is not null")
    write_predictions(wide.select("c_custkey", F.col("sum_price").alias("p_value")), path)
    return spark.read.option("header", "true").schema("c_custkey long, p_value double").csv(path)


@query(f"""
    select o_orderstatus as period, o_custkey, count(*) as n_orders, max(o_totalprice) as max_price
    from orders where {within("o_orderdate", CUSTOMER_AS_OF, 1000)} group by all""")
def write_by_period(spark, sf):
    """A wide table partitioned by period: one period is replaced, the others stay."""
    path = scratch_path(spark, "periods")
    orders = read(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1998-11-05").cast("timestamp_ntz"))
    wide = orders.groupBy(F.col("o_orderstatus").alias("period"), "o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price")
    )
    write_wide_table(wide.withColumn("max_price", F.when(F.col("period") != "F", F.col("max_price"))), path, period=["period"])
    write_wide_table(wide.filter("period = 'F'"), path, period=["period"])
    return spark.read.parquet(path)


@query("""
    with days as (select event_type, day(ts) as round, count(*) as n, max(event_id) as last_id from events group by all)
    select event_type, round, ('0.' || lpad((last_id % 10000)::varchar, 4, '0'))::double as best_auc,
           ('0.' || lpad(n::varchar, 4, '0'))::double as mean_auc,
           case when round % 2 = 0 then ('0.' || lpad((n + 1)::varchar, 4, '0'))::double else 0 end as best_score
    from days""")
def log_metrics(spark, sf):
    """A log with one line per event and statistics per day, parsed back into rounds."""
    events = read(spark, sf, "events").select("event_type", F.dayofmonth("ts").alias("day"), "event_id")
    days = events.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))

    def fraction(col):
        return F.concat(F.lit("0."), F.lpad(col.cast("string"), 4, "0"))

    def row(position: int, text):
        return F.struct(F.lit(position).alias("position"), text.alias("text"))

    header = F.concat(F.lit("--- 世代 "), F.col("day"), F.lit("/31 ---"))
    auc_line = F.concat(
        F.lit("[统计] 平均基础AUC: "), fraction(F.col("n")), F.lit(" (最高: "), fraction(F.col("last") % 10000), F.lit(")")
    )
    score_line = F.when(
        F.col("day") % 2 == 0,
        F.concat(F.lit("[统计] 平均综合得分: "), fraction(F.col("n")), F.lit(" (最高: "), fraction(F.col("n") + 1), F.lit(")")),
    ).otherwise(F.lit("no score"))
    marks = days.select(
        "event_type", "day", F.lit(0).cast("long").alias("event_id"),
        F.inline(F.array(row(0, header), row(2, auc_line), row(3, score_line))),
    )
    noise = events.select(
        "event_type", "day", "event_id", F.lit(1).alias("position"), F.concat(F.lit("event "), F.col("event_id")).alias("text")
    )
    path = scratch_path(spark, "logs")
    (
        marks.unionByName(noise)
        .repartition("event_type", "day")
        .sortWithinPartitions("event_type", "day", "position", "event_id")
        .select("event_type", F.col("text").alias("value"))
        .write.partitionBy("event_type")
        .text(path)
    )
    parsed = parse_training_log(spark, path)
    kind = F.regexp_extract("file", "event_type=([a-z]+)", 1)
    return parsed.select(kind.alias("event_type"), F.col("round").cast("long").alias("round"), "best_auc", "mean_auc", "best_score")
