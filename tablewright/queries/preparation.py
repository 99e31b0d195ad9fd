"""Columns prepared for modelling, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.prep import impute_median, label_encode, log_scale, mixed_encode, one_hot, standard_scale
from tablewright.operators.sampling import hash_sample, stratified_folds
from tablewright.plans.compile import build_wide_table
from tablewright.queries.base import CUSTOMER_AS_OF, customer_tables, document_tables, order_tables, read, registry, within
from tablewright.queries.features import PRICE, customer_plan, price

QUERIES, query = registry()

_YEAR = within("o_orderdate", CUSTOMER_AS_OF, 365)


def _median(column: str) -> str:
    """SQL for the mean of the two middle values."""
    ranked = f"(select {column} as v, row_number() over (order by {column}) as rn, count(*) over () as n from w where {column} is not null)"
    return f"(select (max(v) filter (rn = (n + 1) // 2) + max(v) filter (rn = n // 2 + 1)) / 2.0::double from {ranked})"


@query(f"""
    with w as (select c_custkey, c_acctbal, max_price, n_year from customer left join (
        select o_custkey, max(case when {_YEAR} then {PRICE} end) as max_price,
               case when count(*) filter ({_YEAR}) > 0 then count(*) filter ({_YEAR}) end as n_year
        from orders group by o_custkey) on c_custkey = o_custkey)
    select c_custkey, coalesce(c_acctbal, {_median("c_acctbal")}) as c_acctbal,
           coalesce(max_price, {_median("max_price")}) as max_price, coalesce(n_year, {_median("n_year")})::double as n_year
    from w""", name="impute_median")
def impute_medians(spark, sf):
    plan = customer_plan(
        price("MAX", 365, "max_price"),
        price("COUNT", 365, "n_year"),
    )
    wide = build_wide_table(plan, customer_tables(spark, sf))
    balance = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return impute_median(wide.join(balance, "c_custkey"), ["c_acctbal", "max_price", "n_year"])


@query("""
    select doc_id, dense_rank() over (order by coalesce(lang, '__missing__')) - 1 as lang_code,
           dense_rank() over (order by coalesce(nullif(source, 'src0'), '__missing__')) - 1 as source_code,
           dense_rank() over (order by text) - 1 as text_code
    from documents""", name="label_encode")
def label_encodes(spark, sf):
    """Codes of two short columns, one with missing values, and of whole texts."""
    documents = read(spark, sf, "documents").withColumn("source", F.nullif("source", F.lit("src0")))
    return label_encode(documents, ["lang", "source", "text"]).select("doc_id", "lang_code", "source_code", "text_code")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"""
    select c_custkey, c_acctbal, {", ".join(f"(c_mktsegment = '{s}')::int as c_mktsegment_{s}" for s in _SEGMENTS)}
    from customer""", name="one_hot")
def one_hot_segments(spark, sf):
    return one_hot(read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_mktsegment"])


@query("""
    select o_orderkey::double as o_orderkey, coalesce(n_lines, -99)::double as n_lines,
           (o_orderstatus = 'F')::int as o_orderstatus_F, (o_orderstatus = 'O')::int as o_orderstatus_O,
           (o_orderstatus = 'P')::int as o_orderstatus_P
    from orders left join (select l_orderkey, count(*) as n_lines from lineitem group by 1) on o_orderkey = l_orderkey""", name="mixed_encode")
def mixed_encodes(spark, sf):
    tables = order_tables(spark, sf)
    lines = tables["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    wide = tables["orders"].select("o_orderkey", "o_orderstatus", "o_custkey").join(lines, "o_orderkey", "left")
    return mixed_encode(wide, ["o_orderstatus"], drop=["o_custkey"])


@query("""
    select c_custkey, case when c_acctbal > -1 then round(ln(1 + c_acctbal), 6) end as log_balance from customer""", name="log_scale")
def log_scales(spark, sf):
    scaled = log_scale(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return scaled.select("c_custkey", F.round("log1p_c_acctbal", 6).alias("log_balance"))


@query("""
    select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) as z_price
    from orders""", name="standard_scale")
def standard_scales(spark, sf):
    scaled = standard_scale(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return scaled.select("o_orderkey", F.round("z_o_totalprice", 6).alias("z_price"))


@query("""
    select doc_id, quality, toxic,
           (row_number() over (partition by quality order by md5(doc_id::varchar || '|42')) % 3)::int as fold
    from labels""", name="stratified_folds")
def stratified_fold_table(spark, sf):
    return stratified_folds(document_tables(spark, sf)["labels"], ["doc_id"], "quality")


@query("""
    select o_orderkey, o_custkey, o_totalprice from orders order by md5(o_orderkey::varchar || '|42') limit 8000""", name="hash_sample")
def hash_sample_orders(spark, sf):
    return hash_sample(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 8000)
