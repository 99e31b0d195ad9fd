"""Facts about tables and their schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import orphan_keys
from tablewright.operators.labels import class_check, normalise_label, text_label_codes
from tablewright.operators.prep import categories_as_text
from tablewright.operators.profile import (
    baseline_matrix,
    candidate_columns,
    column_coverage,
    logical_view,
    reconcile,
    relation_cardinality,
)
from tablewright.plans.compile import build_wide_table
from tablewright.queries.base import customer_tables, document_tables, order_tables, read, registry, within
from tablewright.queries.base import CUSTOMER_AS_OF
from tablewright.queries.features import PRICE, customer_plan, price

QUERIES, query = registry()

KEYS = [
    ("orders", "o_custkey"),
    ("nation", "n_nationkey"),
    ("lineitem", "l_orderkey"),
    ("documents", "doc_id"),
    ("events", "user_id"),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(
    " union all ".join(
        f"""select '{t}.{k}' as relation, count(*) as n_rows, count(distinct {k}) as n_keys,
            count(distinct {k})::double / count(*) as uniqueness,
            case when count(distinct {k})::double / count(*) > 0.95 then '1:1' else '1:N' end as kind from {t}"""
        for t, k in KEYS
    ),
    name="relation_cardinality",
)
def relation_kinds(spark, sf):
    return _union([relation_cardinality(read(spark, sf, t), [k], f"{t}.{k}") for t, k in KEYS])


@query("""
    select 'orders' as main, count(*) as n_rows, count(distinct o_orderstatus = 'F') as n_classes,
           count(*) filter (o_orderstatus = 'F') as n_pos, 1 as usable from orders
    union all
    select 'labels', count(*), count(distinct quality), count(*) filter (quality = 1), 1 from labels""", name="class_check")
def class_checks(spark, sf):
    orders = class_check(order_tables(spark, sf)["orders"], "is_f").withColumn("main", F.lit("orders"))
    labels = class_check(read(spark, sf, "labels"), "quality").withColumn("main", F.lit("labels"))
    return orders.unionByName(labels)


@query("""
    select 'lineitem -> orders' as relation, count(distinct l_orderkey) as orphan_keys, count(*) as orphan_rows
    from lineitem where l_orderkey not in (select o_orderkey from orders)
    union all
    select 'orders -> lineitem', count(distinct o_orderkey), count(*)
    from orders where o_orderkey not in (select l_orderkey from lineitem)
    union all
    select 'labels -> documents', count(distinct doc_id), count(*)
    from labels where doc_id not in (select doc_id from documents)""", name="orphan_keys")
def orphans(spark, sf):
    tables = {n: read(spark, sf, n) for n in ("orders", "lineitem", "labels", "documents")}
    pairs = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    ]
    return _union([orphan_keys(tables[a], tables[b], ka, kb, f"{a} -> {b}") for a, ka, b, kb in pairs])


_RECENT = within("o_orderdate", CUSTOMER_AS_OF, 30)


@query(f"""
    with w as (select count(*) as n, count(x.s) as s, count(x.r) as r from customer left join (
        select o_custkey, sum({PRICE}) as s, max(case when {_RECENT} then {PRICE} end) as r
        from orders group by o_custkey) x on c_custkey = o_custkey)
    select 'c_custkey' as feature, n as non_null, 1 as keep from w union all
    select 'sum_price', s, (s > 0)::int from w union all
    select 'max_price_30d', r, (r > 0)::int from w union all
    select 'nothing', 0, 0 from w""", name="column_coverage")
def column_coverages(spark, sf):
    wide = build_wide_table(
        customer_plan(price("SUM", alias="sum_price"), price("MAX", 30, "max_price_30d")), customer_tables(spark, sf)
    )
    return column_coverage(wide.withColumn("nothing", F.lit(None).cast("double")))


@query("""
    select toxic, coalesce(text, '__missing__') as text, coalesce(lang, '__missing__') as lang,
           coalesce(source, '__missing__') as source, n_chars, quality
    from labels left join documents using (doc_id)""", name="baseline_matrix")
def baseline_table(spark, sf):
    tables = document_tables(spark, sf)
    joined = tables["labels"].join(tables["documents"], "doc_id", "left")
    return categories_as_text(baseline_matrix(joined, "quality", ["doc_id"]), ["text", "lang", "source"])


@query("""
    select 'documents' as table_name, feature, non_null, 1 as keep from (
        select count(text) as text, count(lang) as lang, count(source) as source, count(n_chars) as n_chars from documents)
        unpivot (non_null for feature in (text, lang, source, n_chars))
    union all
    select 'conversations', feature, non_null, 1 from (
        select count(turn) as turn, count(role) as role, count(text) as text from conversations)
        unpivot (non_null for feature in (turn, role, text))
    union all
    select 'events', feature, non_null, 1 from (
        select count(ts) as ts, count(event_type) as event_type, count(value) as value, count(props) as props from events)
        unpivot (non_null for feature in (ts, event_type, value, props))""", name="candidate_columns")
def candidate_column_counts(spark, sf):
    """Candidate columns of tables with ids, and how many values each holds."""
    parts = []
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id"), ("events", "user_id")):
        df = read(spark, sf, name)
        columns = candidate_columns(df, [key])
        parts.append(column_coverage(df, columns).withColumn("table_name", F.lit(name)))
    return _union(parts)


@query("""
    select c_custkey as customer_key, c_acctbal as balance, c_mktsegment as segment
    from customer""", name="logical_view")
def logical_customer(spark, sf):
    names = {"c_custkey": "customer_key", "c_acctbal": "balance", "c_mktsegment": "segment"}
    return logical_view(read(spark, sf, "customer"), names, exclude=["c_name", "c_nationkey"])


_DECLARED = {"customer": ["c_custkey", "c_acctbal", "c_phone"], "orders": ["o_orderkey"], "payments": ["p_id"]}


@query(f"""
    with config(table_name, column_name) as (values
        {", ".join(f"('{t}', '{c}')" for t, cols in _DECLARED.items() for c in cols)}),
    data as (
        select 'customer' as table_name, column_name, non_null from (
            select count(c_custkey) as c_custkey, count(c_name) as c_name, count(c_nationkey) as c_nationkey,
                   count(c_acctbal) as c_acctbal, count(c_mktsegment) as c_mktsegment from customer)
            unpivot (non_null for column_name in (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))
        union all
        select 'nation', column_name, non_null from (
            select count(n_nationkey) as n_nationkey, count(n_name) as n_name, count(n_regionkey) as n_regionkey from nation)
            unpivot (non_null for column_name in (n_nationkey, n_name, n_regionkey))
        union all
        select 'orders', column_name, non_null from (
            select count(o_orderkey) as o_orderkey, count(o_custkey) as o_custkey, count(o_orderstatus) as o_orderstatus,
                   count(o_totalprice) as o_totalprice, count(o_orderdate) as o_orderdate,
                   count(o_orderpriority) as o_orderpriority from orders)
            unpivot (non_null for column_name in (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)))
    select coalesce(d.table_name, c.table_name) as "table", coalesce(d.column_name, c.column_name) as "column",
           case when c.table_name is null and d.table_name in ('customer', 'orders') then 'added'
                when c.table_name is null then 'only_data' when d.table_name is null then 'only_config' else 'matched' end as status,
           coalesce(non_null, 0) as non_null
    from config c full join data d on c.table_name = d.table_name and c.column_name = d.column_name""")
def schema_reconcile(spark, sf):
    return reconcile(spark, _DECLARED, customer_tables(spark, sf), autofill=True)


_RAW_LABEL = "case o_orderstatus when 'F' then 'yes' when 'O' then '?' else (o_orderkey % 4)::varchar end"


def _raw_label():
    status, number = F.col("o_orderstatus"), (F.col("o_orderkey") % 4).cast("string")
    return F.when(status == "F", "yes").when(status == "O", "?").otherwise(number)


@query(f"""
    with raw as (select o_orderkey, {_RAW_LABEL} as label from orders)
    select o_orderkey, case label when 'yes' then 1 when '?' then 0 else label::int end as label
    from raw where label in ('yes', '?', '0', '1')""")
def label_normalise(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", _raw_label().alias("label"))
    return normalise_label(orders, "LABEL", {"yes": 1, "no": 0}, on_bad_label="zero")


@query(f"""
    with raw as (select o_orderkey, case {_RAW_LABEL} when 'yes' then '1' else {_RAW_LABEL} end as label from orders)
    select o_orderkey, dense_rank() over (order by label) - 1 as label_code from raw""")
def label_text_map(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", _raw_label().alias("label"))
    return text_label_codes(orders, "label").drop("label")
