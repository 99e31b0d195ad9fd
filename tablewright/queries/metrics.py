"""Ranking metrics and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.metrics import (
    DRAW_DIGITS,
    auc,
    bootstrap_auc,
    classification_report,
    ks,
    poisson_limits,
)
from tablewright.operators.profile import candidate_columns
from tablewright.operators.screen import KEEP_SHARE_MULTI, keep_count, screen_univariate, top_k, weakest
from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan, FeatureSpec
from tablewright.queries.base import LINES, ORDER, ORDER_AS_OF, document_tables, exact, order_tables, registry, within

QUERIES, query = registry()


def labelled_documents(spark, sf):
    tables = document_tables(spark, sf)
    return tables["labels"].join(tables["documents"], "doc_id", "left")


def steps_sql(source: str, group: str = "") -> str:
    """SQL for running counts per distinct score; ``source`` has label, score, w and the group."""
    g = f"{group}, " if group else ""
    part = f"partition by {group}" if group else ""
    return f"""
        counts as (select {g}score, sum(w * label)::bigint as pos, sum(w * (1 - label))::bigint as neg
                   from ({source}) where score is not null group by all having sum(w) > 0),
        steps as (select *, sum(pos) over ({part} order by score) as pos_upto, sum(neg) over ({part} order by score) as neg_upto,
                         sum(pos) over ({part}) as p, sum(neg) over ({part}) as n from counts)"""


_AUC = "sum(pos::double * (neg_upto - neg::double / 2.0::double)) / nullif(max(p)::double * max(n)::double, 0)"
_DOCUMENT_SCORES = "select quality as label, n_chars::double as score, 1 as w from labels left join documents using (doc_id)"


@query(f"with {steps_sql(_DOCUMENT_SCORES)} select max(p)::bigint as n_pos, max(n)::bigint as n_neg, {_AUC} as auc from steps")
def auc_exact(spark, sf):
    return auc(labelled_documents(spark, sf), "quality", "n_chars")


_LANG_SCORES = "select lang, quality as label, n_chars::double as score, 1 as w from labels join documents using (doc_id)"


@query(f"with {steps_sql(_LANG_SCORES, 'lang')} select lang, max(p)::bigint as n_pos, max(n)::bigint as n_neg, {_AUC} as auc from steps group by lang")
def auc_by_language(spark, sf):
    return auc(labelled_documents(spark, sf), "quality", "n_chars", ["lang"])


_GAPS = """gaps as (select *, p - pos_upto + pos as tp, n - neg_upto + neg as fp,
        abs((p - pos_upto + pos)::double / p - (n - neg_upto + neg)::double / n) as gap from steps),
    best as (select * from gaps order by gap desc, score limit 1)"""


@query(f"""
    with {steps_sql(_DOCUMENT_SCORES)}, {_GAPS}
    select gap as ks, score as threshold, tp::bigint as tp, fp::bigint as fp, (n - fp)::bigint as tn, (p - tp)::bigint as fn
    from best""")
def ks_threshold(spark, sf):
    return ks(labelled_documents(spark, sf), "quality", "n_chars")


_ORDER_SCORES = """select (o_orderstatus = 'F')::int as label, round(o_totalprice / 1000)::double as score, 1 as w from orders"""


@query(f"""
    with {steps_sql(_ORDER_SCORES)}, {_GAPS}, a as (select {_AUC} as auc from steps)
    select p::bigint as n_pos, n::bigint as n_neg, auc, gap as ks, score as threshold, tp::bigint as tp, fp::bigint as fp,
           (n - fp)::bigint as tn, (p - tp)::bigint as fn, round(tp::double / (tp + fp), 4) as "precision",
           round(tp::double / p, 4) as recall, round((2 * tp)::double / (2 * tp + fp + p - tp), 4) as f1
    from best, a""")
def confusion_at_ks(spark, sf):
    orders = order_tables(spark, sf)["orders"].withColumn("score", F.round(F.col("o_totalprice") / 1000))
    return classification_report(orders, "is_f", "score")


def _weight(digits: str) -> str:
    return " + ".join(f"({digits} >= '{limit}')::int" for limit in poisson_limits())


_RESAMPLES = f"""select replicate, is_f as label, o_totalprice as score,
        {_weight(f"substr(h, (1 + {DRAW_DIGITS} * replicate)::int, {DRAW_DIGITS})")} as w
    from (select (o_orderstatus = 'F')::int as is_f, o_totalprice, md5(o_orderkey::varchar || '|42|0') as h,
                 unnest([0, 1, 2, 3, 4]) as replicate from orders)"""


@query(f"with {steps_sql(_RESAMPLES, 'replicate')} select replicate, max(p)::bigint as n_pos, max(n)::bigint as n_neg, {_AUC} as auc from steps group by replicate")
def auc_bootstrap(spark, sf):
    return bootstrap_auc(order_tables(spark, sf)["orders"], ["o_orderkey"], "is_f", "o_totalprice")


def screen_sql(source: str, features: list[str]) -> str:
    """SQL ending in ``screened``: feature, position, auc and score for columns of ``source`` with a ``label``."""
    values = " union all ".join(f"""select '{f}' as feature, label, "{f}"::double as score, 1 as w from src""" for f in features)
    place = " ".join(f"when '{f}' then {i}" for i, f in enumerate(features))
    return f"""with src as ({source}), {steps_sql(values, "feature")},
        scored as (select feature, {_AUC} as auc from steps group by feature),
        screened as (select feature, case feature {place} end as position, auc, abs(auc - 0.5::double) as score from scored)"""


DOCUMENT_FEATURES = ["toxic", "text", "lang", "source", "n_chars"]
DOCUMENT_CODES_SQL = """select quality as label, toxic, n_chars, dense_rank() over (order by coalesce(text, '__missing__')) as text,
    dense_rank() over (order by coalesce(lang, '__missing__')) as lang, dense_rank() over (order by coalesce(source, '__missing__')) as source
    from labels left join documents using (doc_id)"""


@query(f"{screen_sql(DOCUMENT_CODES_SQL, DOCUMENT_FEATURES)} select * from screened", name="screen_univariate")
def screen_documents(spark, sf):
    joined = labelled_documents(spark, sf)
    return screen_univariate(joined, "quality", candidate_columns(joined, ["doc_id"], "quality"))


ORDER_SPECS = [
    FeatureSpec("LATEST", "orders", "o_totalprice"),
    FeatureSpec("LATEST", "orders", "o_orderpriority"),
    FeatureSpec("COUNT", "lineitem", alias="n_lines"),
    FeatureSpec("SUM", "lineitem", "l_extendedprice", scale=2),
    FeatureSpec("AVG", "lineitem", "l_quantity", scale=2),
    FeatureSpec("MAX", "lineitem", "l_discount"),
    FeatureSpec("MIN", "lineitem", "l_tax"),
    FeatureSpec("SUM", "lineitem", "l_extendedprice", 365, scale=2),
    FeatureSpec("MAX", "lineitem", "l_quantity", 365),
    FeatureSpec("RATE", "lineitem", predicate="l_returnflag = 'R'", alias="return_rate"),
]
ORDER_PLAN = FeaturePlan(ORDER, ORDER_SPECS, (LINES,), ORDER_AS_OF, exclude=("o_orderstatus",))
ORDER_FEATURES = ORDER_PLAN.feature_names()
_YEAR = within("l_shipdate", ORDER_AS_OF, 365)
ORDER_MATRIX_SQL = f"""select o_orderkey, (o_orderstatus = 'F')::int as label, o_totalprice as "LATEST_orders_o_totalprice",
        dense_rank() over (order by o_orderpriority) as "LATEST_orders_o_orderpriority", f.* exclude (l_orderkey)
    from orders left join (select l_orderkey, count(*) as n_lines, {exact("l_extendedprice")} as "SUM_lineitem_l_extendedprice",
            {exact("l_quantity", 2, "avg")} as "AVG_lineitem_l_quantity", max(l_discount) as "MAX_lineitem_l_discount",
            min(l_tax) as "MIN_lineitem_l_tax",
            sum(case when {_YEAR} then cast(l_extendedprice as decimal(18,2)) end)::double as "SUM_lineitem_l_extendedprice_365d",
            max(case when {_YEAR} then l_quantity end) as "MAX_lineitem_l_quantity_365d",
            (count(*) filter (l_returnflag = 'R'))::double / count(*) as return_rate
        from lineitem group by l_orderkey) f on o_orderkey = l_orderkey"""
ORDER_SCREEN_SQL = screen_sql(ORDER_MATRIX_SQL, ORDER_FEATURES)


def order_matrix(spark, sf):
    return build_wide_table(ORDER_PLAN, order_tables(spark, sf))


def order_screen(spark, sf):
    return screen_univariate(order_matrix(spark, sf), "is_f", ORDER_FEATURES)


@query(f"{ORDER_SCREEN_SQL} select * from screened")
def screen_orders(spark, sf):
    return order_screen(spark, sf)


@query(f"{ORDER_SCREEN_SQL} select * from screened order by score desc, position limit {keep_count(len(ORDER_FEATURES), KEEP_SHARE_MULTI)}")
def top_k_features(spark, sf):
    return top_k(order_screen(spark, sf), keep_count(len(ORDER_FEATURES), KEEP_SHARE_MULTI))


@query(f"{ORDER_SCREEN_SQL} select feature, score from screened order by score, position limit 1")
def weakest_feature(spark, sf):
    return weakest(order_screen(spark, sf))
