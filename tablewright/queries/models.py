"""Fitting, comparing and applying models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.jobs import ROUNDS, SUBSETS
from tablewright.operators.boosting import BINS, LEAST_HESSIAN, tree_rows
from tablewright.operators.metrics import auc
from tablewright.operators.model import (
    DEFAULT_PRESET,
    PRESETS,
    fit_final,
    load_model,
    model_scores,
    oof_scores,
    permutation_importance,
    save_model,
    screen_gbt,
)
from tablewright.operators.report import evaluation_report
from tablewright.operators.shapley import shapley_importance, shapley_values
from tablewright.operators.score import score_raw, score_wide, with_prediction
from tablewright.operators.search import (
    best_candidate,
    build_pool,
    leaderboard,
    refine_subset,
    round_stats,
    sample_subsets,
    search,
    size_range,
    spec_rows,
)
from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan
from tablewright.queries.base import DOCUMENTS, LABEL, LINES, ORDER, ORDER_AS_OF, document_tables, order_tables, registry
from tablewright.queries.features import GRID_COLUMNS, GRID_OPS
from tablewright.queries.metrics import (
    DOCUMENT_CODES_SQL,
    ORDER_FEATURES,
    ORDER_PLAN,
    ORDER_SCREEN_SQL,
    order_matrix,
    order_screen,
    screen_sql,
)
from tablewright.session import materialise, scratch_path
from tablewright.streaming.scoring import score_stream, wide_stream

QUERIES, query = registry()

KEY, TARGET = ["o_orderkey"], "is_f"
TEXT = ["LATEST_orders_o_orderpriority"]


def order_model(spark, sf):
    """Each query fits its own model of the default preset: nothing is kept from one call to the next."""
    return fit_final(order_matrix(spark, sf), TARGET, ORDER_FEATURES)


@query(name="screen_gbt")
def screen_gbt_orders(spark, sf):
    return screen_gbt(order_matrix(spark, sf), TARGET, ORDER_FEATURES)


@query(name="permutation_importance")
def permutation_importances(spark, sf):
    return permutation_importance(order_matrix(spark, sf), KEY, TARGET, ORDER_FEATURES, order_model(spark, sf))


@query()
def shap_importance(spark, sf):
    """Mean absolute Shapley value of each feature over all rows, the 50 largest first."""
    return shapley_importance(order_matrix(spark, sf), order_model(spark, sf)).limit(50)


@query("select count(*)::bigint as n_rows, 0::bigint as n_differing from orders")
def shap_values(spark, sf):
    """Shapley values of every row sum to its margin less the mean margin."""
    values = shapley_values(order_matrix(spark, sf), order_model(spark, sf), KEY)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    differs = F.abs(total + F.col("mean") - F.col("margin")) > 1e-9
    return values.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_differing"))


# The first tree of a model on three columns of orders, found by trying every split in SQL.
TREE_FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority"]
TREE_LEAVES = 4
_TREE = PRESETS[DEFAULT_PRESET]


def _tree_step_sql(i: int) -> str:
    """SQL for split ``i``: the best of all splits of all leaves, and the leaf of every row after it."""
    l1, l2 = _TREE["l1"], _TREE["l2"]

    def score(g: str, h: str) -> str:
        return f"greatest(abs({g}) - {l1}, 0) ^ 2 / ({h} + {l2})"

    return f"""
    sums{i} as (select node, f, b, sum(g) as g, sum(h) as h, count(*) as c from long join at{i - 1} using (id) group by all),
    sides{i} as (
        select node, f, b, sum(g) over whole as gt, sum(h) over whole as ht, sum(c) over whole as ct,
            case when f < 2 then sum(g) over upto else g end as gl, case when f < 2 then sum(h) over upto else h end as hl,
            case when f < 2 then sum(c) over upto else c end as cl
        from sums{i} window whole as (partition by node, f), upto as (partition by node, f order by b)),
    gains{i} as (select *, {score("gl", "hl")} + {score("gt - gl", "ht - hl")} - {score("gt", "ht")} as gain from sides{i}
        where least(cl, ct - cl) >= {int(_TREE["min_rows"])} and least(hl, ht - hl) >= {LEAST_HESSIAN}),
    best{i} as (select * from gains{i} where gain > 1e-9 order by round(gain, 7) desc, f, b limit 1),
    at{i} as (select a.id, case when s.node is null then a.node
            when (s.f < 2 and l.b <= s.b) or (s.f = 2 and l.b = s.b) then {2 * i - 1} else {2 * i} end as node
        from at{i - 1} a left join best{i} s on a.node = s.node left join long l on l.id = a.id and l.f = s.f)"""


_LEAFWISE_SQL = f"""
with base as (
    select o_orderkey as id, (o_orderstatus = 'F')::int as y, o_totalprice::double as x0, o_custkey::double as x1, o_orderpriority as x2 from orders),
counts as (select sum(y)::double as n1, sum(1 - y)::double as n0 from base),
weighed as (select base.*, case when y = 1 then greatest(n0 / n1, 1) else greatest(n1 / n0, 1) end as w from base, counts),
numbers as (select 0 as f, x0 as v, count(*) as n from base group by all union all select 1, x1, count(*) from base group by all),
steps as (select *, sum(n) over (partition by f order by v) as upto, sum(n) over (partition by f) as total,
    row_number() over (partition by f order by v) as i, count(*) over (partition by f) as kinds from numbers),
bins as (select f, v, (case when kinds <= {BINS} then i - 1 else ((upto - 1) * {BINS}) // total end)::int as b from steps),
texts as (select x2, (dense_rank() over (order by x2))::int as b from (select distinct x2 from base)),
long as (
    select id, f, b, w * (0.5 - y) as g, w * 0.25 as h from weighed join bins on f = 0 and v = x0
    union all select id, f, b, w * (0.5 - y), w * 0.25 from weighed join bins on f = 1 and v = x1
    union all select id, 2, b, w * (0.5 - y), w * 0.25 from weighed join texts using (x2)),
at0 as (select id, 0 as node from base), {", ".join(_tree_step_sql(i) for i in range(1, TREE_LEAVES))},
splits as ({" union all ".join(f"select f, b, cl, ct from best{i}" for i in range(1, TREE_LEAVES))})
select ['o_totalprice', 'o_custkey', 'o_orderpriority'][f + 1] as feature,
    (select max(v) from bins where bins.f = splits.f and bins.b = splits.b) as threshold,
    (select x2 from texts where splits.f = 2 and texts.b = splits.b) as category,
    cl::bigint as n_left, (ct - cl)::bigint as n_right
from splits"""


@query(_LEAFWISE_SQL)
def leafwise_trees(spark, sf):
    """The splits of a first tree: the leaf of the largest gain first, penalties counted."""
    orders = order_tables(spark, sf)["orders"]
    nodes = tree_rows(spark, fit_final(orders, TARGET, TREE_FEATURES, {**_TREE, "trees": 1, "leaves": TREE_LEAVES}))
    rows = nodes.select(F.col("node").alias("child"), "n_rows")
    left = rows.withColumnsRenamed({"child": "left", "n_rows": "n_left"})
    right = rows.withColumnsRenamed({"child": "right", "n_rows": "n_right"})
    return nodes.filter("feature is not null").join(left, "left").join(right, "right").select("feature", "threshold", "category", "n_left", "n_right")


@query()
def oof_predictions(spark, sf):
    return oof_scores(order_matrix(spark, sf), KEY, TARGET, ORDER_FEATURES)


@query(name="evaluation_report")
def evaluation_reports(spark, sf):
    scored = oof_scores(order_matrix(spark, sf), KEY, TARGET, ORDER_FEATURES)
    return evaluation_report(scored, KEY, TARGET, "score", "orders", ORDER_FEATURES)


def _pool_sql(table: str, features: list[str], first: int) -> str:
    """SQL for the columns of a table in order of their screening scores."""
    return f"""select 'LATEST_{table}_' || feature as feature, 'LATEST' as op, '{table}' as "table", feature as "column",
            (row_number() over (order by score desc, position) + {first - 1})::int as position
        from ({screen_sql(DOCUMENT_CODES_SQL, features)} select * from screened)"""


@query(f"{_pool_sql('labels', ['toxic'], 0)} union all {_pool_sql('documents', ['text', 'lang', 'source', 'n_chars'], 1)}")
def initial_pool(spark, sf):
    """The pool for labelled documents: screened columns of the main table, then of its snapshot."""
    pool = build_pool(FeaturePlan(LABEL, (), (DOCUMENTS,)), document_tables(spark, sf))
    return spec_rows(spark, pool).select("feature", "op", "table", "column", "position")


_ORDER_COLUMNS = ["o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDER_CODES_SQL = """select (o_orderstatus = 'F')::int as label, o_totalprice, dense_rank() over (order by o_orderdate) as o_orderdate,
    dense_rank() over (order by o_orderpriority) as o_orderpriority from orders"""
_GRID_ROWS = ", ".join(
    f"('{op}_lineitem_{c}_{d}d', '{op}', 'lineitem', '{c}', {d}, {i})"
    for i, (c, op, d) in enumerate(
        ((c, op, d) for c in GRID_COLUMNS for op in GRID_OPS for d in (30, 90, 365)), start=len(_ORDER_COLUMNS)
    )
)


@query(f"""
    select 'LATEST_orders_' || feature as feature, 'LATEST' as op, 'orders' as "table", feature as "column",
           null::int as window_days, (row_number() over (order by score desc, position) - 1)::int as position
    from ({screen_sql(_ORDER_CODES_SQL, _ORDER_COLUMNS)} select * from screened)
    union all
    select feature, op, "table", "column", window_days, position
    from (values {_GRID_ROWS}) as grid(feature, op, "table", "column", window_days, position)""")
def initial_pool_orders(spark, sf):
    """The pool for orders: screened columns, then the window grid over the lines."""
    plan = FeaturePlan(ORDER, (), (LINES,), ORDER_AS_OF, exclude=("o_orderstatus", "o_custkey", "l_partkey", "l_suppkey"))
    return spec_rows(spark, build_pool(plan, order_tables(spark, sf))).select(
        "feature", "op", "table", "column", "window_days", "position"
    )


N_SUBSETS = 6
_LEAST, _MOST = size_range(len(ORDER_FEATURES))
_SUBSETS_SQL = f"""
    subsets as (select * from (
        select subset_id, feature, position,
               row_number() over (partition by subset_id order by md5(subset_id::varchar || '|' || feature || '|42'), feature) as pick
        from screened, (select unnest(range(1, {N_SUBSETS + 1})) as subset_id))
    where pick <= {_LEAST} + ('0x' || substr(md5('size|' || subset_id::varchar || '|42'), 1, 8))::bigint % {_MOST - _LEAST + 1})"""


@query(f"{ORDER_SCREEN_SQL}, {_SUBSETS_SQL} select subset_id::int as subset_id, feature, position, pick::int as pick from subsets")
def subset_table(spark, sf):
    return sample_subsets(order_screen(spark, sf), N_SUBSETS, len(ORDER_FEATURES))


@query(f"""{ORDER_SCREEN_SQL}, {_SUBSETS_SQL},
    mine as (select feature, position, score from subsets join screened using (feature, position) where subset_id = 2),
    worst as (select feature from mine order by score, position limit 1),
    fresh as (select feature, position from screened where feature not in (select feature from mine)
              order by md5(feature || '|42'), feature limit 1)
    select coalesce(f.feature, m.feature) as feature, coalesce(f.position, m.position) as position,
           (f.feature is not null)::int as replaced
    from mine m left join (select w.feature as old, fresh.* from worst w, fresh) f on m.feature = f.old""", name="refine_subset")
def refined_subset(spark, sf):
    scores = order_screen(spark, sf)
    subset = sample_subsets(scores, N_SUBSETS, len(ORDER_FEATURES)).filter("subset_id = 2")
    return refine_subset(subset, scores, scores.select("feature", "position"))


@query(name="leaderboard")
def leaderboard_orders(spark, sf):
    picked = sample_subsets(order_screen(spark, sf), N_SUBSETS, len(ORDER_FEATURES))
    members: dict[int, list[str]] = {}
    for row in picked.orderBy("subset_id", "pick").collect():
        members.setdefault(row["subset_id"], []).append(row["feature"])
    return leaderboard(order_matrix(spark, sf), KEY, TARGET, members)


@query()
def search_rounds(spark, sf):
    """All rounds, from the second on with a refined winner: statistics per round and the best candidate."""
    wide = materialise(order_matrix(spark, sf))
    board = search(wide, KEY, TARGET, ORDER_FEATURES, ROUNDS, SUBSETS).board
    best = best_candidate(board).select("round", F.col("subset_id").alias("best_subset"))
    return round_stats(board).join(best, "round", "left")


@query(name="score_raw")
def score_raw_tables(spark, sf, model=None):
    return score_raw(ORDER_PLAN, order_tables(spark, sf), model or order_model(spark, sf))


@query(name="score_wide")
def score_wide_table(spark, sf, model=None):
    wide = build_wide_table(ORDER_PLAN, order_tables(spark, sf), short_alias=True, scoring=True)
    aliases = dict(zip(wide.columns[1:], ORDER_FEATURES))
    scored = score_wide(wide, model or order_model(spark, sf), KEY, ORDER_FEATURES, aliases, text=TEXT)
    return with_prediction(scored, "p_value")


@query("select count(*)::bigint as n_rows, 0::bigint as n_differing from orders")
def score_routes_agree(spark, sf):
    """Raw tables and the stored wide table give the same probabilities with the defaults."""
    model = order_model(spark, sf)
    raw = score_raw_tables(spark, sf, model)
    wide = score_wide_table(spark, sf, model).withColumnRenamed("p_value", "p_wide")
    both = raw.join(wide, KEY, "full")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("p_value").eqNullSafe(F.col("p_wide"))).alias("n_differing")
    )


@query()
def score_wide_stream(spark, sf):
    """The wide table scored file by file as it arrives."""
    model = order_model(spark, sf)
    arriving, out = scratch_path(spark, "wide"), scratch_path(spark, "scores")
    wide = build_wide_table(ORDER_PLAN, order_tables(spark, sf), scoring=True)
    wide.repartition(4, "o_orderkey").write.parquet(arriving)
    stream = wide_stream(spark, arriving, wide.schema, files_per_trigger=2)
    score_stream(stream, model, KEY, ORDER_FEATURES, out, scratch_path(spark, "progress"), text=TEXT).awaitTermination()
    return spark.read.parquet(out)


@query("select count(*)::bigint as n_rows, 0::bigint as n_differing from orders")
def model_reload(spark, sf):
    """A model written and read back scores every row as before."""
    path, wide = scratch_path(spark, "model"), materialise(order_matrix(spark, sf))
    model = fit_final(wide, TARGET, ORDER_FEATURES)
    save_model(model, path)
    before = model_scores(wide, model, ORDER_FEATURES, KEY, "before")
    after = model_scores(wide, load_model(path), ORDER_FEATURES, KEY, "after")
    both = before.join(after, KEY, "full")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_differing"))


@query()
def model_reload_auc(spark, sf):
    """A model written, read back and measured on all rows."""
    path, wide = scratch_path(spark, "model"), materialise(order_matrix(spark, sf))
    save_model(fit_final(wide, TARGET, ORDER_FEATURES), path)
    return auc(model_scores(wide, load_model(path), ORDER_FEATURES, [TARGET]), TARGET, "score")
