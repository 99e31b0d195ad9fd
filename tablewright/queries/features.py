"""Wide tables and the features that make them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.columns import sql_exact_sum
from tablewright.operators.asof import asof_latest, asof_windows
from tablewright.operators.derive import cross_feature, ratio_bands
from tablewright.operators.joins import group_feature
from tablewright.operators.score import align_features, restore_names
from tablewright.plans.compile import build_wide_table
from tablewright.plans.grid import window_grid
from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, Relationship, short_aliases
from tablewright.plans.store import plan_from_dict
from tablewright.queries.base import (
    CUSTOMER,
    CUSTOMER_AS_OF,
    DOCUMENTS,
    EVENT_AS_OF,
    EVENTS,
    LABEL,
    LINES,
    NATION,
    ORDER,
    ORDER_AS_OF,
    ORDERS,
    USER,
    customer_tables,
    document_tables,
    event_tables,
    exact,
    order_tables,
    registry,
    within,
    read,
)

QUERIES, query = registry()

PRICE = "o_totalprice"


def price(op: str, days: int | None = None, alias: str | None = None) -> FeatureSpec:
    return FeatureSpec(op, "orders", PRICE, days, scale=2, alias=alias)


def customer_plan(*specs: FeatureSpec) -> FeaturePlan:
    return FeaturePlan(CUSTOMER, specs, (ORDERS, NATION), CUSTOMER_AS_OF)


def customer_sql(*columns: str) -> str:
    return f"""select c.c_custkey, f.* exclude (o_custkey) from customer c left join (
        select o_custkey, {", ".join(columns)} from orders group by o_custkey) f on c.c_custkey = f.o_custkey"""


FLAGSHIP = customer_plan(
    FeatureSpec("COUNT", "orders", alias="n_orders"),
    price("SUM", alias="sum_price"),
    price("AVG", alias="avg_price"),
    price("MAX", alias="max_price"),
    price("MIN", alias="min_price"),
    price("SUM", 365, "sum_price_365d"),
    price("MAX", 365, "max_price_365d"),
    price("COUNT", 365, "n_orders_365d"),
    FeatureSpec("LATEST", "orders", "o_orderpriority", order_by=("o_orderdate", "o_orderkey"), alias="latest_priority"),
    FeatureSpec("LATEST", "customer", "c_acctbal", alias="account_balance"),
    FeatureSpec("LATEST", "nation", "n_name", alias="nation_name"),
)
_IN_YEAR = within("o_orderdate", CUSTOMER_AS_OF, 365)


@query(f"""
    select c.c_custkey, f.* exclude (o_custkey), l.o_orderpriority as latest_priority,
           c.c_acctbal as account_balance, n.n_name as nation_name
    from customer c
    left join (
        select o_custkey, count(*) as n_orders, {exact(PRICE)} as sum_price, {exact(PRICE, 2, "avg")} as avg_price,
               max({PRICE}) as max_price, min({PRICE}) as min_price,
               sum(case when {_IN_YEAR} then cast({PRICE} as decimal(18,2)) end)::double as sum_price_365d,
               max(case when {_IN_YEAR} then {PRICE} end) as max_price_365d,
               case when count(*) filter ({_IN_YEAR}) > 0 then count({PRICE}) filter ({_IN_YEAR}) end as n_orders_365d
        from orders group by o_custkey) f on c.c_custkey = f.o_custkey
    left join (
        select o_custkey, o_orderpriority from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
    ) l on c.c_custkey = l.o_custkey
    left join nation n on c.c_nationkey = n.n_nationkey""")
def wide_table_customer(spark, sf):
    return build_wide_table(FLAGSHIP, customer_tables(spark, sf))


@query(customer_sql(f"{exact(PRICE, 2, 'avg')} as avg_price"))
def agg_avg(spark, sf):
    return build_wide_table(customer_plan(price("AVG", alias="avg_price")), customer_tables(spark, sf))


@query(customer_sql(f"{exact(PRICE)} as sum_price"))
def agg_sum(spark, sf):
    return build_wide_table(customer_plan(price("SUM", alias="sum_price")), customer_tables(spark, sf))


@query(customer_sql("count(o_orderpriority) as n_priorities", "count(*) as n_rows"))
def agg_count(spark, sf):
    plan = customer_plan(
        FeatureSpec("COUNT", "orders", "o_orderpriority", alias="n_priorities"),
        FeatureSpec("COUNT", "orders", alias="n_rows"),
    )
    return build_wide_table(plan, customer_tables(spark, sf))


@query(customer_sql(f"max({PRICE}) as max_price", "max(o_orderpriority) as max_priority"))
def agg_max(spark, sf):
    plan = customer_plan(
        price("MAX", alias="max_price"), FeatureSpec("MAX", "orders", "o_orderpriority", alias="max_priority")
    )
    return build_wide_table(plan, customer_tables(spark, sf))


@query(customer_sql(f"min({PRICE}) as min_price", "min(o_orderpriority) as min_priority"))
def agg_min(spark, sf):
    plan = customer_plan(
        price("MIN", alias="min_price"), FeatureSpec("MIN", "orders", "o_orderpriority", alias="min_priority")
    )
    return build_wide_table(plan, customer_tables(spark, sf))


def windowed_sql(column: str, table: str, name: str, time: str, as_of: str, days: int, op: str, scale: int = 2) -> str:
    """SQL for one windowed aggregate."""
    inside = within(time, as_of, days)
    value = f"case when {inside} then {column} end"
    text = {
        "SUM": exact(value, scale),
        "AVG": exact(value, scale, "avg"),
        "MAX": f"max({value})",
        "MIN": f"min({value})",
        "COUNT": f"case when count(*) filter ({inside}) > 0 then count({value}) end",
    }[op]
    return f'{text} as "{name}"'


WINDOW_SPECS = [price(op, days) for days in (30, 90, 365) for op in ("AVG", "SUM", "COUNT", "MAX", "MIN")]


@query(
    customer_sql(
        *[windowed_sql(PRICE, "orders", s.name, "o_orderdate", CUSTOMER_AS_OF, s.window_days, s.op) for s in WINDOW_SPECS]
    )
)
def window_agg_30_90_365(spark, sf):
    return build_wide_table(customer_plan(*WINDOW_SPECS), customer_tables(spark, sf))


EVENT_SPECS = [
    FeatureSpec(op, "events", "value", days, scale=2) for days in (1, 7, 14) for op in ("AVG", "SUM", "COUNT", "MAX", "MIN")
]


@query(f"""
    select u.user_id, f.* exclude (user_id) from (select distinct user_id from events) u left join (
        select user_id, {", ".join(windowed_sql("value", "events", s.name, "ts", EVENT_AS_OF, s.window_days, s.op) for s in EVENT_SPECS)}
        from events group by user_id) f on u.user_id = f.user_id""")
def window_agg_events(spark, sf):
    plan = FeaturePlan(USER, EVENT_SPECS, (EVENTS,), EVENT_AS_OF)
    return build_wide_table(plan, event_tables(spark, sf), check_grain=False)


@query(f"""
    select c.c_custkey, l.{PRICE} as latest_price, l.o_orderpriority as latest_priority, l.o_orderstatus as latest_status
    from customer c left join (
        select * from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
    ) l on c.c_custkey = l.o_custkey""")
def latest_by_time(spark, sf):
    order = ("o_orderdate", "o_orderkey")
    plan = customer_plan(
        FeatureSpec("LATEST", "orders", PRICE, order_by=order, alias="latest_price"),
        FeatureSpec("LATEST", "orders", "o_orderpriority", order_by=order, alias="latest_priority"),
        FeatureSpec("LATEST", "orders", "o_orderstatus", order_by=order, alias="latest_status"),
    )
    return build_wide_table(plan, customer_tables(spark, sf))


@query("""
    select l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars
    from labels l left join documents d on l.doc_id = d.doc_id""")
def snapshot_lookup(spark, sf):
    specs = [FeatureSpec("LATEST", "labels", "toxic", alias="toxic")]
    specs += [FeatureSpec("LATEST", "documents", c, alias=c) for c in ("lang", "source", "n_chars")]
    return build_wide_table(FeaturePlan(LABEL, specs, (DOCUMENTS,)), document_tables(spark, sf))


@query("""
    select c.c_custkey, n.n_name as nation, n.n_regionkey as region_key
    from customer c left join nation n on c.c_nationkey = n.n_nationkey""")
def snapshot_nation(spark, sf):
    plan = customer_plan(
        FeatureSpec("LATEST", "nation", "n_name", alias="nation"),
        FeatureSpec("LATEST", "nation", "n_regionkey", alias="region_key"),
    )
    return build_wide_table(plan, customer_tables(spark, sf))


def order_sql(*columns: str) -> str:
    return f"""select o.o_orderkey, (o.o_orderstatus = 'F')::int as is_f, f.* exclude (l_orderkey)
        from orders o left join (select l_orderkey, {", ".join(columns)} from lineitem group by l_orderkey) f
        on o.o_orderkey = f.l_orderkey"""


def order_features(spark, sf, *specs: FeatureSpec):
    return build_wide_table(FeaturePlan(ORDER, specs, (LINES,), ORDER_AS_OF), order_tables(spark, sf))


@query(
    order_sql(
        "count(*) filter (l_returnflag = 'R') as n_returned",
        "sum(case when l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2)) end)::double as open_price",
        "count(l_discount) filter (l_discount > 0.05) as n_discounted",
        "max(case when l_returnflag = 'A' then l_quantity end) as max_quantity_a",
    )
)
def conditional_agg(spark, sf):
    return order_features(
        spark,
        sf,
        FeatureSpec("COUNT", "lineitem", predicate="l_returnflag = 'R'", alias="n_returned"),
        FeatureSpec("SUM", "lineitem", "l_extendedprice", predicate="l_linestatus = 'O'", scale=2, alias="open_price"),
        FeatureSpec("COUNT", "lineitem", "l_discount", predicate="l_discount > 0.05D", alias="n_discounted"),
        FeatureSpec("MAX", "lineitem", "l_quantity", predicate="l_returnflag = 'A'", alias="max_quantity_a"),
    )


_SHIPPED = within("l_shipdate", ORDER_AS_OF, 365)


@query(
    order_sql(
        "(count(*) filter (l_returnflag = 'R'))::double / count(*) as return_rate",
        f"""(count(*) filter ({_SHIPPED} and l_returnflag = 'R'))::double
            / nullif(count(*) filter ({_SHIPPED}), 0) as return_rate_365d""",
    )
)
def rate_agg(spark, sf):
    returned = "l_returnflag = 'R'"
    return order_features(
        spark,
        sf,
        FeatureSpec("RATE", "lineitem", predicate=returned, alias="return_rate"),
        FeatureSpec("RATE", "lineitem", predicate=returned, window_days=365, alias="return_rate_365d"),
    )


@query(order_sql("count(distinct l_suppkey) as n_suppliers", "count(distinct l_returnflag) as n_flags"))
def distinct_agg(spark, sf):
    return order_features(
        spark,
        sf,
        FeatureSpec("COUNT_DISTINCT", "lineitem", "l_suppkey", alias="n_suppliers"),
        FeatureSpec("COUNT_DISTINCT", "lineitem", "l_returnflag", alias="n_flags"),
    )


_DISTINCT_COLUMNS = {"l_suppkey": "n_suppliers", "l_returnflag": "n_flags", "l_shipdate": "n_days"}


def _distinct_window_sql(column: str, days: int) -> str:
    inside = within("l_shipdate", ORDER_AS_OF, days)
    return f"case when count(*) filter ({inside}) > 0 then count(distinct {column}) filter ({inside}) end as {_DISTINCT_COLUMNS[column]}_{days}d"


@query(order_sql(*[_distinct_window_sql(c, d) for c in _DISTINCT_COLUMNS for d in (90, 365, 1500)]))
def distinct_agg_windows(spark, sf):
    """Distinct counts over several windows: the nearest band of each value, no row repeated."""
    specs = [
        FeatureSpec("COUNT_DISTINCT", "lineitem", c, window_days=d, alias=f"{name}_{d}d")
        for c, name in _DISTINCT_COLUMNS.items()
        for d in (90, 365, 1500)
    ]
    return order_features(spark, sf, *specs)


@query(
    order_sql(
        f"{exact('l_extendedprice * (1 - l_discount)', 4, 'avg')} as avg_net",
        "max(l_extendedprice / nullif(l_quantity, 0)) as max_unit_price",
        f"{exact('l_tax - l_discount', 2)} as sum_tax_gap",
    )
)
def expr_agg(spark, sf):
    return order_features(
        spark,
        sf,
        FeatureSpec("AVG", "lineitem", expr="l_extendedprice * (1 - l_discount)", scale=4, alias="avg_net"),
        FeatureSpec("MAX", "lineitem", expr="l_extendedprice / nullif(l_quantity, 0)", alias="max_unit_price"),
        FeatureSpec("SUM", "lineitem", expr="l_tax - l_discount", scale=2, alias="sum_tax_gap"),
    )


@query(f"""
    with w as (select o_custkey, {exact(PRICE)} as total,
                      sum(case when {within("o_orderdate", CUSTOMER_AS_OF, 730)} then cast({PRICE} as decimal(18,2)) end)::double as recent
               from orders group by o_custkey)
    select c_custkey, recent / nullif(total, 0) as recent_share,
           case when recent / nullif(total, 0) is null then null when recent / nullif(total, 0) > 0.8 then 'danger'
                when recent / nullif(total, 0) > 0.5 then 'warning' else 'normal' end as recent_share_band
    from customer left join w on c_custkey = o_custkey""", name="ratio_bands")
def ratio_band_feature(spark, sf):
    wide = build_wide_table(
        customer_plan(price("SUM", alias="total"), price("SUM", 730, "recent")), customer_tables(spark, sf)
    )
    # Warning and danger limits of the rule. Fixed values.
    limits = {"warning": 0.5, "danger": 0.8}
    return ratio_bands(wide, "recent", "total", limits, "recent_share").drop("recent", "total")


@query("""
    select c_custkey, c_mktsegment,
           (sum(cast(c_acctbal as decimal(18,2))) over w)::double / count(c_acctbal) over w as segment_avg,
           max(c_acctbal) over (partition by c_nationkey, c_mktsegment) as nation_segment_max
    from customer window w as (partition by c_mktsegment)""", name="group_feature")
def group_features(spark, sf):
    customer = customer_tables(spark, sf)["customer"]
    mean = F.expr(f"{sql_exact_sum('c_acctbal', 2)} / count(c_acctbal)")
    out = group_feature(customer, ["c_mktsegment"], "segment_avg", mean)
    out = group_feature(out, ["c_nationkey", "c_mktsegment"], "nation_segment_max", F.max("c_acctbal"))
    return out.select("c_custkey", "c_mktsegment", "segment_avg", "nation_segment_max")


@query(f"""
    with f as (select l_orderkey, {exact("l_extendedprice")} as lines_price, max(l_quantity) as max_quantity
               from lineitem group by l_orderkey)
    select o_orderkey, is_f, {PRICE} - lines_price as price_gap, {PRICE} / nullif(lines_price, 0) as price_ratio,
           max_quantity * {PRICE} as quantity_price
    from (select *, (o_orderstatus = 'F')::int as is_f from orders) left join f on o_orderkey = l_orderkey""", name="cross_feature")
def cross_features(spark, sf):
    wide = order_features(
        spark,
        sf,
        FeatureSpec("LATEST", "orders", PRICE, alias="price"),
        FeatureSpec("SUM", "lineitem", "l_extendedprice", scale=2, alias="lines_price"),
        FeatureSpec("MAX", "lineitem", "l_quantity", alias="max_quantity"),
    )
    wide = cross_feature(wide, "subtract", ["price", "lines_price"], "price_gap")
    wide = cross_feature(wide, "divide", ["price", "lines_price"], "price_ratio")
    wide = cross_feature(wide, "multiply", ["max_quantity", "price"], "quantity_price")
    return wide.select("o_orderkey", "is_f", "price_gap", "price_ratio", "quantity_price")


_MAIN_ROWS = "o_orderdate >= timestamp '1997-01-01 00:00:00' and length(o_orderpriority) > 5 and substr(o_orderpriority, 1, 1) <> '5'"
_SIDE_ROWS = "length(c_name) = 18 and substr(c_name, 1, 1) = 'C'"


@query(f"""
    with m as (select o_custkey, max(o_orderpriority) as o_orderpriority, max({PRICE}) as latest_price
               from orders where ({_MAIN_ROWS}) and {PRICE} > 1000 group by o_custkey),
         s as (select c_custkey, avg(c_acctbal) as avg_balance, count(c_mktsegment) as n_segments
               from customer where {_SIDE_ROWS} group by c_custkey)
    select m.o_custkey, m.o_orderpriority, m.latest_price, s.avg_balance, s.n_segments
    from m left join s on m.o_custkey = s.c_custkey""")
def filtered_wide_table(spark, sf):
    plan = FeaturePlan(
        MainSpec("orders", "o_custkey", grain="collapse"),
        [
            FeatureSpec("LATEST", "orders", PRICE, alias="latest_price"),
            FeatureSpec("AVG", "customer", "c_acctbal", alias="avg_balance"),
            FeatureSpec("COUNT", "customer", "c_mktsegment", alias="n_segments"),
        ],
        [Relationship("customer", "c_custkey", "o_custkey")],
        filters={"orders": f"{PRICE} > 1000"},
        passthrough=("o_orderpriority",),
    )
    where = {"orders": _MAIN_ROWS.replace("timestamp '", "timestamp_ntz '"), "customer": _SIDE_ROWS}
    return build_wide_table(plan, customer_tables(spark, sf), where=where)


ALIAS_SPECS = [price("COUNT"), price("SUM"), price("MAX", 365), FeatureSpec("LATEST", "customer", "c_mktsegment")]
_ALIAS_COLUMNS = [
    f"count({PRICE})",
    exact(PRICE),
    f"max(case when {_IN_YEAR} then {PRICE} end)",
]


def alias_sql(names: list[str]) -> str:
    columns = ", ".join(f'{c} as "{n}"' for c, n in zip(_ALIAS_COLUMNS, names))
    return f"""select c.c_custkey, f.* exclude (o_custkey), c.c_mktsegment as "{names[3]}" from customer c left join (
        select o_custkey, {columns} from orders group by o_custkey) f on c.c_custkey = f.o_custkey"""


@query(alias_sql(["f001", "f002", "f003", "f004"]))
def short_alias_wide_table(spark, sf):
    return build_wide_table(customer_plan(*ALIAS_SPECS), customer_tables(spark, sf), short_alias=True)


@query(alias_sql([s.name for s in ALIAS_SPECS]))
def alias_restore(spark, sf):
    plan = customer_plan(*ALIAS_SPECS)
    short = build_wide_table(plan, customer_tables(spark, sf), short_alias=True)
    return restore_names(short, short_aliases(plan.feature_names()))


@query("""
    select l.doc_id, coalesce(try_cast(d.n_chars as double), 0) as n_chars, coalesce(try_cast(d.source as double), 0) as source,
           coalesce(try_cast(substr(d.source, 4) as double), 0) as source_number, 0.0::double as n_words
    from labels l left join documents d on l.doc_id = d.doc_id""")
def align_for_scoring(spark, sf):
    tables = document_tables(spark, sf)
    wide = tables["labels"].join(tables["documents"], "doc_id", "left")
    wide = wide.withColumn("f003", F.substring("source", 4, 10))
    whitelist = ["n_chars", "source", "source_number", "n_words"]
    return align_features(wide, whitelist, {"f003": "source_number"}, carry=["doc_id"])


# Decimals of the numeric columns of the lines, in table order.
GRID_COLUMNS = {"l_linenumber": 0, "l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2}
GRID_OPS = ("AVG", "SUM", "MAX", "MIN")
MANY_WINDOWS = (30, 90, 365, 730, 1460)


def lines_grid_sql(windows) -> str:
    return order_sql(
        *[
            windowed_sql(c, "lineitem", f"{op}_lineitem_{c}_{d}d", "l_shipdate", ORDER_AS_OF, d, op, scale)
            for c, scale in GRID_COLUMNS.items()
            for op in GRID_OPS
            for d in windows
        ]
    )


@query(
    customer_sql(
        *[
            windowed_sql(PRICE, "orders", f"{op}_orders_{PRICE}_{d}d", "o_orderdate", CUSTOMER_AS_OF, d, op)
            for op in GRID_OPS
            for d in (30, 90, 365)
        ]
    )
)
def feature_grid(spark, sf):
    tables = customer_tables(spark, sf)
    specs = window_grid(tables, [ORDERS], exclude=["o_orderkey"], scales={PRICE: 2})
    return build_wide_table(customer_plan(*specs), tables)


def lines_grid(spark, sf, windows):
    tables = order_tables(spark, sf)
    specs = window_grid(tables, [LINES], windows, exclude=["l_partkey", "l_suppkey"], scales=GRID_COLUMNS)
    return build_wide_table(FeaturePlan(ORDER, specs, (LINES,), ORDER_AS_OF), tables)


@query(lines_grid_sql((30, 90, 365)))
def feature_grid_lines(spark, sf):
    return lines_grid(spark, sf, (30, 90, 365))


@query(lines_grid_sql(MANY_WINDOWS))
def feature_grid_many_windows(spark, sf):
    """More aggregates than one pass holds: two passes over disjoint columns."""
    return lines_grid(spark, sf, MANY_WINDOWS)


@query(f"""
    with latest as (select o_custkey, arg_max({PRICE}, (o_orderdate, o_orderkey)) filter (o_orderstatus = 'F') as latest_finished
                    from orders group by o_custkey)
    select c.c_custkey, l.latest_finished, case when c.c_acctbal > 0 then c.c_mktsegment end as segment_in_credit
    from customer c left join latest l on c.c_custkey = l.o_custkey""")
def latest_with_predicate(spark, sf):
    """Latest values of the rows a predicate selects, of a fact table and of the main table."""
    plan = customer_plan(
        FeatureSpec("LATEST", "orders", PRICE, predicate="o_orderstatus = 'F'", order_by=("o_orderdate", "o_orderkey"), alias="latest_finished"),
        FeatureSpec("LATEST", "customer", "c_mktsegment", predicate="c_acctbal > 0", alias="segment_in_credit"),
    )
    return build_wide_table(plan, customer_tables(spark, sf))


@query(f"""
    with latest as (select o_custkey, arg_max({PRICE} * 2 + length(o_orderpriority), (o_orderdate, o_orderkey)) as latest_twice
                    from orders group by o_custkey)
    select c.c_custkey, l.latest_twice from customer c left join latest l on c.c_custkey = l.o_custkey""")
def latest_expr(spark, sf):
    """The value of an expression over the latest row."""
    spec = FeatureSpec(
        "LATEST", "orders", expr=f"{PRICE} * 2 + length(o_orderpriority)", order_by=("o_orderdate", "o_orderkey"), alias="latest_twice"
    )
    return build_wide_table(customer_plan(spec), customer_tables(spark, sf))


@query(f"""
    select o_custkey, {exact(f"case when {within('o_orderdate', CUSTOMER_AS_OF, 365)} then {PRICE} end")} as spent_in_year,
           max({PRICE}) as highest
    from orders where o_custkey is not null group by o_custkey""")
def collapsed_window(spark, sf):
    """A trailing window over a main table that is reduced to one row per key."""
    plan = FeaturePlan(
        MainSpec("orders", "o_custkey", grain="collapse", time_column="o_orderdate"),
        [price("SUM", 365, "spent_in_year"), price("MAX", alias="highest")],
        as_of=CUSTOMER_AS_OF,
    )
    return build_wide_table(plan, customer_tables(spark, sf))


@query(f"""
    with f as (select o_custkey, count({PRICE}) as n_large from orders where {PRICE} > 100000 and o_orderstatus <> 'orders.x' group by o_custkey)
    select c.c_custkey, f.n_large from (select * from customer where c_acctbal > 0) c left join f on c.c_custkey = f.o_custkey""")
def stored_filter(spark, sf):
    """A plan read from its stored form, whose filter entries apply to their tables."""
    plan, _ = plan_from_dict(
        {
            "meta": {
                "join_key": "c_custkey",
                "main_table": "customer",
                "relationships": [{"table": "orders", "key": "o_custkey", "main_key": "c_custkey"}],
            },
            "genes": [
                {"_type": "FilterGene", "condition": f"orders.{PRICE} > 100000 and orders.o_orderstatus <> 'orders.x'"},
                {"_type": "FilterGene", "condition": "customer.c_acctbal > 0"},
                {"_type": "FeatureGene", "op": "COUNT", "table": "orders", "column": PRICE, "alias": "n_large"},
            ],
        }
    )
    return build_wide_table(plan, customer_tables(spark, sf))


# Purchases with what was known of their user at their time.
ASOF_DAYS = (1, 7)


def _asof_tables(spark, sf):
    events = read(spark, sf, "events")
    samples = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return samples, events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts", "event_type", "value")


@query("""
    select p.event_id, p.user_id, p.ts, f.event_type as latest_type, f.value as latest_value
    from (select event_id, user_id, ts from events where event_type = 'purchase') p
    asof left join (select * from events where event_type <> 'purchase') f on p.user_id = f.user_id and p.ts >= f.ts""")
def asof_latest_event(spark, sf):
    """The last other event of the user before each purchase."""
    samples, facts = _asof_tables(spark, sf)
    values = {"latest_type": "event_type", "latest_value": "value"}
    return asof_latest(samples, facts, ["user_id"], ["user_id"], "ts", "ts", values, ["event_id"])


def _asof_window_sql(days: int) -> str:
    inside = f"f.ts >= p.ts - interval {days} day"
    total = f"sum(cast(f.value as decimal(18,2))) filter ({inside})::double"
    return f"""nullif(count(f.event_id) filter ({inside}), 0) as rows_{days}d, {total} as sum_{days}d,
        {total} / count(f.value) filter ({inside}) as avg_{days}d"""


@query(f"""
    select p.event_id, p.user_id, p.ts, {", ".join(map(_asof_window_sql, ASOF_DAYS))}
    from (select event_id, user_id, ts from events where event_type = 'purchase') p
    left join (select * from events where event_type <> 'purchase') f on p.user_id = f.user_id and f.ts <= p.ts
    group by all""")
def asof_windows_events(spark, sf):
    """Rows, sum and average of the days before each purchase."""
    samples, facts = _asof_tables(spark, sf)
    features = {f"{name}_{d}d": (op, column, d) for d in ASOF_DAYS for name, op, column in (("rows", "COUNT", None), ("sum", "SUM", "value"), ("avg", "AVG", "value"))}
    return asof_windows(samples, facts, ["user_id"], ["user_id"], "ts", "ts", features)
