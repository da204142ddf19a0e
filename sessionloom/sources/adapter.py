"""The nested event export, derived from the relational tables this repository is tested on.

Events become the export's events; customers (with nation and region) give the geography, parts
the line items. Every row of ``events`` is used and every part can occur as an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.export import ITEMS_TYPE, PARAMS_TYPE

# Columns of the tables that are read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
}

# Fixed values of the mapping.
EVENT_NAMES = {
    "view": "View_Item",
    "click": "add_to_cart",
    "signup": "begin_checkout",
    "purchase": "purchase",
    "error": "page_view",
}
# A type's events from this k on get another name. add_payment_info never occurs.
RENAMED = {"signup": (80, "add_shipping_info"), "error": (50, "session_start")}
CATEGORIES = ("Desktop", "mobile", "Tablet")
MEDIUMS = ("(none)", "organic", "referral", "cpc", "<Other>", "(data deleted)", "(not set)")
SOURCES = (
    "(direct)", "google", "shop.example", "google", "<Other>", "(data deleted)", "(not set)"
)
CAMPAIGNS = (
    "(direct)", "(organic)", "(referral)", "spring", "<Other>", "(data deleted)", "(not set)"
)
NATIVE_SESSION_SECONDS = 7200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def source_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with the helper columns the mapping uses."""
    parsed = table(spark, folder, "events").selectExpr(
        "*", "cast(get_json_object(props, '$.k') as int) AS k"
    )
    return parsed.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "k",
        "unix_micros(cast(ts as timestamp)) AS us",
        "cast((user_id + (dayofmonth(ts) div 5) % 3) % 7 as int) AS src",
        "cast((user_id + if(k >= 90, 1, 0)) % 3 as int) AS device_no",
        "if(event_type IN ('view', 'click', 'purchase'), k % 4, 0) AS n_items",
        "event_type = 'purchase' AS bought",
    )


def _with_places(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """Geography by customer. Left-deep: each joined side is a plain table, so Spark's size check
    decides per table between broadcast and sort-merge."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return (
        events.join(
            customer.select("c_custkey", "c_mktsegment", "c_nationkey"),
            F.expr("user_id = c_custkey"),
            "left",
        )
        .join(nation, F.expr("c_nationkey = n_nationkey"), "left")
        .join(region, F.expr("n_regionkey = r_regionkey"), "left")
    )


def event_items(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """(event_id, items): the parts of each event as an array; at most three per event."""
    part = table(spark, folder, "part")
    parts = part.selectExpr("max(p_partkey) + 1 AS n").scalar()
    lines = events.where("n_items > 0").selectExpr(
        "event_id", "event_type", "explode(sequence(0, n_items - 1)) AS i"
    )
    picked = lines.withColumn("partkey", F.expr("event_id * 31 + i * 17") % parts)
    item = """named_struct(
        'item_id', concat('P', p_partkey),
        'item_name', if(p_partkey % 17 = 0, '(not set)', p_name),
        'item_brand', p_brand,
        'item_variant', if(p_size < 10, 'Not available in demo dataset', cast(p_size as string)),
        'item_category', case when p_partkey % 13 = 0 then '(not set)'
            when event_type = 'purchase' then p_type else concat('Home/', p_type, '/') end,
        'item_list_id', if(i > 0, '', 'list'),
        'item_list_index', cast(i as string),
        'promotion_name', '(not set)',
        'creative_name', if(i = 1, '<Other>', null),
        'price', p_retailprice,
        'price_in_usd', p_retailprice,
        'quantity', if(event_type IN ('click', 'purchase'), cast(i + 1 as bigint), null),
        'item_revenue', if(event_type = 'purchase', p_retailprice * (i + 1), null),
        'item_revenue_in_usd', if(event_type = 'purchase', p_retailprice * (i + 1), null))"""
    placed = picked.join(part, F.expr("partkey = p_partkey")).selectExpr(
        "event_id", f"named_struct('i', i, 'item', {item}) AS placed"
    )
    return placed.groupBy("event_id").agg(
        F.expr("array_sort(collect_list(placed)).item").alias("items")
    )


def _named(cases: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in cases.items()) + ")"


def _param(key: str, text="null", whole="null", real="null") -> str:
    value = (
        f"named_struct('string_value', cast({text} as string), 'int_value', cast({whole} as "
        f"bigint), 'float_value', cast(null as double), 'double_value', cast({real} as double))"
    )
    return f"named_struct('key', '{key}', 'value', {value})"


def _pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"get(array({listed}), {index})"


def raw_export(
    spark: SparkSession,
    folder: str,
    with_items: bool = False,
    days: tuple[str, str] | None = None,
    by_day: bool = False,
) -> DataFrame:
    """The export over all of ``events``, or those of ``days`` (first and last, 'yyyyMMdd').

    Without items, arrays are NULL and parts stay unread. Days are picked ahead of the joins, so
    items of other days' events are neither looked up nor collected. ``by_day`` has the rows lie by
    day, for tables partitioned by it: flat rows are shuffled, a fraction of the nested ones.
    """
    events = source_events(spark, folder)
    if days:
        events = events.where(F.date_format("ts", "yyyyMMdd").between(*days))
    full = _with_places(spark, folder, events)
    if with_items:
        full = full.join(event_items(spark, folder, events), "event_id", "left")
    else:
        full = full.withColumn("items", F.lit(None).cast(ITEMS_TYPE))
    full = full.withColumn("event_date", F.date_format("ts", "yyyyMMdd"))
    if by_day:
        full = full.hint("rebalance", "event_date")

    renamed = [
        f"when event_type = '{t}' and k >= {least} then '{n}'" for t, (least, n) in RENAMED.items()
    ]
    named = [f"when event_type = '{t}' then '{n}'" for t, n in EVENT_NAMES.items()]
    engaged = (
        "if(k % 2 = 0, " + _param("engaged", text="'0'") + ", " + _param("engaged", whole="1") + ")"
    )
    none = f"cast(array() as {PARAMS_TYPE})"
    title = "if(k % 7 = 1, '(not set)', concat('Page ', event_type))"
    params = f"""concat(
        if(k % 7 = 0, {none}, array({_param("page_title", text=title)})),
        array(
            {_param("page_location", text="concat('https://Shop.example/', event_type, '?k=', k)")},
            {_param("ga_session_id", whole=f"us div {NATIVE_SESSION_SECONDS * 1_000_000}")},
            {engaged},
            {_param("value", real="value")}),
        if(k % 50 = 0, array({engaged}), {none}))"""
    device = {
        "category": _pick(CATEGORIES, "device_no"),
        "mobile_brand_name": "if(user_id % 5 = 0, '<Other>', c_mktsegment)",
    }
    geo = {
        "continent": "if(user_id % 11 = 0, '(not set)', r_name)",
        "sub_continent": "concat('Sub ', r_name)",
        "country": "n_name",
        "region": "concat('Region ', n_nationkey)",
        "city": "if(user_id % 3 = 0, '(not set)', concat('City ', n_nationkey))",
    }
    traffic = {
        "medium": _pick(MEDIUMS, "src"),
        "source": _pick(SOURCES, "src"),
        "name": _pick(CAMPAIGNS, "src"),
    }
    bought = {
        "transaction_id": "if(k % 10 = 0, '(not set)', concat('T', event_id))",
        "purchase_revenue": "value",
        "purchase_revenue_in_usd": "value",
        "tax_value": "value / 10",
        "tax_value_in_usd": "value / 10",
        "total_item_quantity": "cast(n_items * (n_items + 1) div 2 as bigint)",
        "unique_items": "cast(n_items as bigint)",
    }
    return full.selectExpr(
        "event_date",
        "us AS event_timestamp",
        f"case {' '.join(renamed + named)} end AS event_name",
        "concat('U', user_id) AS user_pseudo_id",
        "if(k % 50 <> 0, us - k * 1000000L, null) AS user_first_touch_timestamp",
        f"{params} AS event_params",
        f"{_named(device)} AS device",
        f"{_named(geo)} AS geo",
        f"{_named(traffic)} AS traffic_source",
        _named({n: f"if(bought, {v}, null)" for n, v in bought.items()}) + " AS ecommerce",
        "items",
    )
