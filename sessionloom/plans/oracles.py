"""The expected results of the registered queries as SQL for DuckDB.

Written from the definitions, with plain windows, joins and unions, independently of how the
Spark operators get there.
"""

from __future__ import annotations

from sessionloom.operators.metrics import (
    DEVICE_DIMENSIONS,
    METRICS,
    TRAFFIC_DIMENSIONS,
    Ratio,
    Simple,
)
from sessionloom.operators.staging import MEASURES, TEXT_FIELDS
from sessionloom.operators.snapshot import run_micros
from sessionloom.plans.queries import CUT_DAY, DAY, RUNS, WINDOW, digits
from sessionloom.sources import adapter

# Fixed values of the definitions, stated here again so that a change in the library shows.
FUNNEL_EVENTS = ("session_start", "view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase")
REPORT_STEPS = ("sessions", "view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase")
Z_95 = 1.959964
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
ORDER = "time_stamp NULLS FIRST, session_id NULLS FIRST, event_name NULLS FIRST"
BACK = "time_stamp DESC NULLS LAST, session_id DESC NULLS LAST, event_name DESC NULLS LAST"
TRAFFIC = ("medium", "traffic_source", "source_name")
DEVICE_COLUMNS = ("continent", "sub_continent", "country", "region", "city", "device", "brand")


# --- pieces -------------------------------------------------------------------------------


def cleaned(c: str) -> str:
    """Without a pattern: brackets are found by first and last character."""
    t = f"lower({c})"
    wrapped = (
        f"length({t}) > 1 AND left({t}, 1) IN ('(', '<') AND right({t}, 1) IN (')', '>') "
        f"AND position(chr(10) IN {t}) = 0"
    )
    return (
        f"CASE {t} WHEN '(none)' THEN 'direct' WHEN '(not set)' THEN NULL "
        f"WHEN '(data deleted)' THEN NULL "
        f"ELSE CASE WHEN {wrapped} THEN substr({t}, 2, length({t}) - 2) ELSE {t} END END"
    )


def cleaned_item(c: str) -> str:
    return f"nullif(nullif({cleaned(c)}, ''), 'not available in demo dataset')"


def key(*parts: str) -> str:
    texts = [f"coalesce(CAST({p} AS VARCHAR), '{NULL_TOKEN}')" for p in parts]
    return f"md5({' || chr(45) || '.join(texts)})"


EVENT_ID = key("device_id", "session_id", "epoch_us(time_stamp)", "event_name")
TRAFFIC_KEY = key(*TRAFFIC)


def ratio(k: str, n: str) -> str:
    return f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"


def wilson(k: str, n: str, side: str) -> str:
    """In counts: the roots of the score equation, (k + z2/2 -+ z sqrt(k(n-k)/n + z2/4)) / (n + z2)."""
    n = f"nullif(CAST({n} AS DOUBLE), 0)"
    k, z2 = f"CAST({k} AS DOUBLE)", f"({Z_95} * {Z_95})"
    root = f"{Z_95} * sqrt({k} * ({n} - {k}) / {n} + {z2} / 4)"
    return f"(({k} + {z2} / 2 {'-' if side == 'lower' else '+'} {root}) / ({n} + {z2}))"


def newcombe(k1: str, n1: str, k2: str, n2: str, side: str) -> str:
    other = {"lower": "upper", "upper": "lower"}[side]
    distances = [f"{ratio(k1, n1)} - {wilson(k1, n1, side)}", f"{ratio(k2, n2)} - {wilson(k2, n2, other)}"]
    squares = " + ".join(f"({d}) * ({d})" for d in distances)
    sign = "-" if side == "lower" else "+"
    return f"({ratio(k1, n1)} - {ratio(k2, n2)} {sign} sqrt({squares}))"


def rounded(sql: str, doubles: str, dates: str = "", times: str = "") -> str:
    """Bring a result to the portable form of the Spark side."""
    parts = [
        f"CASE WHEN abs({c}) < {0.5 * 10**-digits(c):.12f} THEN 0.0::DOUBLE "
        f"ELSE round({c}::DOUBLE, {digits(c)}) END AS {c}"
        for c in doubles.split()
    ]
    parts += [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates.split()]
    parts += [f"epoch_us({c}) AS {c}" for c in times.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


def picked(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][CAST({index} AS INTEGER) + 1]"


# --- shared tables ------------------------------------------------------------------------

_NAMES = " ".join(
    [
        f"WHEN event_type = '{t}' AND k >= {least} THEN '{n}'"
        for t, (least, n) in adapter.RENAMED.items()
    ]
    + [f"WHEN event_type = '{t}' THEN '{n}'" for t, n in adapter.EVENT_NAMES.items()]
)
_RAW_TEXT = {
    "device": "raw_device",
    "brand": "raw_brand",
    "continent": "raw_continent",
    "sub_continent": "raw_sub_continent",
    "country": "raw_country",
    "region": "raw_region",
    "city": "raw_city",
    "medium": "raw_medium",
    "traffic_source": "raw_source",
    "source_name": "raw_campaign",
    "transaction_id": "raw_transaction_id",
}
assert set(_RAW_TEXT) == set(TEXT_FIELDS)


DEVICE = "lower('U' || CAST(user_id AS VARCHAR))"


def tables(gap: int = 1800, only: str = "true", device: str = DEVICE, time: str = "ts") -> str:
    """WITH clause: raw, stg, sess (events with sessions), fs (session fact), dimensions, items."""
    flags = ",\n".join(
        f"CAST(max(CASE WHEN event_name = '{s}' THEN 1 ELSE 0 END) AS INTEGER) AS reached_{s}"
        for s in FUNNEL_EVENTS
    )
    first = ",\n".join(
        f"max(CASE WHEN nth = 1 THEN {c} END) AS {alias}"
        for c, alias in [
            ("session_id", "ga_session_id"),
            ("event_date", "session_date"),
            ("first_touch", "first_touch"),
            *[(t, t) for t in TRAFFIC],
        ]
    )
    latest = ", ".join(DEVICE_COLUMNS)
    return f"""WITH src AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us,
         (user_id + (day(ts) // 5) % 3) % 7 AS src_no
  FROM events
), raw AS (
  SELECT s.*, n_name, r_name, n_nationkey, c_mktsegment,
    CASE {_NAMES} END AS raw_name,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN k % 4 ELSE 0 END AS n_items,
    {picked(adapter.CATEGORIES, "(user_id + CASE WHEN k >= 90 THEN 1 ELSE 0 END) % 3")} AS raw_device,
    CASE WHEN user_id % 5 = 0 THEN '<Other>' ELSE c_mktsegment END AS raw_brand,
    CASE WHEN user_id % 11 = 0 THEN '(not set)' ELSE r_name END AS raw_continent,
    'Sub ' || r_name AS raw_sub_continent, n_name AS raw_country,
    'Region ' || CAST(n_nationkey AS VARCHAR) AS raw_region,
    CASE WHEN user_id % 3 = 0 THEN '(not set)'
         ELSE 'City ' || CAST(n_nationkey AS VARCHAR) END AS raw_city,
    {picked(adapter.MEDIUMS, "src_no")} AS raw_medium,
    {picked(adapter.SOURCES, "src_no")} AS raw_source,
    {picked(adapter.CAMPAIGNS, "src_no")} AS raw_campaign,
    CASE WHEN event_type = 'purchase' THEN
      CASE WHEN k % 10 = 0 THEN '(not set)' ELSE 'T' || CAST(event_id AS VARCHAR) END
    END AS raw_transaction_id,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '(not set)'
         ELSE 'Page ' || event_type END AS raw_title,
    'https://Shop.example/' || event_type || '?k=' || CAST(k AS VARCHAR) AS raw_location,
    us // {adapter.NATIVE_SESSION_SECONDS * 1_000_000} AS native_id
  FROM src AS s
  LEFT JOIN customer ON user_id = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
), stg AS (
  SELECT event_id AS eid, k, event_type, CAST(n_items AS INTEGER) AS n_items,
    CAST(ts AS DATE) AS event_date, {time} AS time_stamp, lower(raw_name) AS event_name,
    {device} AS device_id,
    {cleaned("raw_title")} AS page_title, {cleaned("raw_location")} AS page_location,
    CAST(native_id AS VARCHAR) AS session_id,
    CASE WHEN k % 50 <> 0 THEN make_timestamp(us - k * 1000000) END AS first_touch,
    {", ".join(f"{cleaned(r)} AS {c}" for c, r in _RAW_TEXT.items())},
    CASE WHEN event_type = 'purchase' THEN value END AS purchase_revenue,
    CASE WHEN event_type = 'purchase' THEN value END AS purchase_revenue_in_usd,
    CASE WHEN event_type = 'purchase' THEN value / 10 END AS tax_value,
    CASE WHEN event_type = 'purchase' THEN value / 10 END AS tax_value_in_usd,
    CASE WHEN event_type = 'purchase' THEN CAST(n_items * (n_items + 1) // 2 AS BIGINT) END
      AS total_item_quantity,
    CASE WHEN event_type = 'purchase' THEN CAST(n_items AS BIGINT) END AS unique_items
  FROM (SELECT *, CAST(ts AS DATE) AS event_date FROM raw) WHERE {only}
), cut AS (
  SELECT *, date_sub('second', lag(time_stamp) OVER w, time_stamp) // 60 AS mins_since_prev,
    coalesce(date_sub('second', lag(time_stamp) OVER w, time_stamp) > {gap}, true) AS opens
  FROM stg WINDOW w AS (PARTITION BY device_id ORDER BY {ORDER})
), counted AS (
  SELECT * EXCLUDE (opens), CAST(opens AS INTEGER) AS is_new_session,
    count(*) FILTER (opens) OVER (PARTITION BY device_id ORDER BY {ORDER}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_num
  FROM cut
), sess AS (
  SELECT *, {key("device_id", "session_num")} AS session_key,
    row_number() OVER (PARTITION BY device_id, session_num ORDER BY {ORDER}) AS nth
  FROM counted
), roll AS (
  SELECT session_key, device_id, session_num, min(time_stamp) AS session_start,
    max(time_stamp) AS session_end, count(*) AS event_count,
    count(DISTINCT session_id) AS ga_session_count, {first}, {flags}
  FROM sess GROUP BY session_key, device_id, session_num
), fs AS (
  SELECT session_key AS session_id, ga_session_id, ga_session_count, session_date, session_start,
    session_end, event_count, device_id, {TRAFFIC_KEY} AS traffic_source_key,
    {", ".join(f"reached_{s}" for s in FUNNEL_EVENTS)},
    CASE WHEN ga_session_count > 1 THEN 1 ELSE 0 END AS spans_multiple_ga_sessions
  FROM roll
), fe AS (
  SELECT {EVENT_ID} AS event_id, session_key AS session_id, session_id AS ga_session_id, device_id,
    {TRAFFIC_KEY} AS traffic_source_key, event_date, time_stamp, event_name, page_title,
    page_location, transaction_id, {", ".join(MEASURES)}
  FROM sess
), dev AS (
  SELECT device_id, {latest} FROM stg
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY {BACK}) = 1
), traffic AS (
  SELECT {TRAFFIC_KEY} AS traffic_source_key, * FROM (SELECT DISTINCT {", ".join(TRAFFIC)} FROM stg)
), days AS (
  SELECT CAST(unnest(generate_series(min(event_date), max(event_date), INTERVAL 1 DAY)) AS DATE)
    AS date_day FROM stg
), lines AS (
  SELECT sess.*, i.i, (eid * 31 + i.i * 17) % (SELECT max(p_partkey) + 1 FROM part) AS partkey
  FROM sess, (VALUES (0), (1), (2)) AS i(i) WHERE i.i < n_items
), raw_items AS (
  SELECT lines.*, 'P' || CAST(p_partkey AS VARCHAR) AS raw_item_id,
    CASE WHEN p_partkey % 17 = 0 THEN '(not set)' ELSE p_name END AS raw_item_name,
    p_brand AS raw_item_brand,
    CASE WHEN p_size < 10 THEN 'Not available in demo dataset'
         ELSE CAST(p_size AS VARCHAR) END AS raw_item_variant,
    CASE WHEN p_partkey % 13 = 0 THEN '(not set)' WHEN event_type = 'purchase' THEN p_type
         ELSE 'Home/' || p_type || '/' END AS raw_item_category,
    CASE WHEN i > 0 THEN '' ELSE 'list' END AS raw_item_list_id,
    CAST(i AS VARCHAR) AS raw_item_list_index, '(not set)' AS raw_promotion_name,
    CASE WHEN i = 1 THEN '<Other>' END AS raw_creative_name, p_retailprice
  FROM lines JOIN part ON partkey = p_partkey
), items AS (
  SELECT {EVENT_ID} AS event_id, session_key, event_date, event_name, CAST(i AS INTEGER) AS item_index,
    {", ".join(f"{cleaned_item('raw_' + c)} AS {c}" for c in _ITEM_TEXTS)},
    p_retailprice AS price, p_retailprice AS price_in_usd,
    CASE WHEN event_type IN ('click', 'purchase') THEN CAST(i + 1 AS BIGINT) END AS quantity,
    CASE WHEN event_type = 'purchase' THEN p_retailprice * (i + 1) END AS item_revenue,
    CASE WHEN event_type = 'purchase' THEN p_retailprice * (i + 1) END AS item_revenue_in_usd
  FROM raw_items
), opening AS (
  SELECT device_id, {", ".join(TRAFFIC)}, time_stamp, session_id, event_name FROM stg
  QUALIFY row(medium, traffic_source, source_name) IS DISTINCT FROM
    lag(row(medium, traffic_source, source_name)) OVER (PARTITION BY device_id ORDER BY {ORDER})
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY {ORDER}) AS version_num FROM opening
), hist AS (
  SELECT {key("device_id", "version_num")} AS attribution_version_key, device_id, version_num,
    {TRAFFIC_KEY} AS traffic_source_key, {", ".join(TRAFFIC)}, time_stamp AS valid_from,
    lead(time_stamp) OVER w AS valid_to,
    CAST(row_number() OVER (PARTITION BY device_id ORDER BY version_num DESC) = 1 AS INTEGER)
      AS is_current
  FROM numbered WINDOW w AS (PARTITION BY device_id ORDER BY version_num)
), cur AS (
  SELECT device_id, {TRAFFIC_KEY} AS traffic_source_key, {", ".join(TRAFFIC)},
    time_stamp AS attributed_at
  FROM stg QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY {BACK}) = 1
), early AS (
  SELECT device_id, {TRAFFIC_KEY} AS traffic_source_key, {", ".join(TRAFFIC)},
    time_stamp AS attributed_at
  FROM stg WHERE event_date < strptime('{CUT_DAY}', '%Y%m%d')
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY {BACK}) = 1
), {_REPORTS}
"""


_ITEM_TEXTS = (
    "item_id",
    "item_name",
    "item_brand",
    "item_variant",
    "item_category",
    "item_list_id",
    "item_list_index",
    "promotion_name",
    "creative_name",
)


def _step_list() -> str:
    """Per session: a struct for every step with its flag and the flag of the step before."""
    structs = []
    for n, step in enumerate(REPORT_STEPS, start=1):
        hit = "1" if n == 1 else f"reached_{step}"
        prior = "1" if n <= 2 else f"reached_{REPORT_STEPS[n - 2]}"
        structs.append(f"{{'step': '{step}', 'step_sort': {n}, 'hit': {hit}, 'prior': {prior}}}")
    return f"[{', '.join(structs)}]"


def _funnel_columns() -> str:
    k, n, b, j = "sessions_reached", "segment_sessions", "prev_step_sessions", "reached_from_prev"
    gap = (k, n, "rest_reached", "rest_sessions")
    return f"""
    segment_type, segment_type_sort, segment_value, segment_sort, step, step_sort,
    segment_sessions, sessions_reached, prev_step_sessions, reached_from_prev,
    {ratio(k, n)} AS reach_rate,
    {wilson(k, n, "lower")} AS reach_rate_lower, {wilson(k, n, "upper")} AS reach_rate_upper,
    {ratio(j, b)} AS step_conversion,
    {wilson(j, b, "lower")} AS step_conversion_lower,
    {wilson(j, b, "upper")} AS step_conversion_upper,
    {ratio(f"({k} - {j})", k)} AS skipped_prev_share,
    {ratio(k, n)} - {ratio("rest_reached", "rest_sessions")} AS gap_vs_rest,
    {newcombe(*gap, "lower")} AS gap_vs_rest_lower,
    {newcombe(*gap, "upper")} AS gap_vs_rest_upper,
    CASE WHEN segment_sessions < 100 THEN 1 ELSE 0 END AS is_thin_segment,
    CASE WHEN prev_step_sessions < 100 THEN 1 ELSE 0 END AS is_thin_step"""


def _category_rates() -> str:
    out = []
    for goal, k in (
        ("cart", "sessions_viewed_and_carted"),
        ("purchase", "sessions_viewed_and_purchased"),
    ):
        name, n = f"view_to_{goal}_rate", "sessions_viewed"
        out.append(
            f"{ratio(k, n)} AS {name}, {wilson(k, n, 'lower')} AS {name}_lower, "
            f"{wilson(k, n, 'upper')} AS {name}_upper"
        )
    return ", ".join(out)


_WEEK_STEPS = ("view_item", "add_to_cart", "begin_checkout", "purchase")
_REPORTS = f"""long AS (
  SELECT coalesce(d.device, 'unknown') AS device_category,
    coalesce(d.continent, 'unknown') AS continent,
    coalesce(CASE t.traffic_source WHEN 'direct' THEN 'direct' ELSE t.medium END, 'unknown') AS channel,
    unnest({_step_list()}) AS one
  FROM fs LEFT JOIN dev AS d USING (device_id) LEFT JOIN traffic AS t USING (traffic_source_key)
), steps AS (
  SELECT CASE grouping(device_category, continent, channel) WHEN 7 THEN 'overall'
      WHEN 3 THEN 'device_category' WHEN 5 THEN 'continent' ELSE 'channel' END AS segment_type,
    coalesce(device_category, continent, channel, 'all sessions') AS segment_value,
    one.step AS step, one.step_sort AS step_sort, count(*) AS segment_sessions,
    count(*) FILTER (one.hit = 1) AS sessions_reached,
    count(*) FILTER (one.prior = 1) AS prev_step_sessions,
    count(*) FILTER (one.hit = 1 AND one.prior = 1) AS reached_from_prev
  FROM long GROUP BY GROUPING SETS ((one.step, one.step_sort),
    (one.step, one.step_sort, device_category), (one.step, one.step_sort, continent),
    (one.step, one.step_sort, channel))
), ranked AS (
  SELECT *, max(segment_sessions) FILTER (segment_type = 'overall') OVER p - segment_sessions
      AS rest_sessions,
    max(sessions_reached) FILTER (segment_type = 'overall') OVER p - sessions_reached AS rest_reached,
    list_position(['overall', 'device_category', 'continent', 'channel'], segment_type)
      AS segment_type_sort,
    CAST(CASE WHEN segment_type = 'overall' THEN 0 WHEN segment_value = 'unknown' THEN 99
         ELSE dense_rank() OVER (PARTITION BY segment_type, step
                                 ORDER BY segment_sessions DESC) END AS INTEGER) AS segment_sort
  FROM steps WINDOW p AS (PARTITION BY step)
), funnel AS (SELECT {_funnel_columns()} FROM ranked
), per_week AS (
  SELECT session_date - CAST(isodow(session_date) - 1 AS INTEGER) AS week_start,
    count(DISTINCT session_date) AS days_in_week, count(*) AS sessions,
    {", ".join(f"count(*) FILTER (reached_{s} = 1) AS sessions_with_{s}" for s in _WEEK_STEPS)}
  FROM fs GROUP BY ALL
), weekly AS (
  SELECT week_start, strftime(week_start, '%d %b') AS week_label,
    CAST(row_number() OVER (ORDER BY week_start) AS INTEGER) AS week_sort, days_in_week,
    CASE WHEN days_in_week < 7 THEN 1 ELSE 0 END AS is_partial_week, sessions,
    {", ".join(f"sessions_with_{s}" for s in _WEEK_STEPS)},
    {ratio("sessions_with_purchase", "sessions")} AS session_conversion_rate,
    {wilson("sessions_with_purchase", "sessions", "lower")} AS session_conversion_rate_lower,
    {wilson("sessions_with_purchase", "sessions", "upper")} AS session_conversion_rate_upper
  FROM per_week
), named_items AS (SELECT * FROM items WHERE item_name IS NOT NULL
), modal AS (
  SELECT item_name, item_category FROM named_items
  WHERE event_name = 'view_item' AND item_category IS NOT NULL GROUP BY item_name, item_category
  QUALIFY row_number() OVER (PARTITION BY item_name ORDER BY count(*) DESC, item_category) = 1
), visits AS (
  SELECT session_key, coalesce(modal.item_category, 'unknown') AS item_category,
    bool_or(event_name = 'view_item') AS v, bool_or(event_name = 'add_to_cart') AS c,
    bool_or(event_name = 'purchase') AS p,
    sum(quantity) FILTER (event_name = 'purchase') AS units,
    sum(item_revenue_in_usd) FILTER (event_name = 'purchase') AS revenue
  FROM named_items LEFT JOIN modal USING (item_name) GROUP BY ALL
), per_category AS (
  SELECT item_category, count(*) FILTER (v) AS sessions_viewed,
    count(*) FILTER (v AND c) AS sessions_viewed_and_carted,
    count(*) FILTER (v AND p) AS sessions_viewed_and_purchased,
    count(*) FILTER (p) AS sessions_purchased,
    CAST(coalesce(sum(units), 0) AS BIGINT) AS units_purchased,
    coalesce(sum(revenue), 0.0) AS item_revenue_in_usd
  FROM visits GROUP BY item_category
), product AS (
  SELECT item_category, CAST(CASE WHEN item_category = 'unknown' THEN 999
      ELSE row_number() OVER (ORDER BY sessions_viewed DESC, item_category) END AS INTEGER)
      AS category_sort,
    sessions_viewed, sessions_viewed_and_carted, sessions_viewed_and_purchased, sessions_purchased,
    units_purchased, item_revenue_in_usd, {_category_rates()},
    CASE WHEN sessions_viewed < 100 THEN 1 ELSE 0 END AS is_thin_cell
  FROM per_category
)"""

FUNNEL_DOUBLES = (
    "reach_rate reach_rate_lower reach_rate_upper step_conversion step_conversion_lower "
    "step_conversion_upper skipped_prev_share gap_vs_rest gap_vs_rest_lower gap_vs_rest_upper"
)
WEEK_DOUBLES = (
    "session_conversion_rate session_conversion_rate_lower session_conversion_rate_upper"
)
PRODUCT_DOUBLES = (
    "item_revenue_in_usd view_to_cart_rate view_to_cart_rate_lower view_to_cart_rate_upper "
    "view_to_purchase_rate view_to_purchase_rate_lower view_to_purchase_rate_upper"
)
EVENT_DOUBLES = "purchase_revenue purchase_revenue_in_usd tax_value tax_value_in_usd"
ITEM_DOUBLES = "price price_in_usd item_revenue item_revenue_in_usd"
FACT_TIMES = {"dates": "session_date", "times": "session_start session_end"}


# --- metrics ------------------------------------------------------------------------------

_SESSION_VALUES = {
    "sessions": "count(s.session_id)",
    "devices": "count(DISTINCT s.device_id)",
    "session_events_total": "CAST(sum(event_count) AS BIGINT)",
    "session_duration_min_total": "sum(date_sub('second', session_start, session_end) / 60.0::DOUBLE)",
    **{f"sessions_with_{s}": f"CAST(sum(reached_{s}) AS BIGINT)" for s in FUNNEL_EVENTS},
}


def metric_sql(
    names: list[str],
    by: tuple[str, ...] = (),
    grain: str | None = None,
    gap: int = DAY,
    where: str = "true",
    spine: bool = False,
    days: str = "",
) -> str:
    parts: list[str] = []
    for name in names:
        m = METRICS[name]
        for p in [name] if isinstance(m, Simple) else [m.numerator, m.denominator]:
            if p not in parts:
                parts.append(p)
    columns = {**DEVICE_DIMENSIONS, **TRAFFIC_DIMENSIONS}

    def dim(d: str, fact: str) -> str:
        if d in DEVICE_DIMENSIONS:
            return f"dev.{columns[d]}"
        if d in TRAFFIC_DIMENSIONS:
            return f"t.{columns[d]}"
        return f"se.{d}" if d.startswith("spans") else f"{fact}.{d}"

    def grouped(fact: str, source: str, date: str, values: dict[str, str]) -> str:
        keys = [f"{dim(d, fact)} AS {d}" for d in by]
        if grain:
            keys.insert(0, f"CAST(date_trunc('{grain}', {fact}.{date}) AS DATE) AS metric_time")
        select = ", ".join([*keys, *[f"{v} AS {n}" for n, v in values.items()]])
        group = f"GROUP BY {', '.join(str(n + 1) for n in range(len(keys)))}" if keys else ""
        return (
            f"SELECT {select} FROM {source} LEFT JOIN dev ON dev.device_id = {fact}.device_id "
            f"LEFT JOIN traffic AS t ON t.traffic_source_key = {fact}.traffic_source_key "
            f"WHERE {where} {f'AND {fact}.{date} {days}' if days else ''} {group}"
        )

    groups = (["metric_time"] if grain else []) + list(by)
    spans = "(SELECT session_id, spans_multiple_ga_sessions FROM fs) AS se"
    mine = {p: _SESSION_VALUES[p] for p in parts if p != "events"}
    selects = []
    if mine:
        source = f"fs AS s JOIN {spans} ON se.session_id = s.session_id"
        selects.append(grouped("s", source, "session_date", mine))
    if "events" in parts:
        source = f"fe AS e LEFT JOIN {spans} ON se.session_id = e.session_id"
        selects.append(grouped("e", source, "event_date", {"events": "count(e.event_id)"}))
    if len(selects) == 2:
        on = " AND ".join(f"a.{g} IS NOT DISTINCT FROM b.{g}" for g in groups) or "true"
        keys = [f"CASE WHEN a.hit = 1 THEN a.{g} ELSE b.{g} END AS {g}" for g in groups]
        joined = (
            f"SELECT {', '.join([*keys, *mine, 'events'])} FROM (SELECT *, 1 AS hit FROM ({selects[0]})) a "
            f"FULL JOIN (SELECT *, 1 AS hit FROM ({selects[1]})) b ON {on}"
        )
    else:
        joined = selects[0]
    if spine:
        joined = (
            f"SELECT p.date_day AS metric_time, x.* EXCLUDE (metric_time) FROM days AS p "
            f"LEFT JOIN ({joined}) x ON x.metric_time = p.date_day"
        )
    out, doubles = [], []
    for name in names:
        m = METRICS[name]
        if isinstance(m, Ratio):
            out.append(f"{ratio(m.numerator, m.denominator)} AS {name}")
            doubles.append(name)
        else:
            out.append(name)
            doubles += [name] if name == "session_duration_min_total" else []
    sql = f"SELECT {', '.join([*groups, *out])} FROM ({joined})"
    return tables(gap) + rounded(sql, " ".join(doubles), "metric_time" if grain else "")


# --- checks -------------------------------------------------------------------------------

_CHECK_TABLES = {
    "stg_events": "stg",
    "events_sessionised": "sess",
    "session_funnel_steps": "roll",
    "fct_sessions": "fs",
    "fct_events": "fe",
    "fct_event_items": f"(SELECT {key('event_id', 'item_index')} AS event_item_id, * FROM items)",
    "dim_devices": "dev",
    "dim_traffic_source": "traffic",
    "dim_date": "days",
    "attribution_history": "hist",
    "rpt_funnel": "funnel",
    "rpt_funnel_weekly": "weekly",
    "rpt_product_funnel": "product",
    "current_attribution": "cur",
    "attribution_snapshot": "snapshot",
    "dim_attribution": "(SELECT *, CAST(valid_to IS NULL AS INTEGER) AS is_current FROM snapshot)",
}


# What must hold, spelled out here: a check that the library lost is missed by the comparison.
_NOT_NULL = {
    "stg_events": "event_date time_stamp event_name device_id session_id",
    "events_sessionised": "session_key device_id session_num is_new_session",
    "session_funnel_steps": "session_key device_id session_num",
    "fct_sessions": "session_id ga_session_id device_id traffic_source_key",
    "fct_events": "event_id session_id device_id traffic_source_key event_date",
    "fct_event_items": "event_item_id event_id item_index",
    "dim_devices": "device_id",
    "dim_traffic_source": "traffic_source_key",
    "dim_date": "date_day",
    "attribution_history": "attribution_version_key device_id valid_from",
    "rpt_funnel": "segment_type",
    "rpt_funnel_weekly": "week_start",
    "rpt_product_funnel": "item_category",
    "current_attribution": "device_id traffic_source_key",
    "attribution_snapshot": "attribution_version_key device_id",
    "dim_attribution": "attribution_version_key device_id",
}
# (table, columns, rows looked at)
_UNIQUE = (
    ("session_funnel_steps", "session_key", "true"),
    ("fct_sessions", "session_id", "true"),
    ("fct_events", "event_id", "true"),
    ("fct_event_items", "event_item_id", "true"),
    ("dim_devices", "device_id", "true"),
    ("dim_traffic_source", "traffic_source_key", "true"),
    ("dim_date", "date_day", "true"),
    ("attribution_history", "attribution_version_key", "true"),
    ("attribution_history", "device_id", "is_current = 1"),
    ("rpt_funnel", "segment_type, segment_value, step", "true"),
    ("rpt_funnel_weekly", "week_start", "true"),
    ("rpt_product_funnel", "item_category", "true"),
    ("current_attribution", "device_id", "true"),
    ("attribution_snapshot", "attribution_version_key", "true"),
    ("dim_attribution", "attribution_version_key", "true"),
    ("dim_attribution", "device_id", "is_current = 1"),
)
_DEVICES = "'desktop', 'mobile', 'tablet'"
_STEPS = (
    "reached_session_start reached_view_item reached_add_to_cart reached_begin_checkout reached_add_shipping_info "
    "reached_add_payment_info reached_purchase"
)
# (table, columns, values)
_ACCEPTED = (
    ("stg_events", "device", _DEVICES),
    ("dim_devices", "device", _DEVICES),
    ("events_sessionised", "is_new_session", "0, 1"),
    ("session_funnel_steps", _STEPS, "0, 1"),
    ("fct_sessions", _STEPS, "0, 1"),
    ("attribution_history", "is_current", "0, 1"),
    ("dim_attribution", "is_current", "0, 1"),
    ("rpt_funnel", "segment_type", "'overall', 'device_category', 'continent', 'channel'"),
)
# (table, column, parent, its key)
_FOREIGN = (
    ("fct_sessions", "session_date", "dim_date", "date_day"),
    ("fct_sessions", "device_id", "dim_devices", "device_id"),
    ("fct_sessions", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    ("fct_events", "session_id", "fct_sessions", "session_id"),
    ("fct_events", "device_id", "dim_devices", "device_id"),
    ("fct_events", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    ("fct_events", "event_date", "dim_date", "date_day"),
    ("fct_event_items", "event_id", "fct_events", "event_id"),
    ("fct_event_items", "event_date", "dim_date", "date_day"),
    ("attribution_history", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    ("current_attribution", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    ("dim_attribution", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
)


def _check_sql() -> str:
    found = []

    def add(table: str, name: str, failures: str) -> None:
        found.append(f"SELECT '{table}' AS table_name, '{name}' AS check_name, 'error' AS severity, ({failures}) AS failures")

    for table, columns in _NOT_NULL.items():
        for c in columns.split():
            add(table, f"not_null({c})", f"SELECT count(*) FROM {_CHECK_TABLES[table]} AS x WHERE {c} IS NULL")
    for table, columns, where in _UNIQUE:
        held = "true" if "," in columns else f"{columns} IS NOT NULL"
        doubled = f"SELECT {columns} FROM {_CHECK_TABLES[table]} AS x WHERE {held} AND {where} GROUP BY {columns} HAVING count(*) > 1"
        add(table, f"unique({columns})", f"SELECT count(*) FROM ({doubled})")
    for table, columns, values in _ACCEPTED:
        for c in columns.split():
            add(table, f"accepted_values({c})", f"SELECT count(*) FROM {_CHECK_TABLES[table]} AS x WHERE {c} NOT IN ({values})")
    for table, c, parent, own in _FOREIGN:
        orphans = f"x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT {own} FROM {_CHECK_TABLES[parent]} AS y)"
        add(table, f"relationships({c})", f"SELECT count(DISTINCT x.{c}) FROM {_CHECK_TABLES[table]} AS x WHERE {orphans}")
    return tables().rstrip() + f", snapshot AS ({_snapshot_sql('*')}) " + " UNION ALL ".join(found)


# (name, table, its row, value, expected, tolerance)
_FIGURES = (
    ("sessions", "funnel", "segment_type = 'overall' AND step = 'sessions'", "segment_sessions", "1214", "0"),
    ("purchasing sessions", "funnel", "segment_type = 'overall' AND step = 'purchase'", "sessions_reached", "817", "0"),
    ("conversion", "funnel", "segment_type = 'overall' AND step = 'purchase'", "reach_rate", "0.673", "0.0001"),
    ("never viewing", "funnel", "segment_type = 'overall' AND step = 'view_item'", "1 - reach_rate", "0.328", "0.001"),
    ("view to cart", "funnel", "segment_type = 'overall' AND step = 'add_to_cart'", "step_conversion", "0.748", "0.001"),
    ("checkouts without cart", "funnel", "segment_type = 'overall' AND step = 'begin_checkout'", "skipped_prev_share", "0.231", "0.001"),
    ("referral gap", "funnel", "segment_type = 'channel' AND segment_value = 'referral' AND step = 'purchase'", "gap_vs_rest", "0.0136", "0.0001"),
    ("unknown channel", "funnel", "segment_type = 'channel' AND segment_value = 'unknown' AND step = 'purchase'", "reach_rate", "0.702", "0.001"),
    ("week of 8 Jan", "weekly", "week_start = DATE '2024-01-08'", "session_conversion_rate", "0.7015", "0.0001"),
    ("week of 22 Jan", "weekly", "week_start = DATE '2024-01-22'", "session_conversion_rate", "0.6181", "0.0001"),
    ("large: view to purchase", "product", "item_category = 'home/large/'", "view_to_purchase_rate", "0.5", "0.0001"),
    ("large: share of revenue", "product", "item_category = 'home/large/'", "item_revenue_in_usd / sum(item_revenue_in_usd) OVER ()", "0.35", "0.005"),
)


def _figure_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST(actual AS DOUBLE) AS actual, {expected}::DOUBLE AS expected, {tolerance}::DOUBLE AS tolerance "
        f"FROM (SELECT *, {value} AS actual FROM {table}) WHERE {row}"
        for name, table, row, value, expected, tolerance in _FIGURES
    )
    sql = f"SELECT *, 'warn' AS severity FROM ({each}) WHERE abs(actual - expected) > tolerance"
    return tables(DAY) + rounded(sql, "actual expected tolerance")


# --- snapshot -----------------------------------------------------------------------------


def _snapshot_sql(columns: str) -> str:
    one, two = (run_micros(r) for r in RUNS)
    state = f"device_id, traffic_source_key, {', '.join(TRAFFIC)}, attributed_at"

    def opened(at: int) -> str:
        return (
            f"CAST({at} AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, "
            f"md5(device_id || '|{at}') AS attribution_version_key, "
            f"CAST({at} AS BIGINT) AS snapshot_updated_at"
        )

    changed = "e.traffic_source_key <> c.traffic_source_key"
    was = ", ".join(f"e.{c.strip()}" for c in state.split(","))
    return f"""SELECT {columns} FROM (
      SELECT {was}, v.valid_from, CASE WHEN {changed} THEN CAST({two} AS BIGINT) END AS valid_to,
        v.attribution_version_key, v.snapshot_updated_at
      FROM early AS e JOIN (SELECT device_id, {opened(one)} FROM early) AS v USING (device_id)
      LEFT JOIN cur AS c ON c.device_id = e.device_id
      UNION ALL
      SELECT {state}, {opened(two)} FROM cur AS c WHERE NOT EXISTS (
        SELECT 1 FROM early AS e WHERE e.device_id = c.device_id
          AND e.traffic_source_key = c.traffic_source_key))"""


# --- profiles -----------------------------------------------------------------------------

_PROFILED = (
    "event_date event_name device_id page_title page_location session_id device brand continent "
    "sub_continent country region city medium traffic_source source_name transaction_id "
    "total_item_quantity unique_items time_stamp first_touch purchase_revenue "
    "purchase_revenue_in_usd tax_value tax_value_in_usd"
).split()


def _union(selects) -> str:
    return " UNION ALL ".join(selects)


def _profile_sql() -> str:
    rows = _union(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM stg" for c in _PROFILED
    ) + (
        " UNION ALL SELECT 'items', CAST(n AS VARCHAR) FROM (SELECT eid FROM sess) AS e "
        "LEFT JOIN (SELECT eid, count(*) AS n FROM raw_items GROUP BY eid) AS i USING (eid)"
    )
    return tables() + f"""
    SELECT column_name, n_rows, n_filled, n_placeholder, n_distinct,
      CASE WHEN n_filled = 0 THEN 'empty' WHEN n_placeholder = n_filled THEN 'placeholder only'
           WHEN n_distinct = 1 AND n_filled = n_rows THEN 'constant' ELSE 'varies' END AS verdict
    FROM (SELECT column_name, count(*) AS n_rows, count(value) AS n_filled,
      count(*) FILTER (lower(value) IN ('(not set)', '(data deleted)', '(none)', '<other>'))
        AS n_placeholder, count(DISTINCT value) AS n_distinct FROM ({rows}) GROUP BY 1)"""


def _placeholder_sql() -> str:
    return tables() + _union(
        f"SELECT * FROM (SELECT '{c}' AS column_name, '{t}' AS placeholder, "
        f"count(*) AS n_rows FROM raw WHERE lower({r}) = '{t}') WHERE n_rows > 0"
        for c, r in _RAW_TEXT.items()
        for t in ("(not set)", "(data deleted)", "(none)")
    )


_PARAMS = """
  SELECT 'page_title' AS param_key, raw_title AS s, CAST(NULL AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS d
  FROM raw WHERE k % 7 <> 0
  UNION ALL SELECT 'page_location', raw_location, NULL, NULL FROM raw
  UNION ALL SELECT 'ga_session_id', NULL, native_id, NULL FROM raw
  UNION ALL SELECT 'engaged', CASE WHEN k % 2 = 0 THEN '0' END, CASE WHEN k % 2 = 1 THEN 1 END, NULL
  FROM raw
  UNION ALL SELECT 'engaged', '0', NULL, NULL FROM raw WHERE k % 50 = 0
  UNION ALL SELECT 'value', NULL, NULL, value FROM raw"""


def _nesting_sql() -> str:
    steps = REPORT_STEPS[1:]
    rows = _union(
        f"SELECT '{late}' AS step, '{early}' AS earlier_step, "
        f"CAST(sum(reached_{late}) AS BIGINT) AS sessions_reached, "
        f"count(*) FILTER (reached_{late} = 1 AND reached_{early} = 0) AS skipped FROM fs"
        for n, late in enumerate(steps)
        for early in steps[:n]
    )
    sql = f"SELECT *, {ratio('skipped', 'sessions_reached')} AS skipped_share FROM ({rows})"
    return tables(DAY) + rounded(sql, "skipped_share")


def _drift_sql() -> str:
    rows = _union(
        f"SELECT '{c}' AS attribute, device_id, count(DISTINCT coalesce({c}, chr(0))) AS n "
        "FROM stg GROUP BY device_id"
        for c in (*DEVICE_COLUMNS, *TRAFFIC)
    ) + (
        " UNION ALL SELECT 'traffic combination', device_id, "
        "count(DISTINCT row(medium, traffic_source, source_name)) FROM stg GROUP BY device_id"
    )
    return tables() + (
        "SELECT attribute, count(*) AS devices, count(*) FILTER (n > 1) AS devices_drifting, "
        f"max(n) AS max_values FROM ({rows}) GROUP BY 1"
    )


def _overlap_sql() -> str:
    return tables() + _union(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) FILTER (event_name = 'purchase') AS BIGINT) AS n_left, "
        f"(SELECT count(*) FROM (SELECT {c} FROM items WHERE event_name = 'purchase' AND {c} IS NOT NULL "
        f"INTERSECT SELECT {c} FROM items WHERE event_name = 'view_item')) AS n_shared FROM items"
        for c in ("item_name", "item_id", "item_category")
    )


def _percent(v: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f%%', {v} * 100)"


def _verdict() -> str:
    return (
        "CASE WHEN gap_vs_rest_lower > 0 OR gap_vs_rest_upper < 0 THEN 'differs' "
        "WHEN gap_vs_rest_lower IS NOT NULL THEN 'within_noise' END"
    )


def _text_sql() -> str:
    rows = _union(f"SELECT '{c}' AS field, {r} AS raw_text FROM raw" for c, r in _RAW_TEXT.items())
    return tables() + (
        f"SELECT field, raw_text, n_rows, {cleaned('raw_text')} AS cleaned FROM (SELECT field, "
        f"raw_text, count(*) AS n_rows FROM ({rows} UNION ALL SELECT 'url', url FROM pages) GROUP BY 1, 2)"
    )


def _item_text_sql() -> str:
    rows = _union(f"SELECT '{c}' AS field, raw_{c} AS raw_text FROM raw_items" for c in _ITEM_TEXTS)
    return tables() + (
        f"SELECT field, raw_text, n_rows, {cleaned_item('raw_text')} AS cleaned FROM (SELECT field, "
        f"raw_text, count(*) AS n_rows FROM ({rows}) GROUP BY 1, 2)"
    )


def _calendar_columns(d: str) -> str:
    return (
        f"CAST(year({d}) AS INTEGER) AS year, CAST(quarter({d}) AS INTEGER) AS quarter, "
        f"strftime({d}, '%Y-%m') AS year_month, strftime({d}, '%B') AS month_name, "
        f"CAST(month({d}) AS INTEGER) AS month_sort, CAST(week({d}) AS INTEGER) AS iso_week, "
        f"strftime({d}, '%A') AS day_name, CAST(isodow({d}) AS INTEGER) AS day_sort, "
        f"CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END AS is_weekend"
    )


def oracles() -> dict[str, str]:
    lo, hi = WINDOW
    in_window = (
        f"event_date BETWEEN strptime('{lo}', '%Y%m%d') AND strptime('{hi}', '%Y%m%d')"
    )
    stg_columns = (
        "event_date, time_stamp, event_name, device_id, page_title, page_location, session_id, "
        f"first_touch, {', '.join(_RAW_TEXT)}, {', '.join(MEASURES)}"
    )
    stg_times = {"dates": "event_date", "times": "time_stamp first_touch"}
    fact_columns = (
        "session_id, ga_session_id, ga_session_count, session_date, session_start, session_end, "
        f"event_count, device_id, traffic_source_key, {', '.join(f'reached_{s}' for s in FUNNEL_EVENTS)}"
    )
    steps_columns = (
        "session_key, device_id, session_num, session_start, session_end, event_count, first_touch, "
        "medium AS first_touch_medium, traffic_source AS first_touch_source, "
        f"source_name AS first_touch_source_name, {', '.join(f'reached_{s}' for s in FUNNEL_EVENTS)}"
    )
    wilson_n = "(n - n)"
    out = {
        "text_cleaning": _text_sql(),
        "item_text_cleaning": _item_text_sql(),
        "event_params": tables() + rounded(
            "SELECT lower('U' || CAST(user_id AS VARCHAR)) AS device_id, us AS event_timestamp, "
            "raw_title AS page_title, raw_location AS page_location, native_id AS ga_session_id, "
            "CAST(NULL AS VARCHAR) AS wrong_field, value AS value_double, "
            "CAST(NULL AS DOUBLE) AS value_float, CAST(NULL AS VARCHAR) AS absent FROM raw",
            "value_double value_float",
        ),
        "surrogate_keys": f"SELECT *, {key('p_brand', 'p_type', 'p_name')} AS part_group_key FROM ("
        "SELECT DISTINCT p_brand, nullif(p_type, 'SMALL') AS p_type, "
        "CASE WHEN p_size < 10 THEN '' ELSE p_name END AS p_name FROM part)",
        "wilson_intervals": rounded(
            f"SELECT user_id, k, n, {ratio('k', 'n')} AS share, {wilson('k', 'n', 'lower')} AS lower, "
            f"{wilson('k', 'n', 'upper')} AS upper, {wilson('k', wilson_n, 'lower')} AS no_trials "
            "FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS k, count(*) AS n "
            "FROM events GROUP BY 1)",
            "share lower upper no_trials",
        ),
        "newcombe_intervals": rounded(
            f"""SELECT *, {newcombe("k", "n", "rest_k", "rest_n", "lower")} AS lower,
            {newcombe("k", "n", "rest_k", "rest_n", "upper")} AS upper,
            {newcombe("rest_k", "rest_n", "k", "n", "lower")} AS swapped_lower,
            {newcombe("k", "n", "rest_k", "(rest_n - rest_n)", "upper")} AS no_rest
            FROM (SELECT *, CAST(sum(k) OVER () - k AS BIGINT) AS rest_k,
              CAST(sum(n) OVER () - n AS BIGINT) AS rest_n FROM (
                SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n
                FROM orders GROUP BY 1))""",
            "lower upper swapped_lower no_rest",
        ),
        "calendar_parts": rounded(
            f"SELECT day, {_calendar_columns('day')}, CAST(date_trunc('week', day) AS DATE) AS week_start, "
            "strftime(date_trunc('week', day), '%d %b') AS week_label "
            "FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
            "",
            "day week_start",
        ),
        "stg_events": tables() + rounded(
            f"SELECT {stg_columns}, n_items FROM stg", EVENT_DOUBLES, **stg_times
        ),
        "stg_events_window": tables() + rounded(
            "SELECT event_date, event_name, count(*) AS n_events, count(DISTINCT device_id) AS n_devices "
            f"FROM stg WHERE {in_window} GROUP BY 1, 2",
            "",
            "event_date",
        ),
        "stg_events_shards": tables() + rounded(
            f"SELECT event_date, count(*) AS n_events FROM stg WHERE {in_window} GROUP BY 1",
            "",
            "event_date",
        ),
        "events_sessionised": tables() + rounded(
            f"SELECT session_key, {stg_columns}, is_new_session, session_num, mins_since_prev FROM sess",
            EVENT_DOUBLES,
            **stg_times,
        ),
        "events_sessionised_day_gap": tables(DAY) + rounded(
            "SELECT session_key, device_id, time_stamp, is_new_session, session_num, mins_since_prev FROM sess",
            "",
            "",
            "time_stamp",
        ),
        "session_funnel_steps": tables(DAY) + rounded(
            f"SELECT {steps_columns} FROM roll", "", "", "session_start session_end first_touch"
        ),
        "fct_sessions": tables() + rounded("SELECT * FROM fs", "", **FACT_TIMES),
        "fct_sessions_day_gap": tables(DAY) + rounded("SELECT * FROM fs", "", **FACT_TIMES),
        "fct_sessions_by_join": tables(DAY)
        + rounded(f"SELECT {fact_columns} FROM fs", "", **FACT_TIMES),
        "fct_events": tables()
        + rounded("SELECT * FROM fe", EVENT_DOUBLES, "event_date", "time_stamp"),
        "fct_event_items": tables() + rounded(
            f"SELECT {key('event_id', 'item_index')} AS event_item_id, * EXCLUDE (session_key) FROM items",
            ITEM_DOUBLES,
            "event_date",
        ),
        "dim_devices": tables() + "SELECT * FROM dev",
        "dim_traffic_source": tables() + "SELECT * FROM traffic",
        "dim_date": tables() + rounded(
            f"SELECT date_day, {_calendar_columns('date_day')} FROM days", "", "date_day"
        ),
        "attribution_versions": tables()
        + rounded("SELECT * FROM hist", "", "", "valid_from valid_to"),
        "attribution_asof": tables() + rounded(
            f"SELECT s.device_id, s.time_stamp, s.event_name, {key(*[f's.{c}' for c in TRAFFIC])} "
            "AS event_key, h.version_num, h.traffic_source_key, h.valid_from FROM stg AS s "
            "LEFT JOIN hist AS h ON h.device_id = s.device_id AND s.time_stamp >= h.valid_from "
            "AND (h.valid_to IS NULL OR s.time_stamp < h.valid_to)",
            "",
            "",
            "time_stamp valid_from",
        ),
        "attribution_asof_sessions": tables() + rounded(
            "SELECT s.session_id, s.device_id, s.looked_up_at, h.version_num FROM (SELECT *, "
            "session_start - INTERVAL 1 MICROSECOND AS looked_up_at FROM fs) AS s "
            "LEFT JOIN hist AS h ON h.device_id = s.device_id AND s.looked_up_at >= h.valid_from "
            "AND (h.valid_to IS NULL OR s.looked_up_at < h.valid_to)",
            "",
            "",
            "looked_up_at",
        ),
        "attribution_current": tables() + rounded("SELECT * FROM cur", "", "", "attributed_at"),
        "attribution_current_lookup": tables()
        + "SELECT s.device_id, s.session_id, h.version_num, h.medium FROM fs AS s "
        "LEFT JOIN hist AS h ON h.device_id = s.device_id AND h.is_current = 1",
        "attribution_snapshot": tables() + _snapshot_sql("* REPLACE (epoch_us(attributed_at) AS attributed_at)"),
        "attribution_log": tables() + _snapshot_sql("* REPLACE (epoch_us(attributed_at) AS attributed_at)"),
        "attribution_log_before": tables()
        + "SELECT * REPLACE (CAST(NULL AS BIGINT) AS valid_to) FROM ("
        + _snapshot_sql("* REPLACE (epoch_us(attributed_at) AS attributed_at)")
        + f") WHERE valid_from <= {run_micros(RUNS[0])}",
        "dim_attribution": tables() + _snapshot_sql(
            "attribution_version_key, device_id, traffic_source_key, medium, traffic_source, "
            "source_name, valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END AS is_current"
        ),
        "incremental_overwrite": tables() + rounded(
            "SELECT event_date, event_name, count(*) AS n_events FROM stg "
            f"WHERE NOT ({in_window}) OR event_name = 'purchase' GROUP BY 1, 2",
            "",
            "event_date",
        ),
        "built_window": tables(DAY, in_window)
        + rounded(f"SELECT {fact_columns} FROM fs", "", **FACT_TIMES),
        "funnel_overall": tables(DAY) + rounded(
            "SELECT step, step_sort, segment_sessions, sessions_reached, reach_rate, "
            "reach_rate_lower, reach_rate_upper FROM funnel WHERE segment_type = 'overall'",
            "reach_rate reach_rate_lower reach_rate_upper",
        ),
        "rpt_funnel": tables() + rounded("SELECT * FROM funnel", FUNNEL_DOUBLES),
        "rpt_funnel_day_gap": tables(DAY) + rounded("SELECT * FROM funnel", FUNNEL_DOUBLES),
        "funnel_grouping_sets": tables(DAY) + "SELECT * FROM steps",
        "rpt_funnel_weekly": tables()
        + rounded("SELECT * FROM weekly", WEEK_DOUBLES, "week_start"),
        "rpt_funnel_weekly_day_gap": tables(DAY)
        + rounded("SELECT * FROM weekly", WEEK_DOUBLES, "week_start"),
        "product_category": tables() + "SELECT * FROM modal",
        "rpt_product_funnel": tables(DAY) + rounded("SELECT * FROM product", PRODUCT_DOUBLES),
        "rpt_product_funnel_from_facts": tables(DAY)
        + rounded("SELECT * FROM product", PRODUCT_DOUBLES),
        "rpt_events_daily": tables() + rounded(
            "SELECT e.event_date, e.event_name, dev.device AS device_category, dev.continent, "
            "t.medium, t.traffic_source, t.source_name, count(*) AS events, "
            "sum(e.purchase_revenue_in_usd) AS purchase_revenue_in_usd FROM fe AS e "
            "LEFT JOIN dev ON dev.device_id = e.device_id "
            "LEFT JOIN traffic AS t ON t.traffic_source_key = e.traffic_source_key "
            "GROUP BY 1, 2, 3, 4, 5, 6, 7",
            "purchase_revenue_in_usd",
            "event_date",
        ),
        "rpt_event_items_daily": tables() + rounded(
            "SELECT event_date, event_name, item_name, count(*) AS item_rows, "
            "CAST(sum(quantity) AS BIGINT) AS quantity, sum(item_revenue_in_usd) AS item_revenue_in_usd "
            "FROM items GROUP BY 1, 2, 3",
            "item_revenue_in_usd",
            "event_date",
        ),
        "gap_significance": tables(DAY) + rounded(
            "SELECT segment_type, segment_value, step, gap_vs_rest, verdict, "
            "CASE WHEN verdict = 'differs' THEN gap_vs_rest END AS differs, "
            "CASE WHEN verdict = 'within_noise' THEN gap_vs_rest END AS within_noise "
            f"FROM (SELECT *, {_verdict()} AS verdict FROM funnel WHERE segment_type <> 'overall')",
            "gap_vs_rest differs within_noise",
        ),
        "headline_tiles": tables(DAY) + ", top AS (SELECT * FROM funnel WHERE "
        "segment_type = 'overall' AND step = 'purchase') "
        "SELECT 1 AS tile_sort, 'sessions' AS tile, CAST(segment_sessions AS VARCHAR) AS tile_text FROM top "
        "UNION ALL SELECT 2, 'purchasing sessions', CAST(sessions_reached AS VARCHAR) FROM top "
        f"UNION ALL SELECT 3, 'session conversion rate', {_percent('reach_rate')} FROM top "
        f"UNION ALL SELECT 4, '95% CI', {_percent('reach_rate_lower')} || ' - ' || {_percent('reach_rate_upper')} FROM top",
        "overall_steps": tables(DAY) + rounded(
            "SELECT step_sort, step, sessions_reached, reach_rate, step_conversion, "
            "step_conversion_lower, step_conversion_upper, skipped_prev_share, "
            f"CAST(sessions_reached AS VARCHAR) || ' (' || {_percent('reach_rate', 1)} || ')' AS bar_label "
            "FROM funnel WHERE segment_type = 'overall'",
            "reach_rate step_conversion step_conversion_lower step_conversion_upper skipped_prev_share",
        ),
        "segments_at_step": tables(DAY) + rounded(
            "SELECT segment_type, segment_type_sort, segment_sort, CASE WHEN is_thin_segment = 1 "
            "THEN segment_value || ' (thin)' ELSE segment_value END AS segment_label, segment_sessions, "
            "reach_rate, reach_rate_lower, reach_rate_upper, gap_vs_rest, gap_vs_rest_lower, "
            f"gap_vs_rest_upper, {_verdict()} AS verdict FROM funnel "
            "WHERE segment_type <> 'overall' AND step = 'purchase'",
            "reach_rate reach_rate_lower reach_rate_upper gap_vs_rest gap_vs_rest_lower gap_vs_rest_upper",
        ),
        "weekly_trend": tables(DAY) + rounded(
            "SELECT week_start, sessions, session_conversion_rate, "
            "session_conversion_rate - session_conversion_rate_lower AS session_conversion_err_minus, "
            "session_conversion_rate_upper - session_conversion_rate AS session_conversion_err_plus "
            "FROM weekly WHERE is_partial_week = 0",
            "session_conversion_rate session_conversion_err_minus session_conversion_err_plus",
            "week_start",
        ),
        "weekly_peak_low": tables(DAY) + rounded(
            "SELECT kind, week_start, week_label, session_conversion_rate FROM ("
            "(SELECT 'peak' AS kind, * FROM weekly WHERE is_partial_week = 0 "
            "ORDER BY session_conversion_rate DESC, week_start LIMIT 1) UNION ALL "
            "(SELECT 'low', * FROM weekly WHERE is_partial_week = 0 "
            "ORDER BY session_conversion_rate, week_start LIMIT 1))",
            "session_conversion_rate",
            "week_start",
        ),
        "top_categories": tables(DAY) + rounded(
            "SELECT category_sort, CASE WHEN is_thin_cell = 1 THEN item_category || ' (thin)' "
            "ELSE item_category END AS category_label, sessions_viewed, "
            "CASE WHEN nth = 1 THEN view_to_purchase_rate END AS highlight, "
            "CASE WHEN nth > 1 THEN view_to_purchase_rate END AS others, "
            "view_to_purchase_rate - view_to_purchase_rate_lower AS err_minus, "
            "view_to_purchase_rate_upper - view_to_purchase_rate AS err_plus FROM ("
            "SELECT *, row_number() OVER (ORDER BY category_sort, item_category) AS nth FROM product) "
            "WHERE nth <= 12",
            "highlight others err_minus err_plus",
        ),
        "funnel_error_bars": tables(DAY) + rounded(
            "SELECT segment_type, segment_value, step, " + ", ".join(
                f"{r} - {r}_lower AS {r.removesuffix('_rate')}_err_minus, "
                f"{r}_upper - {r} AS {r.removesuffix('_rate')}_err_plus"
                for r in ("reach_rate", "step_conversion", "gap_vs_rest")
            ) + " FROM funnel",
            "reach_err_minus reach_err_plus step_conversion_err_minus step_conversion_err_plus "
            "gap_vs_rest_err_minus gap_vs_rest_err_plus",
        ),
        "product_error_bars": tables(DAY) + rounded(
            "SELECT item_category, " + ", ".join(
                f"view_to_{g}_rate - view_to_{g}_rate_lower AS view_to_{g}_err_minus, "
                f"view_to_{g}_rate_upper - view_to_{g}_rate AS view_to_{g}_err_plus"
                for g in ("cart", "purchase")
            ) + " FROM product",
            "view_to_cart_err_minus view_to_cart_err_plus view_to_purchase_err_minus "
            "view_to_purchase_err_plus",
        ),
        "attribution_snapshot_asof": tables() + rounded(
            "SELECT s.session_id, s.device_id, s.session_start, v.attribution_version_key, v.medium "
            f"FROM fs AS s LEFT JOIN ({_snapshot_sql('*')}) AS v ON v.device_id = s.device_id "
            "AND epoch_us(s.session_start) >= v.valid_from "
            "AND (v.valid_to IS NULL OR epoch_us(s.session_start) < v.valid_to)",
            "",
            "",
            "session_start",
        ),
        "attribution_snapshot_current": tables()
        + "SELECT s.session_id, s.device_id, v.attribution_version_key, v.medium FROM fs AS s "
        f"LEFT JOIN ({_snapshot_sql('*')}) AS v ON v.device_id = s.device_id AND v.valid_to IS NULL",
        "attribution_missing_keys": tables() + rounded(
            "SELECT f.device_id, f.time_stamp, f.event_name, f.session_id, h.version_num, "
            "c.version_num AS current_num FROM (SELECT event_name, session_id, "
            "CASE WHEN NOT ends_with(device_id, '9') THEN device_id END AS device_id, "
            "CASE WHEN NOT ends_with(session_id, '7') THEN time_stamp END AS time_stamp FROM stg) AS f "
            "LEFT JOIN hist AS h ON h.device_id = f.device_id AND f.time_stamp >= h.valid_from "
            "AND (h.valid_to IS NULL OR f.time_stamp < h.valid_to) "
            "LEFT JOIN hist AS c ON c.device_id = f.device_id AND c.is_current = 1",
            "",
            "",
            "time_stamp",
        ),
        "revenue_share": tables(DAY) + rounded(
            "SELECT item_category, item_revenue_in_usd, item_revenue_in_usd / "
            "(SELECT sum(item_revenue_in_usd) FROM product) AS revenue_share FROM product",
            "item_revenue_in_usd revenue_share",
        ),
        "exported_report": tables(DAY)
        + rounded("SELECT * FROM weekly", WEEK_DOUBLES, "week_start"),
        "metrics_by_day": metric_sql(list(METRICS), grain="day", spine=True),
        "metrics_by_week": metric_sql(list(METRICS), grain="week"),
        "metrics_overall": metric_sql(list(METRICS)),
        "metrics_by_segment": metric_sql(
            ["sessions", "devices", "session_conversion_rate", "events_per_session",
             "avg_session_duration_min"],
            ("device_category", "continent", "source"),
        ),
        "metrics_by_geography": metric_sql(
            ["sessions", "devices", "view_item_rate", "events"],
            ("sub_continent", "country", "region", "city", "brand"),
            "month",
        ),
        "metrics_by_native_span": metric_sql(
            ["sessions", "devices", "events", "add_to_cart_rate"],
            ("spans_multiple_ga_sessions", "campaign"),
            where="(t.medium IN ('organic', 'cpc') OR t.medium IS NULL)",
        ),
        "metrics_in_window": metric_sql(
            ["sessions", "events", "begin_checkout_rate", "session_start_rate"],
            ("spans_multiple_ga_sessions",),
            "quarter",
            days=in_window.removeprefix("event_date"),
        ),
        "metric_events": metric_sql(["events"], ("event_name", "medium"), "month", 1800),
        "dq_failures": _check_sql(),
        "dq_failing_rows": """
            SELECT 'unique_combination(l_orderkey, l_linenumber)' AS check_name,
              CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS failing,
              count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
            UNION ALL SELECT 'unique(p_name) where p_size > 25', p_name, count(*) FROM part
              WHERE p_size > 25 GROUP BY p_name HAVING count(*) > 1
            UNION ALL SELECT 'accepted_values(o_orderstatus)', o_orderstatus, count(*) FROM orders
              WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus
            UNION ALL SELECT 'relationships(c_custkey)', CAST(c_custkey AS VARCHAR), count(*)
              FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_custkey
            UNION ALL SELECT 'not_null(p_brand)', NULL, count(*) FROM part WHERE p_brand = 'Brand#1'
              HAVING count(*) > 0""",
        "figure_parity": _figure_sql(),
        "reconciliation": tables() + rounded(_union(
            f"SELECT '{m}' AS measure, {v} AS fact_total, {v} AS rollup_total, 1 AS reconciles FROM {t}"
            for m, v, t in (
                ("events", "CAST(count(*) AS DOUBLE)", "fe"),
                ("purchase_revenue", "sum(purchase_revenue_in_usd)", "fe"),
                ("item_rows", "CAST(count(*) AS DOUBLE)", "items"),
                ("item_revenue", "sum(item_revenue_in_usd)", "items"),
            )
        ), "fact_total rollup_total"),
        "profile_columns": _profile_sql(),
        "profile_placeholders": _placeholder_sql(),
        "profile_natural_key": tables()
        + "SELECT device_id, session_id, event_name, count(*) AS n_rows FROM stg "
        "GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "profile_repeated_params": tables()
        + "SELECT lower('U' || CAST(user_id AS VARCHAR)) AS device_id, us AS event_timestamp, "
        "1 AS surplus_keys FROM raw WHERE k % 50 = 0",
        "profile_param_fields": tables() + f"""
            SELECT param_key, n_rows, n_string_value, n_int_value, CAST(0 AS BIGINT) AS n_float_value,
              n_double_value, CASE WHEN (n_string_value > 0)::INT + (n_int_value > 0)::INT
                + (n_double_value > 0)::INT > 1 THEN 1 ELSE 0 END AS is_mixed
            FROM (SELECT param_key, count(*) AS n_rows, count(s) AS n_string_value,
              count(i) AS n_int_value, count(d) AS n_double_value FROM ({_PARAMS}) GROUP BY 1)""",
        "profile_explode_cost": tables() + rounded(
            f"SELECT events, param_rows, {ratio('param_rows', 'events')} AS rows_per_event FROM "
            f"(SELECT (SELECT count(*) FROM raw) AS events, (SELECT count(*) FROM ({_PARAMS})) AS param_rows)",
            "rows_per_event",
        ),
        "profile_attribute_drift": _drift_sql(),
        "profile_session_mismatch": tables() + _union(
            f"SELECT '{label}' AS direction, count(*) AS total, count(*) FILTER (n > 1) AS mismatched "
            f"FROM (SELECT count(DISTINCT {what}) AS n FROM sess GROUP BY device_id, {by})"
            for label, what, by in (
                ("sessions with several native ids", "session_id", "session_num"),
                ("native sessions split", "session_num", "session_id"),
            )
        ),
        "profile_key_overlap": _overlap_sql(),
        "profile_step_nesting": _nesting_sql(),
        "streamed_sessions": tables() + rounded(
            f"SELECT device_id, session_start, session_end, event_count, session_date, "
            f"{', '.join(TRAFFIC)}, {', '.join(f'reached_{s}' for s in FUNNEL_EVENTS)} FROM roll",
            "",
            **FACT_TIMES,
        ),
    }
    out["streamed_numbered_sessions"] = tables(
        device=f"CASE WHEN user_id % 10 <> 9 THEN {DEVICE} END", time="CASE WHEN k <> 13 THEN ts END"
    ) + rounded(f"SELECT {fact_columns} FROM fs", "", **FACT_TIMES)
    refreshed = {"sessions": "fct_sessions", "events": "fct_events", "attribution": "attribution_versions", "devices": "dim_devices", "funnel": "rpt_funnel"}
    return out | {f"refreshed_{name}": out[same] for name, same in refreshed.items()}
