"""A refresh by day leaves every table as a full build over the same days would."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionloom.config import Settings
from sessionloom.operators.checks import Check
from sessionloom.operators.runs import HotKeys
from sessionloom.plans.incremental import TABLES, full_build, refresh, tables
from sessionloom.sources.export import EXPORT_SCHEMA
from sessionloom.sources.tables import work_folder
from sessionloom.sources.versions import ChangeLost, CheckFailed, TableStore

T0 = datetime(2024, 1, 1)
NAMES = ("session_start", "view_item", "add_to_cart", "begin_checkout", "purchase", "page_view")


def export(spark, rows):
    """rows: (device, seconds from 1 January, native session id, event name, medium[, day])."""
    data = []
    for device, second, native, name, medium, *day in rows:
        at = None if second is None else T0 + timedelta(seconds=second)
        date = day[0] if day else (at or T0).strftime("%Y%m%d")
        micros = None if at is None else round((at - datetime(1970, 1, 1)).total_seconds()) * 10**6
        param = {"key": "ga_session_id", "value": {"int_value": native}}
        item = {"item_id": "i", "item_name": f"n{native % 3}", "item_category": f"c{native % 3}", "quantity": 1, "item_revenue_in_usd": 2.0}
        data.append(
            {
                "event_date": date, "event_timestamp": micros, "event_name": name, "user_pseudo_id": device, "user_first_touch_timestamp": micros,
                "event_params": [param], "device": {"category": "desktop" if native % 2 else "mobile"}, "geo": {"continent": f"k{native % 4}"},
                "traffic_source": {"medium": medium, "source": medium, "name": medium}, "ecommerce": {}, "items": [item] if native % 2 else [],
            }
        )
    return spark.createDataFrame(data, EXPORT_SCHEMA)


def between(df, start, end):
    return df.where(F.col("event_date").between(start, end))


def content(df):
    """Rows as text, real numbers rounded, since sums depend on the order."""
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.select(*rounded).collect()))


def assert_same(store, other):
    mine, full = tables(store), tables(other)
    for name in TABLES:
        a, b = content(mine[name].select(*sorted(mine[name].columns))), content(full[name].select(*sorted(full[name].columns)))
        assert a == b, (name, [x for x in a if x not in b][:3], [x for x in b if x not in a][:3])


def built(spark, raw, policy=HotKeys()):
    store = TableStore(spark, work_folder(spark, "build"))
    full_build(store, raw, SETTINGS, policy)
    return store


SETTINGS = Settings(start_date="20240101", end_date="20240112")
HOUR, DAY = 3600, 86_400


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Hundreds of small jobs: compiling their plans would take most of the time."""
    put = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cases():
    """Events before and after 2 January is refreshed, by device; 'a' and 'z' have days after it."""
    bridge = [("a", s, 1, "add_to_cart", "m") for s in range(DAY, 2 * DAY + 1, 1500)]
    stays = [
        # The refreshed day joins sessions of both sides; later numbers move.
        ("a", DAY - 600, 1, "view_item", "m"), ("a", 2 * DAY + 300, 2, "purchase", "n"), ("a", 5 * DAY, 3, "view_item", "m"),
        # A late event is dated to it that lies before events of the day before.
        ("late", 100, 1, "view_item", "m"), ("late", 10 * HOUR, 2, "purchase", "n"), ("late", DAY + 50, 3, "view_item", "o"), ("late", 3 * DAY, 4, "page_view", "m"),
        # Numbers agree again: of the day after only the first event changes.
        *[("agrees", d * DAY + 7200, d, "view_item", "m") for d in range(6) if d != 1],
        # Only this device has the refreshed day, and none other.
        ("z", 4 * DAY, 1, "session_start", "m"),
        (None, DAY - 100, 1, "view_item", "m"), (None, 3 * DAY, 2, "view_item", "p"),
        # No time: first of all, whatever their day.
        ("untimed", None, 1, "view_item", "m", "20240101"), ("untimed", 2 * DAY, 2, "view_item", "m"),
        # Equal in all of the order.
        *[("ties", 3 * DAY, 7, "view_item", "m")] * 3,
    ]
    before = [("agrees", DAY + 7200, 1, "view_item", "m"), (None, DAY + 100, 4, "purchase", "m"), ("gone", DAY, 1, "view_item", "m"), ("ties", DAY, 1, "view_item", "m")]
    after = [
        *bridge, ("late", 5 * HOUR, 9, "begin_checkout", "late", "20240102"), ("agrees", DAY + 9000, 1, "purchase", "m"), (None, DAY + 1000, 5, "purchase", "q"),
        ("new", DAY, 1, "view_item", "new"), ("untimed", None, 3, "purchase", "o", "20240102"), ("ties", 3 * DAY - 60, 1, "view_item", "m", "20240102"),
    ]
    return stays + before, stays + after


def test_cases_around_a_refreshed_day(spark):
    """There and back: the tables are a full build's both times."""
    before, after = (export(spark, rows) for rows in cases())
    full = {n: built(spark, raw) for n, raw in (("before", before), ("after", after))}
    store = built(spark, before)
    parts = store.manifest()["events_sessionised"]["parts"]
    refresh(store, between(after, "20240102", "20240102"), "20240102", "20240102", SETTINGS)
    assert_same(store, full["after"])
    sessions = store.read("fct_sessions").where("device_id = 'a'").orderBy("session_start").collect()
    assert [str(r.session_date) for r in sessions] == ["2024-01-01", "2024-01-06"]  # one over two midnights
    refresh(store, between(before, "20240102", "20240102"), "20240102", "20240102", SETTINGS)
    assert_same(store, full["before"])
    assert parts.keys() == store.manifest()["events_sessionised"]["parts"].keys()


def test_days_after_are_left_alone_where_numbers_agree(spark):
    rows = [("a", d * DAY + 7200, d, "view_item", "m") for d in range(8)] + [("b", d * DAY, d, "view_item", "m") for d in range(8)]
    changed = [r if r[:2] != ("a", 3 * DAY + 7200) else ("a", 3 * DAY + 9000, 3, "purchase", "m") for r in rows]
    store = built(spark, export(spark, rows))
    before = store.manifest()["events_sessionised"]["parts"]
    refresh(store, between(export(spark, changed), "20240104", "20240104"), "20240104", "20240104", SETTINGS)
    after = store.manifest()["events_sessionised"]["parts"]
    # The event after it tells another distance in minutes.
    assert {d for d in before if before[d] != after[d]} == {"2024-01-04", "2024-01-05"}
    again = store.manifest()
    refresh(store, between(export(spark, changed), "20240102", "20240103"), "20240102", "20240103", SETTINGS)
    assert {t for t in again if again[t] != store.manifest()[t]} == {"stg_events"}  # the same events: nothing else is done


def random_rows(seed, n=700):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        device = rng.choice([None, "hot", "hot", *"abcdefg"])
        second = rng.choice([None, *[rng.randrange(10 * DAY)] * 30, *[600 * rng.randrange(1440)] * 30])
        late = ["202401%02d" % rng.randrange(1, 11)] if second is None or rng.random() < 0.01 else []
        out.append((device, second, i, rng.choice(NAMES), rng.choice("mno"), *late))
    return out


def dated(row):
    return row[5] if len(row) > 5 else (T0 + timedelta(seconds=row[1])).strftime("%Y%m%d")


@pytest.mark.parametrize("seed", [2])
def test_random_refreshes(spark, seed):
    rng = random.Random(seed)
    policy = HotKeys(min_rows=60, slice_rows=10, counted_one_in=1) if seed == 2 else HotKeys()
    rows = random_rows(seed)
    store = built(spark, export(spark, rows), policy)
    for start, end in (("20240104", "20240104"), ("20240101", "20240102"), ("20240109", "20240111")):
        rows = [r for r in rows if not (start <= dated(r) <= end and rng.random() < 0.3)]
        more = [(f"new{rng.randrange(3)}", s, s, "view_item", "p") for s in range(0, 10 * DAY, 7 * HOUR)]
        rows += [r for r in more + random_rows(seed + 50, 60) if start <= dated(r) <= end]
        refresh(store, between(export(spark, rows), start, end), start, end, SETTINGS, policy)
    assert_same(store, built(spark, export(spark, rows), policy))


# --- versions -----------------------------------------------------------------------------------


def test_a_change_that_dies_leaves_the_tables(spark):
    store = TableStore(spark, work_folder(spark, "store"))
    rows = spark.range(10).selectExpr("id", "id % 2 AS day")
    change = store.change()
    change.write("t", rows, "day")
    change.commit()
    fails = rows.selectExpr("if(id = 9, raise_error('lost'), id) AS id", "day")
    dying = store.change()
    with pytest.raises(Exception, match="lost"):
        dying.write("t", fails, "day", replace=[0, 1])
    assert sorted(store.read("t").collect()) == sorted(rows.collect())
    half = store.change()
    half.write("t", rows.where("day = 0").selectExpr("id + 100 AS id", "day"), "day", replace=[0])
    assert store.read("t").agg(F.max("id")).first()[0] == 9  # written, not committed
    reader = store.read("t")
    half.commit()
    assert reader.agg(F.max("id")).first()[0] == 9
    assert sorted(r.id for r in store.read("t").collect()) == [1, 3, 5, 7, 9, 100, 102, 104, 106, 108]
    assert sorted(store.read("t", 1).collect()) == sorted(rows.collect())


def test_the_second_of_two_changes_is_refused(spark):
    store = TableStore(spark, work_folder(spark, "store"))
    one, two = store.change(), store.change()
    for c, n in ((one, 1), (two, 2)):
        c.write("t", spark.range(n))
    one.commit()
    with pytest.raises(ChangeLost):
        two.commit()
    assert store.read("t").count() == 1 and store.versions() == [1]


def test_rows_that_fail_are_not_committed(spark):
    store = TableStore(spark, work_folder(spark, "store"))
    checks = [Check("t", "not_null", "a"), Check("t", "accepted_values", "b", values=(0, 1)), Check("t", "not_null", "b", severity="warn"), Check("u", "not_null", "zzz")]
    bad = spark.createDataFrame([(1, 0), (None, 1), (None, 5), (2, None)], "a int, b int")
    change = store.change()
    change.write("t", bad, checks=checks)
    assert change.failures == {"t": {"not_null(a)": 2, "accepted_values(b)": 1}}
    with pytest.raises(CheckFailed):
        change.commit()
    assert store.versions() == []
    good = store.change()
    good.write("t", bad.where("a IS NOT NULL"), checks=checks)
    assert good.commit() == 1


def test_vacuum_keeps_what_the_kept_versions_hold(spark):
    store = TableStore(spark, work_folder(spark, "store"))
    for n in range(4):
        change = store.change()
        change.write("t", spark.range(n + 1).selectExpr("id", f"{n % 2} AS day"), "day", replace=[n % 2])
        change.commit()
    orphan = store.change()
    orphan.write("t", spark.range(5).selectExpr("id", "0 AS day"), "day", replace=[0])
    assert len(store.listed(f"{store.root}/data/t")) == 5
    store.vacuum(keep=1)
    assert store.versions() == [4] and len(store.listed(f"{store.root}/data/t")) == 2
    assert store.read("t").count() == 3 + 4


def test_rows_must_lie_in_the_partitions_replaced(spark):
    store = TableStore(spark, work_folder(spark, "store"))
    change = store.change()
    change.write("t", spark.range(4).selectExpr("id", "id % 2 AS day"), "day")
    with pytest.raises(ValueError, match="outside"):
        change.write("t", spark.range(4).selectExpr("id", "id % 2 AS day"), "day", replace=[0])
    with pytest.raises(ValueError, match="another type"):
        change.write("t", spark.range(4).selectExpr("cast(id AS string) AS id", "0L AS day"), "day", replace=[0])
    change.write("t", spark.range(0).selectExpr("id", "0L AS day"), "day", replace=[0])
    assert sorted(r.id for r in change.read("t").collect()) == [1, 3]
