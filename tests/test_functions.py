"""Column functions on literal rows."""

import math
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.functions import (
    calendar_columns,
    clean_item_string,
    clean_string,
    event_param,
    newcombe,
    rate,
    surrogate_key,
    week_label,
    week_start,
    wilson,
)
from sessionloom.sources.export import EXPORT_SCHEMA


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.orderBy("n").select(f(F.col("v")).alias("out")).collect()]


def test_clean_string(spark):
    cases = {
        "(not set)": None,
        "(Data Deleted)": None,
        "(none)": "direct",
        "(None)": "direct",
        "(direct)": "direct",
        "<Other>": "other",
        "(a>": "a",
        "()": "",
        "(": "(",
        "a (b)": "a (b)",
        "(a) b": "(a) b",
        "(z)\n": "(z)\n",
        "(a\nb)": "(a\nb)",
        "(a\rb)": "a\rb",
        "((x))": "(x)",
        "Not Set": "not set",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), clean_string) == list(cases.values())


def test_clean_item_string(spark):
    values = ["", "Not available in demo dataset", "(not set)", "()", "Blue", None]
    assert column(spark, values, clean_item_string) == [None, None, None, None, "blue", None]


def params(spark, entries):
    value = lambda s=None, i=None, f=None, d=None: (s, i, f, d)
    rows = [([(k, value(**v)) for k, v in e] if e is not None else None,) for e in entries]
    kind = next(f for f in EXPORT_SCHEMA.split("event_params ")[1:])
    ddl = "event_params " + kind.split(",\n    device")[0]
    return spark.createDataFrame(rows, ddl)


def test_event_param(spark):
    df = params(
        spark,
        [
            [("id", {"i": 7}), ("title", {"s": "x"})],
            [("title", {"s": "x"})],
            [("id", {"s": "7"})],
            [],
            None,
            [("id", {"d": 1.5}), ("other", {"i": 1}), ("other", {"i": 2})],
        ],
    )
    got = df.select(event_param("id", "int"), event_param("id", "double")).collect()
    assert [tuple(r) for r in got] == [
        (7, None), (None, None), (None, None), (None, None), (None, None), (None, 1.5)
    ]
    with pytest.raises(ValueError):
        event_param("id", "text")


def test_event_param_repeated_key_fails(spark):
    df = params(spark, [[("id", {"i": 7}), ("id", {"i": 8})]])
    with pytest.raises(Exception, match="more than once"):
        df.select(event_param("id", "int")).collect()


def test_surrogate_key(spark):
    df = spark.createDataFrame([("x", None), ("x", "")], "a string, b string")
    null_part, empty_part = [r[0] for r in df.select(surrogate_key("a", "b")).collect()]
    assert null_part == "30489944057fd1254e27c84a44621ce2"
    assert empty_part != null_part


def intervals(spark, f, *rows):
    names = "k n k2 n2".split()[: len(rows[0])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    return [r[0] for r in df.select(f(*[F.col(c) for c in names])).collect()]


def test_wilson_known_figures(spark):
    row = (4843, 355592)
    assert intervals(spark, wilson, row)[0] == pytest.approx(0.0132438, abs=5e-8)
    upper = lambda k, n: wilson(k, n, "upper")
    assert intervals(spark, upper, row)[0] == pytest.approx(0.0140058, abs=5e-8)
    edge = [(0, 50), (50, 50), (0, 0), (3, None)]
    low, high = intervals(spark, wilson, *edge), intervals(spark, upper, *edge)
    assert low[0] == pytest.approx(0, abs=1e-12) and high[1] == pytest.approx(1, abs=1e-12)
    assert low[2:] == [None, None] and high[2:] == [None, None]
    with pytest.raises(ValueError):
        wilson(F.col("k"), F.col("n"), "middle")


def expected_wilson(k, n, sign, z=1.959964):
    p = k / n
    spread = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) + sign * spread) / (1 + z * z / n)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 500)), min_size=4, max_size=30))
def test_interval_properties(spark, pairs):
    rows = [(min(k, n), n, min(k2, n2), n2) for (k, n), (k2, n2) in zip(pairs, pairs[1:])]
    df = spark.createDataFrame(rows, "k bigint, n bigint, k2 bigint, n2 bigint")
    k, n, k2, n2 = (F.col(c) for c in ("k", "n", "k2", "n2"))
    got = df.select(
        "k", "n", "k2", "n2",
        wilson(k, n).alias("lo"), wilson(k, n, "upper").alias("hi"), rate(k, n).alias("p"),
        newcombe(k, n, k2, n2).alias("d_lo"), newcombe(k, n, k2, n2, "upper").alias("d_hi"),
        newcombe(k2, n2, k, n).alias("r_lo"), newcombe(k2, n2, k, n, "upper").alias("r_hi"),
    ).collect()
    for r in got:
        assert -1e-12 <= r.lo <= r.p + 1e-12 and r.p - 1e-12 <= r.hi <= 1 + 1e-12
        assert r.lo == pytest.approx(expected_wilson(r.k, r.n, -1), abs=1e-12)
        assert r.hi == pytest.approx(expected_wilson(r.k, r.n, 1), abs=1e-12)
        assert r.d_lo == pytest.approx(-r.r_hi, abs=1e-12)
        assert r.d_hi == pytest.approx(-r.r_lo, abs=1e-12)
        assert r.d_lo - 1e-12 <= r.p - r.k2 / r.n2 <= r.d_hi + 1e-12


def test_newcombe_without_rest(spark):
    assert intervals(spark, newcombe, (3, 10, 0, 0)) == [None]


def test_calendar(spark):
    df = spark.createDataFrame([(date(2020, 11, 1),), (date(2021, 1, 3),)], "d date")
    d = F.col("d")
    row, late = df.orderBy("d").select(
        *calendar_columns(d), week_start(d).alias("ws"), week_label(week_start(d)).alias("wl")
    ).collect()
    assert (row.iso_week, row.day_name, row.day_sort, row.is_weekend) == (44, "Sunday", 7, 1)
    assert (row.ws, row.wl) == (date(2020, 10, 26), "26 Oct")
    assert (row.year_month, row.month_name, row.month_sort, row.quarter) == (
        "2020-11", "November", 11, 4
    )
    assert late.iso_week == 53
