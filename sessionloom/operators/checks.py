"""Data-quality checks. Each returns the failing rows; a suite counts them check by check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.config import FUNNEL_EVENTS, SEGMENT_TYPES


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is NULL."""
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, columns: str | Sequence[str], where: str | None = None) -> DataFrame:
    """Values (or combinations) held by more than one row, with their count.

    A single column ignores NULL; a combination compares NULL like a value.
    """
    single = isinstance(columns, str)
    names = [columns] if single else list(columns)
    rows = df.where(F.expr(where)) if where else df
    if single:
        rows = rows.where(F.col(columns).isNotNull())
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their count; NULL passes."""
    return (
        df.where(~F.col(column).isin(list(values)))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def relationships(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Child keys missing in the parent, with their row count; NULL passes.

    Counted per key before the anti join, so a key of any weight is one row.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("orphan"))
    parents = parent.select(F.col(parent_column).alias("orphan"))
    return keys.agg(F.count(F.lit(1)).alias("n_rows")).join(parents, "orphan", "left_anti")


@dataclass(frozen=True)
class Check:
    """One declared check on a table. ``kind`` is the function above that it stands for."""

    table: str
    kind: str
    column: str
    values: tuple = ()
    parent: str = ""
    parent_column: str = ""
    where: str | None = None
    severity: str = "error"
    columns: tuple = field(default=())

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column or ', '.join(self.columns)})"


def failing_rows(check: Check) -> Column:
    """Row-level checks as an additive count, so that a table's all run in one scan."""
    col = F.col(check.column)
    bad = col.isNull() if check.kind == "not_null" else ~col.isin(list(check.values))
    return F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("failures"))


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check with its number of failures: rows, duplicate values or orphan keys.

    Pass stored tables: every table is read once for its row-level checks and once more per
    uniqueness or relationship check.
    """
    outcomes = []

    def labelled(check: Check, counted: DataFrame) -> DataFrame:
        return counted.select(
            F.lit(check.table).alias("table_name"),
            F.lit(check.name).alias("check_name"),
            F.lit(check.severity).alias("severity"),
            F.col("failures"),
        )

    for table in dict.fromkeys(c.table for c in checks):
        df = tables[table]
        mine = [c for c in checks if c.table == table]
        row_level = [c for c in mine if c.kind in ("not_null", "accepted_values")]
        if row_level:
            counted = F.array(
                *[
                    F.struct(
                        F.lit(c.name).alias("check_name"),
                        F.lit(c.severity).alias("severity"),
                        F.col(f"f{n}").alias("failures"),
                    )
                    for n, c in enumerate(row_level)
                ]
            )
            outcomes.append(
                df.agg(*[failing_rows(c).alias(f"f{n}") for n, c in enumerate(row_level)])
                .select(F.explode(counted).alias("c"))
                .select(F.lit(table).alias("table_name"), "c.*")
            )
        for c in mine:
            if c.kind == "unique":
                failing = unique(df, c.columns or c.column, c.where)
            elif c.kind == "relationships":
                failing = relationships(df, c.column, tables[c.parent], c.parent_column)
            else:
                continue
            outcomes.append(labelled(c, _count(failing)))
    return reduce(DataFrame.unionByName, outcomes)


def _many(kind: str, table: str, columns: str, **more) -> list[Check]:
    return [Check(table, kind, c, **more) for c in columns.split()]


def _fk(table: str, column: str, parent: str, parent_column: str) -> Check:
    return Check(table, "relationships", column, parent=parent, parent_column=parent_column)


def _flags(table: str) -> list[Check]:
    return [
        Check(table, "accepted_values", f"reached_{step}", values=(0, 1)) for step in FUNNEL_EVENTS
    ]


DEVICE_CATEGORIES = ("desktop", "mobile", "tablet")
CURRENT = "is_current = 1"


def _versions(table: str) -> list[Check]:
    return [
        Check(table, "unique", "attribution_version_key"),
        *_many("not_null", table, "attribution_version_key device_id"),
        Check(table, "unique", "device_id", where=CURRENT),
        _fk(table, "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
        Check(table, "accepted_values", "is_current", values=(0, 1)),
    ]


# What every build is checked for.
BUILD_CHECKS: list[Check] = [
    *_many("not_null", "stg_events", "event_date time_stamp event_name device_id session_id"),
    Check("stg_events", "accepted_values", "device", values=DEVICE_CATEGORIES),
    *_many(
        "not_null", "events_sessionised", "session_key device_id session_num is_new_session"
    ),
    Check("events_sessionised", "accepted_values", "is_new_session", values=(0, 1)),
    Check("session_funnel_steps", "unique", "session_key"),
    *_many("not_null", "session_funnel_steps", "session_key device_id session_num"),
    *_flags("session_funnel_steps"),
    Check("fct_sessions", "unique", "session_id"),
    *_many("not_null", "fct_sessions", "session_id ga_session_id device_id traffic_source_key"),
    _fk("fct_sessions", "session_date", "dim_date", "date_day"),
    _fk("fct_sessions", "device_id", "dim_devices", "device_id"),
    _fk("fct_sessions", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    *_flags("fct_sessions"),
    Check("fct_events", "unique", "event_id"),
    *_many(
        "not_null", "fct_events", "event_id session_id device_id traffic_source_key event_date"
    ),
    _fk("fct_events", "session_id", "fct_sessions", "session_id"),
    _fk("fct_events", "device_id", "dim_devices", "device_id"),
    _fk("fct_events", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    _fk("fct_events", "event_date", "dim_date", "date_day"),
    Check("fct_event_items", "unique", "event_item_id"),
    *_many("not_null", "fct_event_items", "event_item_id event_id item_index"),
    _fk("fct_event_items", "event_id", "fct_events", "event_id"),
    _fk("fct_event_items", "event_date", "dim_date", "date_day"),
    Check("dim_devices", "unique", "device_id"),
    *_many("not_null", "dim_devices", "device_id"),
    Check("dim_devices", "accepted_values", "device", values=DEVICE_CATEGORIES),
    Check("dim_traffic_source", "unique", "traffic_source_key"),
    *_many("not_null", "dim_traffic_source", "traffic_source_key"),
    Check("dim_date", "unique", "date_day"),
    *_many("not_null", "dim_date", "date_day"),
    *_versions("attribution_history"),
    *_many("not_null", "attribution_history", "valid_from"),
    Check("rpt_funnel", "unique", "", columns=("segment_type", "segment_value", "step")),
    *_many("not_null", "rpt_funnel", "segment_type"),
    Check("rpt_funnel", "accepted_values", "segment_type", values=tuple(SEGMENT_TYPES)),
    Check("rpt_funnel_weekly", "unique", "week_start"),
    *_many("not_null", "rpt_funnel_weekly", "week_start"),
    Check("rpt_product_funnel", "unique", "item_category"),
    *_many("not_null", "rpt_product_funnel", "item_category"),
]

# Checks of the run-time history.
SNAPSHOT_CHECKS: list[Check] = [
    Check("current_attribution", "unique", "device_id"),
    *_many("not_null", "current_attribution", "device_id traffic_source_key"),
    _fk("current_attribution", "traffic_source_key", "dim_traffic_source", "traffic_source_key"),
    Check("attribution_snapshot", "unique", "attribution_version_key"),
    *_many("not_null", "attribution_snapshot", "attribution_version_key device_id"),
    *_versions("dim_attribution"),
]


@dataclass(frozen=True)
class Figure:
    """An expected headline figure: ``value`` of the one row of ``table`` that ``row`` picks."""

    name: str
    table: str
    row: str
    value: str
    expected: float
    tolerance: float


def figures(tables: Mapping[str, DataFrame], wanted: Sequence[Figure]) -> DataFrame:
    """Actual, expected and tolerance of every figure; all figures of a table from one pass."""

    def of_table(name: str) -> DataFrame:
        mine = [f for f in wanted if f.table == name]
        values = {f"_value{n}": F.expr(f.value).cast("double") for n, f in enumerate(mine)}
        entries = [
            F.when(
                F.expr(f.row),
                F.struct(
                    F.lit(f.name).alias("check_name"),
                    F.col(value).alias("actual"),
                    F.lit(float(f.expected)).alias("expected"),
                    F.lit(float(f.tolerance)).alias("tolerance"),
                ),
            )
            for f, value in zip(mine, values)
        ]
        # Values first: a value may look at all rows (a share of a total), not only its own.
        return (
            tables[name]
            .withColumns(values)
            .select(F.explode(F.array(*entries)).alias("f"))
            .where(F.col("f").isNotNull())
            .select("f.*")
        )

    names = dict.fromkeys(f.table for f in wanted)
    return reduce(DataFrame.unionByName, [of_table(n) for n in names])


def drifted(checked: DataFrame) -> DataFrame:
    """Figures outside their tolerance. A warning: a refresh makes the texts stale, not wrong."""
    off = F.abs(F.col("actual") - F.col("expected")) > F.col("tolerance")
    return checked.where(off).withColumn("severity", F.lit("warn"))


def reconcile(
    fact: DataFrame, rollup: DataFrame, totals: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Totals of a fact against those of its rollup: name -> (fact, rollup) aggregate expression.

    Sums of doubles depend on the order of addition, so totals may differ by a billionth of
    their size (and, near zero, by a billionth).
    """

    def side(df: DataFrame, which: int, name: str) -> DataFrame:
        stacked = F.array(
            *[
                F.struct(F.lit(k).alias("measure"), F.col(k).cast("double").alias(name))
                for k in totals
            ]
        )
        sums = df.agg(*[F.expr(v[which]).alias(k) for k, v in totals.items()])
        return sums.select(F.explode(stacked).alias("t")).select("t.*")

    both = side(fact, 0, "fact_total").join(side(rollup, 1, "rollup_total"), "measure")
    size = F.greatest(F.abs("fact_total"), F.abs("rollup_total"), F.lit(1.0))
    return both.withColumn(
        "reconciles", F.abs(F.col("fact_total") - F.col("rollup_total")) <= 1e-9 * size
    )
