"""Running windows per key that stay parallel when one key holds much of the data.

A window partition is handled by one task, and a running number cannot be salted. So keys with
very many rows are cut into slices of a counted number of rows in their order; the window runs per
(key, slice), and a summary of one row per slice carries the state from slice to slice. Keys below
the limit are not cut and carry nothing. Where no key is hot, the plan holds none of this. Rows without a key are a key of their own, rows without a time come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.sources.tables import overwrite_table, work_folder

SLICE = "_slice"
#: Rows of hot keys are counted per stretch of time, first long ones, then within those that hold too many.
GRAINS = (10**12, 10**9, 10**6, 10**3, 1)
#: At one instant texts go on parting them, by so many first characters, then as a whole.
PREFIXES = (2, 4, 8)


@dataclass(frozen=True)
class HotKeys:
    """When a key is cut, and how finely.

    Every row is processed whichever keys are cut, so finding them may be approximate: rows are
    counted by one in ``counted_one_in``, decided by a hash of their place in the order. There are
    at most rows / min_rows hot keys. A slice holds ``slice_rows`` rows and at most as many again:
    a stretch of time of a key isn't split unless it holds more, and in the end between its
    different places. Nor does a window over counts hold more than that, see slice_cells.
    """

    min_rows: int = 1_000_000
    slice_rows: int = 20_000
    counted_one_in: int = 64


def hot_keys(df: DataFrame, key: str, order: Sequence[str], policy: HotKeys) -> DataFrame:
    """The keys (_hot_key, NULL included) with about ``min_rows`` rows or more.

    Which rows are counted follows from their place alone, so that every evaluation, also after a
    lost executor, lists the same keys.
    """
    counted = F.pmod(F.xxhash64(*order), F.lit(policy.counted_one_in)) == 0
    return (
        (df.where(counted) if policy.counted_one_in > 1 else df)
        .groupBy(F.col(key).alias("_hot_key"))
        .agg((F.count(F.lit(1)) * policy.counted_one_in).alias("_rows"))
        .where(F.col("_rows") >= policy.min_rows)
        .select("_hot_key")
    )


def _same(pairs: dict[str, str]) -> Column:
    """Equality that lets NULL equal NULL; still a key that Spark can hash or sort by."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()])


def _grains(df: DataFrame, order: Sequence[str]):
    """Finer and finer parts of the order, each a list of columns that parts the cells before it."""
    micros = f"unix_micros({order[0]})"
    for size in GRAINS:
        yield [F.expr(f"{micros} - pmod({micros}, {size})")]
    for name in order[1:]:
        if dict(df.dtypes)[name] == "string":
            yield from ([F.substring(name, 1, n)] for n in PREFIXES)
        yield [F.col(name)]


def slice_cells(df: DataFrame, key: str, order: Sequence[str], policy: HotKeys, hot: DataFrame) -> list[tuple[list[Column], DataFrame]]:
    """Counts of the hot keys' rows, from coarse to fine, as places to cut at: (grain, cells) per level.

    A cell (_cell_key, _parent, _cell_0, ...) begins after ``_start`` rows of its key: those before
    its parent, known from the level above, and those of its parent's cells before it. So a window
    holds the cells of one parent only, up to a thousand stretches of time, and only cells of more
    than ``slice_rows`` rows are parted further, by what the order compares next. Where all of
    those are small enough, their single places are the last level. A cell's ``_start`` is its
    name: no two cells of a key and level begin at the same row.
    """
    rows = df.select(key, *order).join(hot, _same({key: "_hot_key"}), "left_semi").withColumn("_parent", F.lit(0).cast("bigint"))
    grains, levels, grain = _grains(df, order), [], None
    while grain := next(grains, None):
        if levels and most <= 2 * policy.slice_rows:
            grain, grains = [F.col(c) for c in order], iter(())
        cells = [f"_cell_{n}" for n in range(len(grain))]
        counts = rows.select(key, "_parent", *[g.alias(c) for g, c in zip(grain, cells)]).groupBy(key, "_parent", *cells).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(key, "_parent").orderBy(*cells).rowsBetween(Window.unboundedPreceding, 0)
        start = F.col("_parent") + F.sum("_n").over(before) - F.col("_n")
        counted = counts.select(F.col(key).alias("_cell_key"), F.col("_parent").alias("_cell_parent"), *cells, "_n", start.alias("_start"))
        level = overwrite_table(counted, work_folder(df.sparkSession, "cells"))
        levels.append((grain, level))
        full = level.where(F.col("_n") > policy.slice_rows)
        most = full.agg(F.max("_n")).first()[0]
        if most is None:
            break
        rows = _in_cells(rows, key, grain, full).select(key, *order, F.col("_start").alias("_parent"))
    return levels


def _in_cells(rows: DataFrame, key: str, grain: list[Column], cells: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the cell of their key and parent that they lie in."""
    same = F.col(key).eqNullSafe(F.col("_cell_key")) & (F.col("_parent") == F.col("_cell_parent"))
    for n, _ in enumerate(grain):
        same &= F.col(f"_grain_{n}").eqNullSafe(F.col(f"_cell_{n}"))
    return rows.select("*", *[g.alias(f"_grain_{n}") for n, g in enumerate(grain)]).join(cells, same, how)


def with_slices(df: DataFrame, key: str, order: Sequence[str], policy: HotKeys) -> DataFrame:
    """Add ``_slice``: the slice of a hot key's row, rising in its order, NULL for every other key.

    ``order`` begins with the time; rows with equal values of all of it stay together. Whether
    any key is hot, and how finely their rows must be counted, is looked up at once, since the
    plan is far smaller where none is.
    """
    hot = hot_keys(df, key, order, policy)
    if hot.isEmpty():
        return df.withColumn(SLICE, F.lit(None).cast("bigint"))
    placed = df.withColumn("_parent", F.lit(0).cast("bigint"))
    for n, (grain, cells) in enumerate(slice_cells(df, key, order, policy, hot)):
        found = _in_cells(placed, key, grain, cells, "left")
        # Rows of other keys have no place from the first level on; settled ones keep theirs.
        at = F.coalesce("_start", "_parent") if n else F.col("_start")
        placed = found.select(*df.columns, at.alias("_parent"))
    return placed.select(*df.columns, F.floor(F.col("_parent") / policy.slice_rows).alias(SLICE))


def slice_window(key: str, order: Sequence[str | Column]):
    return Window.partitionBy(key, SLICE).orderBy(*order)


def across_slices(key: str):
    return Window.partitionBy(key).orderBy(SLICE)


def _carried_by(key: str) -> list[Column]:
    return [F.col(key).alias("_of_key"), F.col(SLICE).alias("_of_slice")]


def join_carry(df: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """Rows with what their slice has from the slices before; rows without a slice have nothing."""
    same = F.col(key).eqNullSafe(F.col("_of_key")) & (F.col(SLICE) == F.col("_of_slice"))
    return df.join(carry, same, "left")


def _mark(df, key, order, value, starts_run) -> DataFrame:
    """Starts within a slice. The slice's first row is decided by the slice before, so counts 0."""
    w = slice_window(key, order)
    return (
        df.withColumn("_nth", F.row_number().over(w))
        .withColumn("_before", F.lag(value).over(w))
        .withColumn(
            "_starts",
            F.when(F.col("_nth") == 1, 0)
            .when(starts_run(F.col(value), F.col("_before")), 1)
            .otherwise(0),
        )
    )


def number_runs(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    starts_run: Callable[[Column, Column], Column],
    *,
    previous: str,
    flag: str,
    number: str,
    policy: HotKeys = HotKeys(),
    keep_slice: bool = False,
) -> DataFrame:
    """Split each key's rows, in order, into runs and number them from 1.

    ``starts_run(current, previous)`` says whether a row opens a run; a key's first row always
    does. Adds ``previous`` (the value one row before), ``flag`` (1 on a run's first row) and
    ``number``. One exchange and one sort of the rows; the time column leads ``order``.
    """
    sliced = with_slices(df, key, order, policy)
    w = slice_window(key, order)
    local = _mark(sliced, key, order, value, starts_run).withColumn(
        "_local", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )

    place = F.struct(*order)
    across = across_slices(key)
    hot_rows = sliced.where(F.col(SLICE).isNotNull()).select(key, SLICE, *{*order, value} - {key})
    carry = (
        _mark(hot_rows, key, order, value, starts_run)
        .groupBy(key, SLICE)
        .agg(
            F.sum("_starts").alias("_inner"),
            F.min_by(value, place).alias("_first"),
            F.max_by(value, place).alias("_last"),
        )
        .withColumn("_carried", F.lag("_last").over(across))
        .withColumn(
            "_opens",
            F.when(F.row_number().over(across) == 1, 1)
            .when(starts_run(F.col("_first"), F.col("_carried")), 1)
            .otherwise(0),
        )
        .withColumn(
            "_base",
            F.sum(F.col("_inner") + F.col("_opens")).over(
                across.rowsBetween(Window.unboundedPreceding, 0)
            )
            - F.col("_inner"),
        )
        .select(*_carried_by(key), "_carried", "_opens", "_base")
    )

    first = F.col("_nth") == 1
    kept = [c for c in df.columns] + ([SLICE] if keep_slice else [])
    return join_carry(local, carry, key).select(
        *kept,
        F.when(first, F.col("_carried")).otherwise(F.col("_before")).alias(previous),
        F.when(first, F.coalesce("_opens", F.lit(1))).otherwise(F.col("_starts")).alias(flag),
        (F.coalesce("_base", F.lit(1)) + F.col("_local")).alias(number),
    )


def next_value(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` (never NULL) of the key's next row by ``order``.

    Expects the ``_slice`` column of number_runs and drops it; ``order`` and ``value`` must rise
    together with the slices.
    """
    following = df.where(F.col(SLICE).isNotNull()).groupBy(key, SLICE).agg(
        F.min(value).alias("_head")
    )
    carry = following.select(
        *_carried_by(key), F.lead("_head").over(across_slices(key)).alias("_next_head")
    )
    numbered = df.withColumn("_next", F.lead(value).over(slice_window(key, [order])))
    return join_carry(numbered, carry, key).select(
        *[c for c in df.columns if c != SLICE],
        F.coalesce("_next", "_next_head").alias(name),
    )
