"""Figures read off the report tables: headline tiles, significance, labels, selections.

Everything here works on report rows, a few hundred at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def significance(lower: Column, upper: Column) -> Column:
    """'differs' where the interval excludes zero, else 'within_noise'; NULL without interval."""
    excludes = (lower > 0) | (upper < 0)
    return F.when(excludes, "differs").when(~excludes, "within_noise")


def gap_significance(funnel: DataFrame) -> DataFrame:
    """Each segment's gap to the rest, split into the two bars of the chart."""
    verdict = significance(F.col("gap_vs_rest_lower"), F.col("gap_vs_rest_upper"))
    return (
        funnel.where(F.col("segment_type") != "overall")
        .withColumn("verdict", verdict)
        .select(
            "segment_type",
            "segment_value",
            "step",
            "gap_vs_rest",
            "verdict",
            F.when(F.col("verdict") == "differs", F.col("gap_vs_rest")).alias("differs"),
            F.when(F.col("verdict") == "within_noise", F.col("gap_vs_rest")).alias("within_noise"),
        )
    )


def error_bars(report: DataFrame, *rates: str) -> DataFrame:
    """Add the distances from each rate to its bounds, as error bars want them."""
    added = {}
    for name in rates:
        stem = name.removesuffix("_rate")
        added[f"{stem}_err_minus"] = F.col(name) - F.col(f"{name}_lower")
        added[f"{stem}_err_plus"] = F.col(f"{name}_upper") - F.col(name)
    return report.withColumns(added)


def full_weeks(weekly: DataFrame) -> DataFrame:
    """The weekly trend without partial weeks."""
    return weekly.where(F.col("is_partial_week") == 0)


def peak_and_low(weekly: DataFrame) -> DataFrame:
    """The weeks with the highest and lowest conversion; the earlier week on ties."""
    r, w = F.col("session_conversion_rate"), F.col("week_start")
    week = F.struct("week_start", "week_label", "session_conversion_rate")
    days = F.datediff(w, F.lit("1970-01-01").cast("date"))
    ends = weekly.where(r.isNotNull()).agg(
        F.min_by(week, F.struct(-r, days)).alias("peak"),
        F.min_by(week, F.struct(r, days)).alias("low"),
    )
    both = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("week")) for k in ("peak", "low")]
    )
    return (
        ends.select(F.explode(both).alias("e"))
        .where(F.col("e.week").isNotNull())
        .select("e.kind", "e.week.*")
    )


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def headline_tiles(funnel: DataFrame) -> DataFrame:
    """Sessions, purchasing sessions, conversion rate and its interval as texts."""
    top = funnel.where((F.col("segment_type") == "overall") & (F.col("step") == "purchase"))
    tiles = {
        "sessions": F.col("segment_sessions").cast("string"),
        "purchasing sessions": F.col("sessions_reached").cast("string"),
        "session conversion rate": percent(F.col("reach_rate")),
        "95% CI": F.concat_ws(
            " - ", percent(F.col("reach_rate_lower")), percent(F.col("reach_rate_upper"))
        ),
    }
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("tile_sort"), F.lit(k).alias("tile"), v.alias("tile_text"))
            for n, (k, v) in enumerate(tiles.items(), start=1)
        ]
    )
    return top.select(F.explode(rows).alias("t")).select("t.*")


def thin_label(label: str, is_thin: str) -> Column:
    """The label, marked '(thin)' where the cell has too few sessions."""
    return F.when(F.col(is_thin) == 1, F.concat(F.col(label), F.lit(" (thin)"))).otherwise(
        F.col(label)
    )


def segments_at_step(funnel: DataFrame, step: str) -> DataFrame:
    """The segment table at one chosen step, in display order."""
    return (
        funnel.where((F.col("step") == step) & (F.col("segment_type") != "overall"))
        .select(
            "segment_type",
            "segment_type_sort",
            "segment_sort",
            thin_label("segment_value", "is_thin_segment").alias("segment_label"),
            "segment_sessions",
            "reach_rate",
            "reach_rate_lower",
            "reach_rate_upper",
            "gap_vs_rest",
            "gap_vs_rest_lower",
            "gap_vs_rest_upper",
            significance(F.col("gap_vs_rest_lower"), F.col("gap_vs_rest_upper")).alias("verdict"),
        )
        .orderBy("segment_type_sort", "segment_sort", "segment_label")
    )


def overall_steps(funnel: DataFrame) -> DataFrame:
    """The overall funnel in step order, with the bar label 'count (rate)'."""
    return (
        funnel.where(F.col("segment_type") == "overall")
        .select(
            "step_sort",
            "step",
            "sessions_reached",
            "reach_rate",
            "step_conversion",
            "step_conversion_lower",
            "step_conversion_upper",
            "skipped_prev_share",
            F.concat(
                F.col("sessions_reached").cast("string"),
                F.lit(" ("),
                percent(F.col("reach_rate"), 1),
                F.lit(")"),
            ).alias("bar_label"),
        )
        .orderBy("step_sort")
    )


def top_categories(products: DataFrame, highlight: str | None = None, n: int = 12) -> DataFrame:
    """The n most viewed categories with error bars; ``highlight`` (default: the first) gets its own
    bar column."""
    rate = F.col("view_to_purchase_rate")
    top = products.orderBy("category_sort", "item_category").limit(n)
    if highlight is None:
        first = F.min_by("item_category", "category_sort").over(Window.partitionBy())
        lit_up = F.col("item_category") == first
    else:
        lit_up = F.col("item_category") == highlight
    return top.withColumn("_on", lit_up).select(
        "category_sort",
        thin_label("item_category", "is_thin_cell").alias("category_label"),
        "sessions_viewed",
        F.when(F.col("_on"), rate).alias("highlight"),
        F.when(~F.col("_on"), rate).alias("others"),
        (rate - F.col("view_to_purchase_rate_lower")).alias("err_minus"),
        (F.col("view_to_purchase_rate_upper") - rate).alias("err_plus"),
    )


def revenue_share(products: DataFrame) -> DataFrame:
    """Each category's share of all item revenue."""
    revenue = F.col("item_revenue_in_usd")
    total = F.sum(revenue).over(Window.partitionBy())
    return products.select(
        "item_category", "item_revenue_in_usd", F.try_divide(revenue, total).alias("revenue_share")
    )
