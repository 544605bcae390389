"""Derived inputs for the prep and quality operators.

The driver's tables hold no wide exports, so the adapter output is pivoted
back into wide form (one column per week, max value per cell), and dirty
variants are derived deterministically for the quality checks. All of it is
computed by Spark from the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.model import METRICS_LONG_COLUMNS
from zonepulse.sources.adapter import zone_tables

WEEKS = list(range(8, -1, -1))


def wide_metrics(metrics_long: DataFrame) -> DataFrame:
    """Wide metrics export with messy headers: preferred ``L<n>W_ROLL``
    doubles and an ignored raw ``L<n>W`` set carried as text."""
    keys = ["country", "city", "zone", "zone_type", "zone_prioritization", "metric"]
    wide = metrics_long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("week") == w, F.col("value"))).alias(f"r{w}") for w in WEEKS]
    )
    return wide.select(
        F.col("country").alias(" Country "),
        F.col("city").alias("CITY"),
        F.col("zone").alias("Zone"),
        F.col("zone_type").alias("ZONE TYPE"),
        F.col("zone_prioritization").alias("Zone-Prioritization"),
        F.concat(F.lit(" "), F.col("metric"), F.lit("\t")).alias("METRIC"),
        *[F.col(f"r{w}").alias(f"L{w}W_ROLL") for w in WEEKS],
        *[(F.col(f"r{w}") * 10).cast(T.StringType()).alias(f"L{w}W") for w in WEEKS],
    )


def wide_orders(orders_long: DataFrame) -> DataFrame:
    """Wide orders export without a METRIC column; week cells as text."""
    wide = orders_long.groupBy("country", "city", "zone").agg(
        *[F.max(F.when(F.col("week") == w, F.col("value"))).alias(f"r{w}") for w in WEEKS]
    )
    return wide.select(
        F.col("country").alias("COUNTRY"),
        F.col("city").alias("City"),
        F.col("zone").alias("ZONE"),
        *[F.col(f"r{w}").cast(T.StringType()).alias(f"L{w}W") for w in WEEKS],
    )


def dirty_tables(spark: SparkSession, sf_dir: str, materialize: bool = True):
    """(metrics, orders) with planted defects:

    * zone_type null for HOUSEHOLD zones in week 3 (geography conflict)
    * ASIA week-4 rows duplicated (duplicate grain)
    * NATION_0 weeks shifted by +9, labels too (range and label checks)
    * NATION_1 values null (null check)
    * NATION_2 week-0 Orders rows copied into metrics (metric inventory)
    * NATION_3 orders copied under an unknown zone (unmatched enrichment)
    """
    m, o = zone_tables(spark, sf_dir, materialize=materialize)
    shifted = F.when(F.col("city") == "NATION_0", F.col("week") + 9).otherwise(F.col("week"))
    m1 = m.select(
        "country", "city", "zone",
        F.when(F.col("zone").endswith("HOUSEHOLD") & (F.col("week") == 3), F.lit(None).cast(T.StringType()))
        .otherwise(F.col("zone_type")).alias("zone_type"),
        "zone_prioritization", "metric",
        shifted.alias("week"),
        F.concat(F.lit("l"), shifted.cast("string"), F.lit("w")).alias("week_label"),
        F.when(F.col("city") == "NATION_1", F.lit(None).cast(T.DoubleType())).otherwise(F.col("value")).alias("value"),
    )
    dups = m1.filter((F.col("week") == 4) & (F.col("country") == "ASIA"))
    orders_in_metrics = o.filter((F.col("city") == "NATION_2") & (F.col("week") == 0)).select(
        "country", "city", "zone", F.lit(None).cast(T.StringType()).alias("zone_type"),
        F.lit(None).cast(T.StringType()).alias("zone_prioritization"), "metric", "week", "week_label", "value",
    )
    metrics = m1.unionByName(dups).unionByName(orders_in_metrics).select(*METRICS_LONG_COLUMNS)
    stray = o.filter(F.col("city") == "NATION_3").withColumn("zone", F.concat(F.col("zone"), F.lit("_X")))
    orders = o.unionByName(stray)
    return metrics, orders


def _at(insights: DataFrame, place: int, digits: str):
    return F.substring("insight_id", place, 1).isin(*digits)


def noisy_insights(insights: DataFrame) -> DataFrame:
    """Findings altered by the first digit of their id, an arm of the noise
    filter for each of 0-9: blank title, no metric, empty summary, unknown
    category, low confidence, tiny baseline and change, huge ratio on a small
    change, hardly any change, small sign flip, tiny baseline from the week
    before. The others stay as they are."""
    null = F.lit(None)
    arm = lambda digit, value, column: F.when(_at(insights, 1, digit), value).otherwise(F.col(column))
    first = F.substring("insight_id", 1, 1)
    change = F.when(first.isin("5", "9"), 0.03).when(first.isin("6", "8"), 0.15).when(first == "7", 0.005)
    return insights.withColumns({
        "title": arm("0", F.lit("  "), "title"),
        "metric": arm("1", null, "metric"),
        "summary": arm("2", F.lit(""), "summary"),
        "category": arm("3", F.lit("other"), "category"),
        "confidence": arm("4", F.lit("LOW"), "confidence"),
        "baseline_abs": F.when(first == "5", 0.01).when(first == "9", null).otherwise(F.col("baseline_abs")),
        "week_1_value": arm("9", F.lit(0.02), "week_1_value"),
        "pct_change": arm("6", F.lit(9.0), "pct_change"),
        "abs_delta": F.coalesce(change, F.col("abs_delta")),
        "sign_flip": F.when(first == "8", True).when(first == "6", False).otherwise(F.col("sign_flip")),
    })


def copied_insights(insights: DataFrame) -> DataFrame:
    """Findings with copies by the second digit of their id: 0-3 the same
    metric written otherwise, 4-7 the same summary written otherwise (and
    ranked before the original), 8-9 neither the same."""
    def copy(digits: str, mark: str, metric, summary, more: float) -> DataFrame:
        return insights.filter(_at(insights, 2, digits)).withColumns({
            "insight_id": F.concat("insight_id", F.lit(mark)), "metric": metric, "summary": summary,
            "severity_score": F.col("severity_score") + more,
        })

    metric, summary = F.col("metric"), F.col("summary")
    doubled = F.upper(F.regexp_replace(summary, " ", "  "))
    return (
        insights
        .unionByName(copy("0123", "-a", F.concat(F.lit("  "), F.upper(metric), F.lit(" ")), F.concat(summary, F.lit(" Again.")), -1.0))
        .unionByName(copy("4567", "-b", F.concat(F.lit("Other "), metric), doubled, 1.0))
        .unionByName(copy("89", "-c", F.concat(F.lit("Third "), metric), F.concat(summary, F.lit(" Third.")), -1.0))
    )
