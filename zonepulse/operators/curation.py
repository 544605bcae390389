"""Insight curation.

Findings are as many as the detectors make; no step numbers them all in one
task. Order is carried by columns (``rank_order``); windows run per
(category, zone), per zone or per category with a small k, which Spark cuts
down before the shuffle. The greedy de-duplication is a fold over the findings
of a (category, zone) group, a handful of rows (one zone's metrics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.functions.columns import round2, squeeze_lower, strip_ws
from zonepulse.model import CATEGORIES, CATEGORY_BONUS


def zone_key() -> Column:
    """country|city|zone lower-cased, or '' when the finding has no zone."""
    parts = [F.lower(strip_ws(F.coalesce(F.col(c), F.lit("")))) for c in ("country", "city", "zone")]
    return F.when(parts[2] != "", F.concat_ws("|", *parts)).otherwise(F.lit(""))


def _blank(c: str) -> Column:
    return squeeze_lower(c) == ""


def filter_noise(insights: DataFrame) -> DataFrame:
    """L1: drop findings missing title/metric/summary or of an unknown
    category, and noisy anomalies (low confidence, tiny baseline and change,
    huge ratio on a small change, near-zero change, small sign flips)."""
    valid = F.col("category").isin(*CATEGORIES) & ~_blank("title") & ~_blank("metric") & ~_blank("summary")
    is_anomaly = F.col("category") == "anomalies"
    prev = F.coalesce(F.col("week_1_value"), F.lit(0.0))
    cur = F.coalesce(F.col("week_0_value"), F.lit(0.0))
    baseline = F.abs(F.coalesce(F.col("baseline_abs"), F.abs(prev)))
    change_pct = F.abs(F.coalesce(F.col("pct_change"), F.lit(0.0)))
    change = F.abs(F.coalesce(F.col("abs_delta"), cur - prev))
    flip = F.coalesce(F.col("sign_flip"), F.lit(False))
    noisy = (
        (F.lower(F.coalesce(F.col("confidence"), F.lit(""))) == "low")
        | ((baseline < 0.05) & (change < 0.05))
        | ((change_pct > 5.0) & (change < 0.2))
        | (change < 0.01)
        | (flip & (change < 0.2))
    )
    return insights.filter(valid & ~(is_anomaly & noisy))


def with_priority(insights: DataFrame) -> DataFrame:
    """L2: severity·0.75 + category bonus + breadth (1..12) + 3 with a hint."""
    bonus = F.lit(0.0)
    for cat in CATEGORIES:
        bonus = F.when(F.col("category") == cat, F.lit(CATEGORY_BONUS[cat])).otherwise(bonus)
    breadth = F.least(F.lit(12.0), F.greatest(F.lit(1.0), F.coalesce(F.col("affected_zones_count").cast("double"), F.lit(1.0))))
    action = F.when(_blank("recommendation_hint"), 0.0).otherwise(3.0)
    score = F.coalesce(F.col("severity_score"), F.lit(0.0)) * 0.75 + bonus + breadth + action
    return insights.withColumn("priority_score", round2(score))


#: L3: priority and severity downwards, then detector and emission order ("-": downwards). Unique together.
_RANK = ("-priority_score", "-severity_score", "detector_ord", "-emit_a", "-emit_b",
         "emit_rule", "country", "city", "zone", "emit_pair", "metric", "emit_type")


def rank_order() -> list[Column]:
    """L3 as sort columns; nulls come last."""
    return [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in _RANK]


def _ascending(name: str) -> Column:
    """A struct that sorts upwards as ``rank_order`` sorts by one column."""
    column = F.col(name.lstrip("-"))
    value = -column if name[0] == "-" else column
    return F.struct(value.isNull().alias("n"), value.alias("v")).alias(name.lstrip("-"))


def deduplicate(scored: DataFrame) -> DataFrame:
    """L4: greedy de-duplication within (category, zone) by metric and whole
    normalised summary; zone-less findings are never dropped. Exact for any
    input (not only detector output). ``scored`` has the priority (L2).

    Of findings with the same metric and summary only the first can stay, so
    each group is brought down to its different pairs before the shuffle. A
    fold over them in rank order, with the metrics and summaries seen as its
    state, tells which stay.
    """
    keyed = scored.withColumn("zone_key", zone_key())
    place = F.struct(*[_ascending(c) for c in _RANK])
    pairs = keyed.filter(F.col("zone_key") != "").select(
        "insight_id", "category", "zone_key", place.alias("place"),
        squeeze_lower("metric").alias("metric_key"), squeeze_lower("summary").alias("summary_key"),
    )
    first = pairs.groupBy("category", "zone_key", "metric_key", "summary_key").agg(F.min(F.struct("place", "insight_id")).alias("f"))
    groups = first.groupBy("category", "zone_key").agg(
        F.array_sort(F.collect_list(F.struct("f.place", "f.insight_id", "metric_key", "summary_key"))).alias("found")
    )
    fold = """aggregate(found, named_struct('ids', CAST(array() AS ARRAY<STRING>), 'metrics', CAST(array() AS ARRAY<STRING>), 'summaries', CAST(array() AS ARRAY<STRING>)),
      (s, f) -> IF(array_contains(s.metrics, f.metric_key) OR array_contains(s.summaries, f.summary_key), s,
        named_struct('ids', array_append(s.ids, f.insight_id), 'metrics', array_append(s.metrics, f.metric_key), 'summaries', array_append(s.summaries, f.summary_key))),
      s -> s.ids)"""
    kept = groups.select(F.explode(F.expr(fold)).alias("insight_id"))
    zoned = keyed.filter(F.col("zone_key") != "").join(kept, "insight_id", "left_semi")
    return keyed.filter(F.col("zone_key") == "").unionByName(zoned)


def limit_per_zone(deduped: DataFrame, max_per_zone: int = 1) -> DataFrame:
    """At most ``max_per_zone`` findings per zone; zone-less ones, which
    are exempt, do not pass through the window."""
    keyed = deduped.withColumn("zone_key", zone_key())
    place = F.row_number().over(Window.partitionBy("zone_key").orderBy(*rank_order()))
    zoned = keyed.filter(F.col("zone_key") != "").withColumn("zone_rn", place)
    return keyed.filter(F.col("zone_key") == "").unionByName(zoned.filter(F.col("zone_rn") <= max(1, int(max_per_zone))).drop("zone_rn"))


def _category_place() -> Column:
    """Position of the category in the fixed order."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")) - 1, F.lit(len(CATEGORIES)))


def _best_of_categories(findings: DataFrame, n: int, name: str) -> DataFrame:
    """The first ``n`` findings of each category, with their place."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(*rank_order()))
    return findings.filter(F.col("category").isin(*CATEGORIES)).withColumn(name, place).filter(F.col(name) <= n)


def category_diversity(candidates: DataFrame, max_summary: int = 5, max_per_category: int = 2) -> DataFrame:
    """Best finding of each category in fixed category order, then the
    next-best ones by rank while a category has fewer than
    ``max_per_category``; at most ``max_summary`` in total.

    Phase 2 only runs when phase 1 left room, i.e. when every non-empty
    category's best was already taken, so it reduces to ranks 2..cap.
    """
    picked = _best_of_categories(candidates, max(1, max_per_category), "cat_rn")
    first = F.col("cat_rn") == 1
    order = [F.when(first, 0).otherwise(1), F.when(first, _category_place()), *rank_order()]
    top = picked.orderBy(*order).limit(max(0, max_summary))
    # the window holds max_summary rows
    return top.withColumn("summary_ord", F.row_number().over(Window.orderBy(*order))).drop("cat_rn")


def top_per_category(deduped: DataFrame, max_per_category: int = 3) -> DataFrame:
    """The best ``max_per_category`` findings of each category."""
    return _best_of_categories(deduped, max_per_category, "category_rank")


def stage_counts(raw: DataFrame, filtered: DataFrame, deduped: DataFrame, summary: DataFrame,
                 by_category: DataFrame) -> DataFrame:
    """One row per stage / category with its count (one aggregation job)."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("stage"), F.lit("").alias("category"))

    parts = (
        tagged(raw, "raw")
        .unionByName(tagged(filtered, "post_filter"))
        .unionByName(tagged(deduped, "post_dedup"))
        .unionByName(tagged(summary, "executive_summary"))
        .unionByName(by_category.select(F.lit("by_category").alias("stage"), F.col("category")))
    )
    counted = parts.groupBy("stage", "category").agg(F.count(F.lit(1)).alias("count"))
    # stages with zero rows still appear
    stages = raw.sparkSession.createDataFrame(
        [(s, "") for s in ("raw", "post_filter", "post_dedup", "executive_summary")]
        + [("by_category", c) for c in CATEGORIES],
        "stage string, category string",
    )
    return stages.join(counted, ["stage", "category"], "left").select(
        "stage", "category", F.coalesce(F.col("count"), F.lit(0).cast(T.LongType())).alias("count")
    )
