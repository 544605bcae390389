"""The insight run (K6): five detectors → one insight table → curation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.functions.columns import union_all
from zonepulse.model import check_range
from zonepulse.operators import curation as C
from zonepulse.operators import detectors as D
from zonepulse.operators import wording as W
from zonepulse.session import materialize

# Evidence fields of each category, in order.
EVIDENCE_COLUMNS = {
    "anomalies": ["week_1_value", "week_0_value", "pct_change", "baseline_abs", "abs_delta", "sign_flip",
                  "direction", "confidence"],
    "trends": ["run_length", "start_week", "end_week", "start_value", "end_value", "net_change_pct",
               "higher_is_better"],
    "benchmarking": ["zone_value", "peer_mean", "gap_pct", "peer_count", "zone_type"],
    "correlations": ["metric_x", "metric_y", "correlation", "sample_size"],
    "opportunities": ["orders_growth_pct", "perfect_orders", "country_perfect_orders_median", "lead_penetration",
                      "country_quality_p75", "country_penetration_p25", "gross_profit_ue",
                      "country_gp_top_decile", "turbo_adoption", "country_turbo_median"],
}

def _common(df: DataFrame, ord_: int, category: str, title, metric, country, city, zone, summary, hint,
            affected, emit: tuple, key: tuple, confidence=None) -> DataFrame:
    """The shared columns of a finding.

    ``insight_id`` is the MD5 of the category and the finding's own keys: the
    same in every run, whatever else is found. ``emit_a`` and ``emit_b`` (both
    downwards), then ``emit_rule``, the location, ``emit_pair``, the metric and
    the zone type (all upwards) are the detector's order.
    """
    a, b, rule, pair = emit
    name = F.concat_ws("|", F.lit(category), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key])
    cols = [
        F.md5(name).alias("insight_id"),
        F.lit(ord_).alias("detector_ord"),
        a.cast("double").alias("emit_a"),
        b.cast("double").alias("emit_b"),
        rule.cast("int").alias("emit_rule"),
        pair.cast("int").alias("emit_pair"),
        F.lit(category).alias("category"),
        title.alias("title"),
        metric.alias("metric"),
        country.cast(T.StringType()).alias("country"),
        city.cast(T.StringType()).alias("city"),
        zone.cast(T.StringType()).alias("zone"),
        F.col("severity_score"),
        summary.alias("summary"),
        hint.alias("recommendation_hint"),
        (confidence if confidence is not None else F.lit(None).cast(T.StringType())).alias("confidence"),
        affected.cast(T.LongType()).alias("affected_zones_count"),
    ]
    evidence = [c for c in EVIDENCE_COLUMNS[category] if c != "confidence"]
    kind = [F.col("zone_type").alias("emit_type") if "zone_type" in df.columns else F.lit(None).cast("string").alias("emit_type")]
    return df.select(*cols, *kind, *evidence)


def collect_insights(metrics_df: DataFrame, orders_df: DataFrame, include_untyped: bool = False) -> DataFrame:
    """K6: the five detectors in fixed order, as one table.

    Evidence fields are typed nullable columns (a finding fills those of its
    category); ``evidence_json`` carries them as one JSON object. The long
    tables are read once, into stored week vectors that all detectors share.
    """
    c, zero = F.col, F.lit(0)
    vectors = materialize(D.zone_vectors(metrics_df, orders_df))
    k1 = D.detect_anomalies(metrics_df, orders_df, vectors=vectors)
    k1 = _common(
        k1, 0, "anomalies", W.anomaly_title(c("direction"), c("metric")), c("metric"), c("country"), c("city"),
        c("zone"), W.anomaly_summary(c("metric"), c("zone"), c("city"), c("country"), c("pct_change"),
                                     c("direction"), c("sign_flip")),
        W.anomaly_hint(c("metric"), c("direction")), F.lit(1), (c("severity"), c("pct_change"), zero, zero),
        ("country", "city", "zone", "metric"), c("confidence"),
    )
    k2 = D.detect_trends(metrics_df, orders_df, vectors=vectors)
    k2 = _common(
        k2, 1, "trends", W.trend_title(c("metric")), c("metric"), c("country"), c("city"), c("zone"),
        W.trend_summary(c("metric"), c("zone"), c("city"), c("country"), c("run_length")),
        F.lit(W.TREND_HINT), F.lit(1), (c("severity_score"), zero, zero, zero), ("country", "city", "zone", "metric"),
    )
    k3 = D.detect_benchmarking(metrics_df, orders_df, include_untyped=include_untyped, vectors=vectors)
    k3 = _common(
        k3, 2, "benchmarking", W.benchmark_title(c("zone"), c("metric")), c("metric"), c("country"), c("city"),
        c("zone"), W.benchmark_summary(c("zone"), c("gap_pct"), c("metric"), c("country")),
        F.lit(W.BENCHMARK_HINT), c("peer_count"), (c("severity"), zero, zero, zero),
        ("country", "city", "zone", "metric", "zone_type"),
    )
    k4 = D.detect_correlations(metrics_df, orders_df, vectors=vectors)
    k4 = _common(
        k4, 3, "correlations", W.correlation_title(c("metric_x"), c("metric_y"), c("direction")),
        F.concat(c("metric_x"), F.lit(" vs "), c("metric_y")), c("country"), F.lit(None), F.lit(None),
        W.correlation_summary(c("country"), c("metric_x"), c("metric_y"), c("direction"), c("correlation")),
        F.lit(W.CORRELATION_HINT), c("sample_size"), (c("severity_score"), zero, zero, c("pair")), ("country", "pair"),
    )
    k5 = D.detect_opportunities(metrics_df, orders_df, vectors=vectors)
    rule_title = F.when(c("rule") == 1, W.OPPORTUNITY_RULES[1][0]).when(c("rule") == 2, W.OPPORTUNITY_RULES[2][0]).otherwise(W.OPPORTUNITY_RULES[3][0])
    rule_metric = F.when(c("rule") == 1, W.OPPORTUNITY_RULES[1][1]).when(c("rule") == 2, W.OPPORTUNITY_RULES[2][1]).otherwise(W.OPPORTUNITY_RULES[3][1])
    rule_hint = F.when(c("rule") == 1, W.OPPORTUNITY_HINTS[1]).when(c("rule") == 2, W.OPPORTUNITY_HINTS[2]).otherwise(W.OPPORTUNITY_HINTS[3])
    k5 = _common(
        k5, 4, "opportunities", rule_title, rule_metric, c("country"), c("city"), c("zone"),
        W.opportunity_summary(c("rule"), c("zone"), c("country")), rule_hint, F.lit(1),
        (c("severity_score"), zero, c("rule"), zero), ("rule", "country", "city", "zone", "zone_type"),
    )
    allins = union_all([k1, k2, k3, k4, k5], allow_missing=True)
    evidence_cols = [e for cat in EVIDENCE_COLUMNS.values() for e in cat if e != "confidence"]
    seen = []
    for e in evidence_cols:
        if e not in seen:
            seen.append(e)
    evidence = F.to_json(F.struct(*[F.col(e) for e in seen], F.col("affected_zones_count")))
    return allins.withColumn("evidence_json", evidence)


@dataclass
class InsightRun:
    raw: DataFrame
    filtered: DataFrame
    curated: DataFrame
    executive_candidates: DataFrame
    executive_summary: DataFrame
    by_category: DataFrame
    counts: DataFrame
    max_summary: int


def run_insights(
    metrics_df: DataFrame,
    orders_df: DataFrame,
    top_k_critical: int = 5,
    max_per_category: int = 3,
    checkpoint: bool = True,
) -> InsightRun:
    """K6 + L1–L8.

    With ``checkpoint=True`` (default) the raw insight table and the curated
    table are checkpointed to the shared checkpoint folder: every later stage
    reuses them, and the long detector lineage is cut once instead of being
    replayed per stage. Nothing is capped: the summary has ``top_k_critical``
    findings at most, every other table all of them.
    """
    max_summary = check_range("top_k_critical", top_k_critical, 0)
    raw = collect_insights(metrics_df, orders_df)
    if checkpoint:
        raw = materialize(raw)
    filtered = C.filter_noise(raw)
    curated = C.deduplicate(C.with_priority(filtered))
    if checkpoint:
        curated = materialize(curated)
    candidates = C.limit_per_zone(curated, 1)
    summary = C.category_diversity(candidates, max_summary, 2)
    by_category = C.top_per_category(curated, max_per_category)
    counts = C.stage_counts(raw, filtered, curated, summary, by_category)
    return InsightRun(raw, filtered, curated, candidates, summary, by_category, counts, max_summary)
