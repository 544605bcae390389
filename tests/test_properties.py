"""Properties: results do not depend on input row order or partitioning."""

import pytest
from pyspark.sql import functions as F

from zonepulse.operators import detectors as D
from zonepulse.plans import queries as Q
from zonepulse.plans.insights import run_insights
from zonepulse.sources.adapter import zone_tables
from tests.conftest import SMALL_SF


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def base(spark):
    return zone_tables(spark, SMALL_SF, materialize=True)


@pytest.mark.parametrize("seed,parts", [(1, 3), (7, 11)])
def test_order_and_partition_invariance(base, seed, parts):
    m, o = base
    m2 = m.orderBy(F.rand(seed)).repartition(parts)
    o2 = o.orderBy(F.rand(seed + 1)).repartition(parts)
    for build in (
        lambda a, b: D.detect_anomalies(a, b),
        lambda a, b: D.detect_trends(a, b),
        lambda a, b: D.detect_benchmarking(a, b),
        lambda a, b: D.detect_correlations(a, b),
        lambda a, b: D.detect_opportunities(a, b),
        lambda a, b: Q.top_n(a, b, "Lead Penetration", "zone", 10),
        lambda a, b: Q.multivariable_filter(a, b, [("Perfect Orders", "low", None), ("Orders", "high", None)], "or"),
        lambda a, b: Q.growth(a, b, 9, 50),
    ):
        assert _rows(build(m, o)) == _rows(build(m2, o2))


def test_curation_invariance(base):
    m, o = base
    a = run_insights(m, o)
    b = run_insights(m.orderBy(F.rand(3)).repartition(5), o.orderBy(F.rand(4)).repartition(5))
    assert _rows(a.curated.select("insight_id", "priority_score")) == _rows(b.curated.select("insight_id", "priority_score"))
    assert _rows(a.executive_summary.select("insight_id", "summary_ord")) == _rows(
        b.executive_summary.select("insight_id", "summary_ord"))


def test_trend_run_bounded_by_rows(base):
    m, o = base
    runs = D.detect_trends(m, o, min_consecutive_steps=1)
    per_key = m.groupBy("country", "city", "zone", "metric").agg(F.countDistinct("week").alias("n"))
    joined = runs.join(per_key, ["country", "city", "zone", "metric"])
    assert joined.filter(F.col("run_length") > F.col("n") - 1).count() == 0
    assert joined.filter(F.col("start_week") - F.col("end_week") != F.col("run_length")).count() == 0


def test_every_finding_reaches_the_insights(base):
    m, o = base
    run = run_insights(m, o, top_k_critical=12)
    single = [D.detect_anomalies, D.detect_trends, D.detect_benchmarking, D.detect_correlations, D.detect_opportunities]
    assert run.raw.count() == sum(f(m, o).count() for f in single)
    assert run.raw.select("insight_id").distinct().count() == run.raw.count()
    assert D.detect_anomalies(m, o, max_insights=3).count() == 3
    per_category = {r.category: r["count"] for r in run.executive_candidates.groupBy("category").count().collect()}
    assert run.executive_summary.count() == sum(min(2, n) for n in per_category.values())
