"""Benchmark: adapter build, the six queries, detectors, insight run, prep,
quality and text operators at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 2). Prints one JSON line: for each step the median of the
repeated runs ("queries") and the first run ("cold"). Every run builds its
frames anew; none reuses an executed plan.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonepulse.operators import detectors as D  # noqa: E402
from zonepulse.operators import prep as P  # noqa: E402
from zonepulse.operators import quality as Qy  # noqa: E402
from zonepulse.operators import text as Tx  # noqa: E402
from zonepulse.plans import queries as Q  # noqa: E402
from zonepulse.plans.insights import run_insights  # noqa: E402
from zonepulse.plans.prep_run import prepare  # noqa: E402
from zonepulse.plans.report import report_lines  # noqa: E402
from zonepulse.session import build_session, materialize, shared_path  # noqa: E402
from zonepulse.sources import fixtures as X  # noqa: E402
from zonepulse.sources.adapter import zone_tables  # noqa: E402
from zonepulse.sources.tables import read_table  # noqa: E402


def timed(fn, repeat):
    """Seconds of the first run, and the median of the others. ``fn`` builds its
    frame and runs it, so that every run plans and executes anew."""
    times = []
    for _ in range(repeat + 1):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(times[0], 4), round(statistics.median(times[1:]), 4)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    spark = build_session(f"local[{cpus}]", "zonepulse-bench", shuffle_partitions=max(8, 2 * cpus))
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}

    def measure(name, fn, times=repeat):
        cold[name], warm[name] = timed(fn, times)

    # the line items to the stored zone x week facts
    measure("adapter", lambda: zone_tables(spark, sf_dir))
    m, o = zone_tables(spark, sf_dir)

    # E1-E7 on the stored base
    conditions = [("Lead Penetration", "high", None), ("Perfect Orders", "low", None), ("Orders", "gt", 8.0)]
    measure("e1_aggregation", lambda: Q.aggregation(m, o, "Lead Penetration", "country", "mean").collect())
    measure("e1_median", lambda: Q.aggregation(m, o, "Turbo Adoption", "city", "median", {"zone_type": "Wealthy"}).collect())
    measure("e2_top_n", lambda: Q.top_n(m, o, "Lead Penetration", "zone", 5, "desc").collect())
    measure("e3_group_comparison", lambda: Q.group_comparison(m, o, "Perfect Orders", "zone_type").collect())
    measure("e4_trend", lambda: Q.trend(m, o, "Gross Profit UE", 6, "mean", {"country": "EUROPE"}).collect())
    measure("e5_multivariable", lambda: Q.multivariable_filter(m, o, conditions, "or").collect())
    measure("e6_growth", lambda: Q.growth(m, o, 5, 10).collect())
    measure("e7_drill_down", lambda: Q.aggregation(m, o, "Turbo Adoption", "country", "mean", {"country": "ASIA"}).collect())
    # the flagship query from the raw tables
    measure("top_n_from_line_items", lambda: Q.top_n(*zone_tables(spark, sf_dir), "Lead Penetration", "zone", 5).collect())

    # K1-K5 and the whole insight run with report
    for name, detect in (("k1_anomalies", D.detect_anomalies), ("k2_trends", D.detect_trends), ("k3_benchmarking", D.detect_benchmarking),
                         ("k4_correlations", D.detect_correlations), ("k5_opportunities", D.detect_opportunities)):
        measure(name, lambda detect=detect: detect(m, o).collect())
    measure("k6_insight_run_report", lambda: report_lines(run_insights(m, o)).collect(), 1)

    # Exports of the shared folder to the four processed tables
    source = shared_path(spark, f"bench-wide-{uuid.uuid4().hex}")
    X.wide_metrics(m).write.parquet(f"{source}/metrics")
    X.wide_orders(o).write.parquet(f"{source}/orders")

    def prep_chain():
        prepare(spark, f"{source}/metrics", f"{source}/orders", shared_path(spark, f"bench-prep-{uuid.uuid4().hex}"))

    measure("b_prep_chain", prep_chain, 1)

    # J1-J11 on the dirty variants
    dm, do = (materialize(t) for t in X.dirty_tables(spark, sf_dir))
    base, features = materialize(P.analytics_base(dm, do)), materialize(P.metrics_features(dm))
    measure("j11_quality_suite", lambda: Qy.overall_status(Qy.quality_report(dm, do, base, features)).collect(), 1)

    # N1-N5 over whole texts
    conv, docs = read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "documents")
    measure("n1_term_tags", lambda: Tx.tag_business_terms(conv).selectExpr("count(term_tag)").collect())
    measure("n2_follow_up", lambda: Tx.with_follow_up(conv).selectExpr("count_if(follow_up)").collect())
    measure("n3_carry_forward", lambda: Tx.carry_forward_metric(conv).selectExpr("count(resolved_metric)").collect())
    measure("n4_mask_email", lambda: Tx.extract_masked_emails(docs).selectExpr("count(*)").collect())
    measure("n5_preview", lambda: Tx.previews(conv, ["conv_id", "turn"]).selectExpr("count(preview)").collect())

    print(json.dumps({"metric": "total_sec", "value": round(sum(warm.values()), 4), "unit": "sec", "queries": warm, "cold": cold,
                      "sf": sf, "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
