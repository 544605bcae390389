"""Sources/sinks (A2–A4) and the report structure (M6)."""

import os
import tempfile

from zonepulse.plans.catalog_curation import _run
from zonepulse.plans.report import REPORT_TITLE, report_lines, report_text, write_report
from zonepulse.sources.adapter import zone_tables
from zonepulse.sources.tables import read_long_table, write_table
from tests.conftest import SMALL_SF

HEADINGS = [
    "# Weekly Executive Insights Report", "## Executive Summary", "## Key Insights by Category",
    "### Anomalies", "### Concerning Trends", "### Benchmarking", "### Correlations", "### Opportunities",
    "## Cross-Cutting Recommendations",
]


def test_long_table_roundtrip_csv(spark):
    m, o = zone_tables(spark, SMALL_SF)
    out = tempfile.mkdtemp(prefix="zp-io-")
    write_table(m, os.path.join(out, "metrics.csv"), fmt="csv")
    back = read_long_table(spark, os.path.join(out, "metrics.csv"), "metrics")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in m.schema]
    assert back.exceptAll(m).count() == 0 and m.exceptAll(back).count() == 0


def test_report_structure_and_sink(spark):
    run = _run(spark, SMALL_SF)
    text = report_text(report_lines(run))
    lines = text.splitlines()
    assert lines[0] == REPORT_TITLE
    pos = [lines.index(h) for h in HEADINGS]
    assert pos == sorted(pos)
    n_summary = run.executive_summary.count()
    assert n_summary == 5
    bullets = [x for x in lines[pos[1]:pos[2]] if x.startswith("- **")]
    assert len(bullets) == n_summary
    out = os.path.join(tempfile.mkdtemp(prefix="zp-report-"), "report")
    write_report(run, out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(files) == 1
    with open(os.path.join(out, files[0]), encoding="utf-8") as fh:
        assert fh.read().strip() == text.strip()


def test_prepare_and_validate(spark):
    from zonepulse.plans.prep_run import prepare, validate
    from zonepulse.sources import fixtures as X

    m, o = zone_tables(spark, SMALL_SF)
    work = tempfile.mkdtemp(prefix="zp-prep-")
    X.wide_metrics(m).write.option("header", True).csv(os.path.join(work, "wide_metrics.csv"))
    X.wide_orders(o).write.parquet(os.path.join(work, "wide_orders"))
    paths = prepare(spark, os.path.join(work, "wide_metrics.csv"), os.path.join(work, "wide_orders"),
                    os.path.join(work, "processed"))
    folder = os.path.join(work, "processed", "metrics_long")
    parts = [d for d in os.listdir(folder) if d.startswith("week=")]
    assert len(parts) == m.select("week").distinct().count()
    assert all(len([f for f in files if f.endswith(".parquet")]) <= 2 for _, _, files in os.walk(folder))
    findings, status = validate(spark, paths)
    assert status.collect()[0].status == "PASS"
    back = spark.read.parquet(paths["metrics_long"]).select(*m.columns)
    cols = ["country", "city", "zone", "metric", "week", "value"]
    assert back.select(cols).exceptAll(m.select(cols)).count() == 0
