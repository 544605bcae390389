"""Detectors on inline fixtures with exact expected numbers."""

import pytest

from zonepulse.operators import curation as C
from zonepulse.operators import detectors as D
from zonepulse.plans.insights import collect_insights


def test_anomaly_fixture(make_tables):
    m, o = make_tables([
        ("CO", "Bogota", "Chapinero", "Wealthy", "Prioritized", "Lead Penetration", 1, 100.0),
        ("CO", "Bogota", "Chapinero", "Wealthy", "Prioritized", "Lead Penetration", 0, 130.0),
    ])
    rows = D.detect_anomalies(m, o).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.pct_change == pytest.approx(0.30)
    assert r.abs_delta == pytest.approx(30.0)
    assert r.sign_flip is False
    assert r.confidence == "high"
    assert r.severity_score == pytest.approx(94.0)
    pr = C.with_priority(collect_insights(m, o)).collect()
    assert [p.priority_score for p in pr] == [pytest.approx(80.5)]


def test_trend_fixture(make_tables):
    m, o = make_tables([
        ("MX", "CDMX", "Roma", "Wealthy", "Prioritized", "Perfect Orders", w, v)
        for w, v in ((3, 1.00), (2, 0.90), (1, 0.80), (0, 0.70))
    ])
    rows = D.detect_trends(m, o).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.run_length, r.start_week, r.end_week) == (3, 3, 0)
    assert r.net_change_pct == pytest.approx(-0.30)
    assert r.severity_score == pytest.approx(81.0)
    pr = C.with_priority(collect_insights(m, o)).collect()
    assert [p.priority_score for p in pr] == [pytest.approx(71.75)]


def test_benchmark_fixture(make_tables):
    values = [100, 102, 98, 101, 99, 140]
    m, o = make_tables([
        ("CO", "Bogota", f"z{i}", "Non Wealthy", "Prioritized", "Lead Penetration", 0, v) for i, v in enumerate(values)
    ])
    rows = D.detect_benchmarking(m, o).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.zone == "z5"
    assert r.peer_mean == pytest.approx(100.0)
    assert r.gap_pct == pytest.approx(0.40)
    assert r.peer_count == 6
    assert r.severity_score == pytest.approx(72.0)
    pr = C.with_priority(collect_insights(m, o)).collect()
    assert [p.priority_score for p in pr] == [pytest.approx(68.0)]


def test_trend_ties_older_run_wins_and_gap_breaks(make_tables):
    # weeks 8..0: falls 8→5 (3 steps), rise, falls 4→1 (3 steps), rise at 0
    vals = {8: 10, 7: 9, 6: 8, 5: 7, 4: 9, 3: 8, 2: 7, 1: 6, 0: 8}
    m, o = make_tables([("A", "B", "Z", "T", "P", "Perfect Orders", w, v) for w, v in vals.items()])
    r = D.detect_trends(m, o).collect()[0]
    assert (r.run_length, r.start_week, r.end_week) == (3, 8, 5)
    # a missing week interrupts a run
    gap = {6: 10, 5: 9, 3: 8, 2: 7, 1: 6}
    m2, o2 = make_tables([("A", "B", "Z", "T", "P", "Perfect Orders", w, v) for w, v in gap.items()])
    assert D.detect_trends(m2, o2).collect() == []


def test_trend_lower_is_better(make_tables):
    m, o = make_tables([
        ("A", "B", "Z", "T", "P", "Restaurants Markdowns / GMV", w, v) for w, v in ((3, 0.1), (2, 0.2), (1, 0.3), (0, 0.4))
    ])
    r = D.detect_trends(m, o).collect()[0]
    assert r.run_length == 3 and r.higher_is_better is False


def test_anomaly_zero_baseline_and_small_sign_flip(make_tables):
    m, o = make_tables([
        ("A", "B", "Z1", "T", "P", "Gross Profit UE", 1, 0.0),
        ("A", "B", "Z1", "T", "P", "Gross Profit UE", 0, 5.0),
        ("A", "B", "Z2", "T", "P", "Gross Profit UE", 1, 0.12),
        ("A", "B", "Z2", "T", "P", "Gross Profit UE", 0, -0.02),
    ])
    assert D.detect_anomalies(m, o).collect() == []


def test_constant_metric_correlation_is_null_not_error(make_tables):
    rows = []
    for i in range(10):
        rows.append(("C", "X", f"z{i}", "T", "P", "Lead Penetration", 0, 0.5))
        rows.append(("C", "X", f"z{i}", "T", "P", "Perfect Orders", 0, 0.1 * i))
    m, o = make_tables(rows)
    assert D.detect_correlations(m, o).collect() == []


def test_correlation_found(make_tables):
    rows = []
    for i in range(10):
        rows.append(("C", "X", f"z{i}", "T", "P", "Lead Penetration", 0, float(i)))
        rows.append(("C", "X", f"z{i}", "T", "P", "Perfect Orders", 0, 2.0 * i + 1))
    m, o = make_tables(rows)
    r = D.detect_correlations(m, o).collect()
    assert len(r) == 1 and r[0].correlation == pytest.approx(1.0) and r[0].sample_size == 10
    assert r[0].severity_score == pytest.approx(100.0)


def test_benchmark_null_zone_type_dropped_by_default(make_tables):
    rows = [("CO", "B", f"z{i}", None, "P", "Lead Penetration", 0, v) for i, v in enumerate([100, 102, 98, 101, 99, 140])]
    m, o = make_tables(rows)
    assert D.detect_benchmarking(m, o).collect() == []
    assert len(D.detect_benchmarking(m, o, include_untyped=True).collect()) == 1


def test_opportunity_rules(make_tables):
    rows = []
    # five zones; z0 has low quality and grows
    for i in range(5):
        rows.append(("C", "X", f"z{i}", "T", "P", "Perfect Orders", 0, 0.9 if i else 0.5))
    m, o = make_tables(rows, [("C", "X", "z0", 3, 10.0), ("C", "X", "z0", 0, 15.0)])
    r = D.opportunity_growth_quality(m, o).collect()
    assert len(r) == 1 and r[0].zone == "z0" and r[0].orders_growth_pct == pytest.approx(0.5)
