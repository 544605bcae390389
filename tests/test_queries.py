"""The six queries and drill-down on small inline tables."""

import pytest

from zonepulse.plans import queries as Q


@pytest.fixture
def tables(make_tables):
    rows = []
    for ci, city in enumerate(["C1", "C2"]):
        for zi in range(3):
            zone = f"Z{zi}"  # same zone name in both cities
            for w in range(4):
                rows.append(("MX", city, zone, "Wealthy" if zi else "Non Wealthy", "Prioritized",
                             "Lead Penetration", w, 0.1 * (zi + 1) + 0.01 * w + ci))
    orders = [("MX", city, f"Z{zi}", w, 10.0 * (zi + 1) + (3 - w)) for city in ("C1", "C2") for zi in range(3) for w in range(4)]
    return make_tables(rows, orders)


def test_top_n_ties_and_rank(make_tables):
    m, o = make_tables([("A", "B", z, "T", "P", "M", 0, v) for z, v in (("b", 1.0), ("a", 1.0), ("c", 2.0))])
    r = Q.top_n(m, o, "m", "zone", 2, "desc").collect()
    assert [(x.rank, x.zone) for x in r] == [(1, "c"), (2, "a")]


def test_drill_down_and_clear(tables):
    m, o = tables
    r = Q.aggregation(m, o, "Lead Penetration", "country", "mean", {"country": "mx"})
    assert r.columns == ["city", "value"]
    r2 = Q.group_comparison(m, o, "Lead Penetration", "zone_type", "mean", {"zone_type": "Wealthy"})
    assert sorted(x.zone_type for x in r2.collect()) == ["Non Wealthy", "Wealthy"]
    assert Q.resolve_group_by("zone_prioritization", {"zone_prioritization": "x"}) == ("zone_prioritization", {})


def test_orders_reject_zone_type_filter(tables):
    m, o = tables
    with pytest.raises(ValueError):
        Q.aggregation(m, o, "Orders", "city", "sum", {"zone_type": "Wealthy"})


def test_trend_requires_filter(tables):
    m, o = tables
    with pytest.raises(ValueError):
        Q.trend(m, o, "Lead Penetration", 3)
    r = Q.trend(m, o, "Lead Penetration", 3, "count", {"country": "MX"}).collect()
    assert [x.week for x in r] == [2, 1, 0] and all(x.value == 6 for x in r)


def test_multivariable_and_subset_of_or(tables):
    m, o = tables
    conds = [("Lead Penetration", "high", None), ("Orders", "gt", 15.0)]
    a = {tuple(r[:3]) for r in Q.multivariable_filter(m, o, conds, "and").collect()}
    b = {tuple(r[:3]) for r in Q.multivariable_filter(m, o, conds, "or").collect()}
    assert a <= b and a
    with pytest.raises(ValueError):
        Q.multivariable_filter(m, o, [("Orders", "high", None)], "and")


def test_growth_merges_same_zone_name(tables):
    m, o = tables
    r = Q.growth(m, o, 4, 5).collect()
    assert len(r) == 3  # Z0..Z2 merged across C1/C2
    z2 = [x for x in r if x.zone == "Z2"][0]
    assert z2.baseline_value == pytest.approx(30.0) and z2.current_value == pytest.approx(33.0)
    assert z2.growth_rate == pytest.approx(0.1)


def test_result_envelope(tables):
    from zonepulse.plans.results import run_query

    m, o = tables
    r = run_query("top_n_ranking", m, o, metric="Lead Penetration", n=3)
    assert r.title == "Top 3 zone by Lead Penetration" and r.result_type == "table"
    assert r.metadata["display"] == {"value_format": "number", "decimals": 2} and r.row_count() == 3
    t = run_query("trend_analysis", m, o, metric="Orders", last_n_weeks=2, filters={"country": "MX"})
    assert t.result_type == "timeseries" and t.title == "Orders trend over last 2 weeks"
    d = run_query("aggregation", m, o, metric="Lead Penetration", group_by="country", filters={"country": "MX"})
    assert d.metadata["group_by"] == "city"
    g = run_query("growth_analysis", m, o, last_n_weeks=3, filters={"country": "MX"})
    assert g.metadata["baseline_week"] == 2 and g.metadata["column_display"]["growth_rate"] == ("percentage_ratio", 2)


def test_null_geography_groups(make_tables):
    m, o = make_tables([("A", None, "Z1", "T", "P", "M", 0, 1.0), ("A", None, "Z2", "T", "P", "M", 0, 3.0),
                        ("A", "C", "Z3", "T", "P", "M", 0, 5.0), ("A", "C", "Z3", "T", "P", "N", 0, 5.0),
                        ("A", None, "Z1", "T", "P", "N", 0, 9.0)])
    r = Q.aggregation(m, o, "M", "city", "mean").collect()
    assert [(x.city, x.value) for x in r] == [("C", 5.0), (None, 2.0)]  # value DESC, null group kept
    mv = Q.multivariable_filter(m, o, [("M", "gt", 0.5), ("N", "gt", 0.5)], "and").collect()
    assert sorted((x.zone, x.matched_conditions) for x in mv) == [("Z1", 2), ("Z3", 2)]


def test_exact_quantiles_by_distributed_sort(spark):
    import random
    import statistics

    from zonepulse.functions.ranks import group_quantiles, numbered

    rng = random.Random(5)
    rows = [(f"g{i % 7}" if i % 11 else None, rng.choice([None, rng.randint(0, 30) / 4, float("nan")]), rng.random()) for i in range(600)]
    rows.append(("empty", None, None))
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    found = {r.g: r for r in group_quantiles(df, ["g"], {"a50": ("a", 0.5), "b90": ("b", 0.9), "a0": ("a", 0.0)}).collect()}
    assert set(found) == {g for g, _, _ in rows}
    for g, r in found.items():
        a = sorted(x for k, x, _ in rows if k == g and x is not None and x == x)
        b = sorted(x for k, _, x in rows if k == g and x is not None)
        assert r.a50 == (pytest.approx(statistics.median(a)) if a else None)
        assert r.a0 == (a[0] if a else None)
        if b:
            at = 0.9 * (len(b) - 1)
            want = b[int(at)] + (b[min(int(at) + 1, len(b) - 1)] - b[int(at)]) * (at % 1)
            assert r.b90 == pytest.approx(want)
    places = numbered(df.where("b is not null").orderBy("b")).collect()
    assert [r.position for r in sorted(places, key=lambda r: r.b)] == list(range(1, 601))


def test_no_percentile_buffer_in_the_median_plan(make_tables):
    m, o = make_tables([("A", "B", f"z{i}", "T", "P", "M", 0, float(v)) for i, v in enumerate([5, 1, 3])])
    found = Q.aggregation(m, o, "M", "country", "median")
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.value for r in found.collect()] == [3.0]
