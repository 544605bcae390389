"""Prep operators: names, week sets, number coercion, collapse, features."""

import pytest
from pyspark.sql import functions as F

from zonepulse.functions.columns import to_number
from zonepulse.operators import prep as P
from zonepulse.operators import quality as Qy


def test_canonical_names_and_week_sets():
    assert P.canonical_name(" Zone-Prioritization ") == "zone_prioritization"
    assert P.canonical_name("ZONE  TYPE_") == "zone_type"
    names = ["country", "l0w", "l1w", "l0w_roll", "l1w_roll"]
    assert [w.name for w in P.week_columns(names)] == ["l1w_roll", "l0w_roll"]
    assert [w.name for w in P.week_columns(names, rolled_first=False)] == ["l1w", "l0w"]
    assert [w.week for w in P.week_columns(["l0w", "l10w", "l2w"])] == [10, 2, 0]
    assert P.week_columns(["x", "l1", "xl1w"]) == []


def test_numeric_text(spark):
    df = spark.createDataFrame([(s,) for s in ["1e3", "1,000", " 12 ", "abc", "", "1d", ".5"]], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got == [1000.0, None, 12.0, None, None, None, 0.5]


def test_reshape_and_collapse_first_non_null(spark):
    wide = spark.createDataFrame(
        [("MX", "C", "Z", None, "P", " Orders GMV ", "1", "2"),
         ("MX", "C", "Z", "Wealthy", None, "Orders GMV", "3", "x"),
         ("MX", "C", "Z", "Other", "Q", "Orders GMV", None, "5")],
        ["COUNTRY", "City", "ZONE", "Zone Type", "zone_prioritization", "METRIC", "L1W", "L0W"])
    long = P.reshape_metrics(wide).orderBy("week").collect()
    assert [(r.week, r.value) for r in long] == [(0, 3.5), (1, 2.0)]
    assert [(r.zone_type, r.zone_prioritization) for r in long] == [("Other", "P"), ("Wealthy", "P")]
    assert {r.week_label for r in long} == {"l0w", "l1w"}


def test_orders_default_metric(spark):
    wide = spark.createDataFrame([("MX", "C", "Z", " ", "4")], ["country", "city", "zone", "metric", "L0W_ROLL"])
    r = P.reshape_orders(wide).collect()
    assert [(x.metric, x.week, x.week_label, x.value) for x in r] == [("Orders", 0, "l0w_roll", 4.0)]


def test_features_missing_week(make_tables):
    m, _ = make_tables([("A", "B", "Z", "T", "P", "M", 0, 2.0), ("A", "B", "Z", "T", "P", "M", 1, 1.5)])
    r = P.metrics_features(m).collect()[0]
    assert r.delta_1w == pytest.approx(0.5) and r.value_5w_ago is None and r.delta_5w is None


def test_quality_flags(make_tables, spark):
    m, o = make_tables(
        [("A", "B", "Z", None, "P", "M", 9, 1.0), ("A", "B", "Z", "T", "P", "M", 0, 1.0),
         ("A", "B", "Z", "T", "P", "M", 0, 2.0)],
        [("A", "B", "Q", 0, 3.0)])
    m = m.withColumn("week_label", F.when(F.col("week") == 9, "l9w").otherwise(F.col("week_label")))
    base = P.analytics_base(m, o)
    rep = Qy.quality_report(m, o, base, P.metrics_features(m))
    found = {(r.dataset, r.check): (r["count"], r.severity) for r in rep.collect()}
    assert found[("metrics_long", "week_out_of_range")] == (1, "critical")
    assert found[("metrics_long", "week_label_format")] == (1, "warning")
    assert found[("metrics_long", "duplicate_keys")] == (1, "critical")
    assert found[("metrics_long", "zone_type_conflicts")] == (1, "critical")
    assert found[("orders_long", "enrichment_unmatched")] == (1, "warning")
    assert Qy.overall_status(rep).collect()[0].status == "FAIL"


def test_collapse_null_keys(make_tables):
    m, _ = make_tables([("A", "B", None, "T", "P", "M", 0, 1.0), ("A", "B", "Z", "T", "P", "M", 0, 2.0)])
    assert P.collapse_duplicate_grain(m).count() == 2  # no duplicates: null-key row kept
    m2, _ = make_tables([("A", "B", None, "T", "P", "M", 0, 1.0), ("A", "B", "Z", "T", "P", "M", 0, 2.0),
                         ("A", "B", "Z", "T", "P", "M", 0, 4.0)])
    r = P.collapse_duplicate_grain(m2).collect()
    # the null-key row stays whether or not other rows are duplicated
    assert sorted((x.zone or "", x.value) for x in r) == [("", 1.0), ("Z", 3.0)]


def test_csv_is_read_by_name_and_in_file_order(spark, tmp_path):
    from zonepulse.sources.tables import read_long_table, read_wide_export

    folder = tmp_path / "orders.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("value,week_label,week,metric,zone,city,country\n1.5,l0w,0,Orders,Z,C,NA\nx,l1w,y,Orders,Z,C,\n")
    rows = read_long_table(spark, str(folder), "orders").orderBy("week_label").collect()
    assert [(r.country, r.week, r.value) for r in rows] == [("NA", 0, 1.5), (None, None, None)]
    (folder / "part-1.csv").write_text("week,value,week_label,metric,zone,city,country\n0,2.5,l0w,Orders,Z,C,MX\n")
    rows = read_long_table(spark, str(folder), "orders").where("country = 'MX'").collect()
    assert [(r.country, r.week, r.value) for r in rows] == [("MX", 0, 2.5)]

    wide = tmp_path / "wide.csv"
    wide.mkdir()
    head = "country,city,zone,zone type,zone prioritization,metric,L0W\n"
    # the larger file is read first by Spark, but comes later by name
    (wide / "a.csv").write_text(head + "MX,C,Z,,P,M,1\nMX,C,Z,First,,M,2\n")
    (wide / "b.csv").write_text(head + "MX,C,Z,Second,Q,M,3\n" + "MX,C,Other,T,P,M,1\n" * 500)
    got = P.reshape_metrics(read_wide_export(spark, str(wide))).where("zone = 'Z'").collect()
    assert [(r.zone_type, r.zone_prioritization, r.value) for r in got] == [("First", "P", 2.0)]


def test_key_columns_reach_the_scan(make_tables, tmp_path, spark):
    from zonepulse.operators.slices import apply_filters, filter_metric, snapshot_week
    from zonepulse.sources.tables import read_long_table, write_table

    m, _ = make_tables([("MX", "C", "Z", "T", "P", "Perfect Orders", w, 1.0 + w) for w in range(3)])
    path = str(tmp_path / "metrics")
    write_table(P.with_key_columns(m), path, partition_by=("week", "metric_key"))
    rows = apply_filters(snapshot_week(filter_metric(read_long_table(spark, path), "PERFECT ORDERS "), 1), {"country": " mx"})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "week" in scan.split("PartitionFilters:")[1].split("]")[0] and "metric_key" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "EqualTo(country_key,mx)" in scan
    assert [r.value for r in rows.collect()] == [2.0]


def test_quality_lists_values_and_keys(make_tables):
    m, _ = make_tables([("A", "B", "Z", "T", "P", "M", 9, 1.0), ("A", "B", None, "T", "P", "M", 0, 1.0), ("A", "B", None, "T", "P", "M", 0, 2.0)])
    keys = Qy.duplicate_keys(m, "metrics_long").collect()
    assert [(r.zone, r["count"]) for r in keys] == [(None, 2)]
    values = {(r.field, r.value): (r.accepted, r["count"]) for r in Qy.week_values(m, "metrics_long").collect()}
    assert values == {("week", "9"): (False, 1), ("week", "0"): (True, 2), ("week_label", "l9w"): (False, 1), ("week_label", "l0w"): (True, 2)}


def test_prepare_gives_the_findings_of_its_writes(make_tables, tmp_path, spark):
    from zonepulse.plans.prep_run import load_processed, prepare_checked

    head = ["country", "city", "zone", "zone_type", "zone_prioritization", "metric", "L0W", "L1W", "L9W"]
    rows = [("MX", "C", f"Z{i}", "T", "P", ("M", "Orders", "N")[i % 3], "1", "2", "3" if i == 4 else None) for i in range(40)]
    rows += [(None, "C", "Z", None, "P", "M", "5", None, None), ("MX", "C", None, None, "P", "m", "5", None, None)]
    spark.createDataFrame(rows, head).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([("MX", "C", f"Z{i}", "7", "x") for i in range(9)], ["country", "city", "zone", "L0W", "L1W"]).write.parquet(str(tmp_path / "o"))
    for fmt in ("parquet", "csv"):
        paths, found = prepare_checked(spark, str(tmp_path / "m"), str(tmp_path / "o"), str(tmp_path / fmt), fmt)
        t = load_processed(spark, paths)
        want = [Qy.profile_findings(t[n], n) for n in ("metrics_long", "orders_long", "analytics_base")]
        want.append(Qy.check_inventory(t["metrics_long"], t["orders_long"], t["analytics_base"]))
        assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for w in want for r in w.collect())
        assert ("metrics_long", "week_out_of_range", "", 1, "critical") in map(tuple, found.collect())
