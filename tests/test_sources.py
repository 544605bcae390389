"""Finding and reading exports by name (A1, A2), safe replacement (A3), fingerprints and the report cache (A5)."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from zonepulse.operators import fingerprint as Fp
from zonepulse.operators import prep as P
from zonepulse.plans.prep_run import load_processed, prepare_folder
from zonepulse.plans.report_cache import cached_report, report_key, stored_key
from zonepulse.sources.exports import choose_folder, find_exports, header_catalog, read_csv_by_name
from zonepulse.sources.storage import settle
from zonepulse.sources.tables import read_long_table, read_wide_export, write_table


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_files_with_different_headers_are_united_by_name(spark, tmp_path):
    folder = tmp_path / "raw.csv"
    put(folder / "a.csv", "COUNTRY,City,ZONE,Zone Type,Zone-Prioritization,METRIC,L0W\nMX,C,Z1,T,P,M,1\n")
    put(folder / "b.csv", "L0W,metric,zone_prioritization,zone type,zone,city,country,Remark\n2,M,P,T,Z2,C,MX,hello\n")
    put(folder / "c.csv", "country,city,zone,zone_type,zone_prioritization,metric,L1W\nMX,C,Z3,T,P,M,3\n")
    put(folder / "d.csv", "")
    with gzip.open(folder / "e.csv.gz", "wt") as out:
        out.write("metric,country,city,zone,zone_type,zone_prioritization,L0W\nM,MX,C,Z5,T,P,5\n")
    assert len(header_catalog(spark, str(folder))) == 4
    got = P.reshape_metrics(read_wide_export(spark, str(folder))).collect()
    assert sorted((r.zone, r.week, r.value) for r in got) == [("Z1", 0, 1.0), ("Z2", 0, 2.0), ("Z3", 1, 3.0), ("Z5", 0, 5.0)]


def test_two_columns_of_one_name_are_refused(spark, tmp_path):
    path = put(tmp_path / "x.csv" / "a.csv", "Zone Type,zone_type\n1,2\n")
    with pytest.raises(ValueError, match="zone_type"):
        read_csv_by_name(spark, os.path.dirname(path))


def test_tables_are_found_by_canonical_name(spark, tmp_path):
    head = "country,city,zone,zone_type,zone_prioritization,metric,L0W\n"
    put(tmp_path / "one" / "RAW Input-Metrics.csv", head + "MX,C,Z,T,P,M,1\n")
    with pytest.raises(ValueError, match="no table is called raw_orders.*RAW Input-Metrics.csv"):
        find_exports(spark, str(tmp_path / "one"))
    put(tmp_path / "one" / "raw_orders.csv", "country,city,zone,L0W\nMX,C,Z,4\n")
    put(tmp_path / "one" / "RAW_SUMMARY.csv", "what\nnothing\n")
    found = find_exports(spark, str(tmp_path / "one"))
    assert {k: os.path.basename(v) for k, v in found.items()} == {"raw_input_metrics": "RAW Input-Metrics.csv", "raw_orders": "raw_orders.csv"}

    assert choose_folder(spark, str(tmp_path)) == str(tmp_path / "one")
    for name in ("raw_orders.csv", "raw_input_metrics.csv"):
        put(tmp_path / "two, copy" / name, head)
    with pytest.raises(ValueError, match="several folders"):
        choose_folder(spark, str(tmp_path))
    assert choose_folder(spark, str(tmp_path), hint=("two", "copy")) == str(tmp_path / "two, copy")
    with pytest.raises(ValueError, match="no folder"):
        choose_folder(spark, str(tmp_path / "one"))

    paths = prepare_folder(spark, str(tmp_path / "one"), str(tmp_path / "out"))
    tables = load_processed(spark, paths)
    assert tables["metrics_long"].count() == 1 and tables["analytics_base"].count() == 2
    put(tmp_path / "one" / "Raw_Orders.parquet", "")
    with pytest.raises(ValueError, match="more than one"):
        find_exports(spark, str(tmp_path / "one"))


def failing(spark, m):
    boom = F.when(F.col("week") >= 0, F.raise_error(F.lit("lost"))).cast("double")
    return m.withColumn("value", boom)


def test_a_failed_write_leaves_the_old_table(spark, make_tables, tmp_path):
    m, _ = make_tables([("MX", "C", "Z", "T", "P", "M", w, 1.0 + w) for w in range(3)])
    for options in ({}, {"partition_by": ("week",)}, {"partition_by": ("week",), "only_partitions": True}):
        path = str(tmp_path / f"t{len(options)}")
        write_table(m, path, **{k: v for k, v in options.items() if k == "partition_by"})
        with pytest.raises(Exception, match="lost"):
            write_table(failing(spark, m), path, **options)
        assert sorted(r.value for r in read_long_table(spark, path).collect()) == [1.0, 2.0, 3.0]
        assert sorted(os.listdir(tmp_path)) == sorted({*(f"t{n}" for n in range(len(options) + 1) if os.path.exists(tmp_path / f"t{n}"))})


def test_one_week_changes_one_partition(spark, make_tables, tmp_path):
    path = str(tmp_path / "weeks")
    rows = [("MX", "C", "Z", "T", "P", k, w, 1.0 + w) for w in range(3) for k in ("M", "N")]
    m, _ = make_tables(rows)
    write_table(P.with_key_columns(m), path, partition_by=("week", "metric_key"))
    before = {d: os.stat(f"{path}/{d}").st_ino for d in os.listdir(path) if d.startswith("week=")}
    week, _ = make_tables([("MX", "C", "Z", "T", "P", "M", 1, 9.0)])
    assert write_table(P.with_key_columns(week), path, partition_by=("week", "metric_key"), only_partitions=True) == ["week=1"]
    after = {d: os.stat(f"{path}/{d}").st_ino for d in os.listdir(path) if d.startswith("week=")}
    assert {d for d in before if before[d] != after[d]} == {"week=1"}
    got = sorted((r.week, r.metric, r.value) for r in read_long_table(spark, path).collect())
    assert got == [(0, "M", 1.0), (0, "N", 1.0), (1, "M", 9.0), (2, "M", 3.0), (2, "N", 3.0)]
    with pytest.raises(ValueError):
        write_table(m, str(tmp_path / "plain"), only_partitions=True)


def test_a_swap_that_was_cut_off_is_undone(spark, make_tables, tmp_path):
    m, _ = make_tables([("MX", "C", "Z", "T", "P", "M", w, 1.0) for w in range(2)])
    path = tmp_path / "t"
    write_table(m, str(path), partition_by=("week",))
    os.rename(path, tmp_path / ".t.old-1")
    assert read_long_table(spark, str(path)).count() == 2
    os.rename(path / "week=1", path / ".week=1.old-2")
    assert read_long_table(spark, str(path)).count() == 2
    settle(spark, str(tmp_path / "nothing"))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)]
    frame = lambda r, t="x long, y string, z double": spark.createDataFrame(r, t)
    one = Fp.fingerprint(frame(rows)).first()
    assert one == Fp.fingerprint(frame(rows[::-1]).repartition(3)).first() and one.row_count == 3
    assert one != Fp.fingerprint(frame(rows[:2])).first()
    assert one != Fp.fingerprint(frame([(1, "a", 0.0), *rows[1:]])).first()
    assert one != Fp.fingerprint(frame(rows).withColumnRenamed("x", "w")).first()


@pytest.mark.parametrize(
    ("left", "right", "kinds"),
    [
        ([("a\x1fb", "c")], [("a", "b\x1fc")], ("a string, b string",) * 2),
        ([("a", "1:b")], [("a1:", "b")], ("a string, b string",) * 2),
        ([(None, "n")], [("n", None)], ("a string, b string",) * 2),
        ([("", None)], [(None, "")], ("a string, b string",) * 2),
        ([(1, "x")], [("1", "x")], ("a int, b string", "a string, b string")),
        ([(1, "x")], [(1, "x")], ("a int, b string", "a long, b string")),
        ([([1, 23],)], [([12, 3],)], ("a array<int>",) * 2),
        ([([None],)], [(None,)], ("a array<string>",) * 2),
    ],
)
def test_fingerprint_tells_values_and_types_apart(spark, left, right, kinds):
    a, b = (Fp.fingerprint(spark.createDataFrame(r, t)).first().fingerprint for r, t in zip((left, right), kinds, strict=True))
    assert a != b


def test_a_new_partition_costs_only_itself(spark, make_tables, tmp_path):
    path = str(tmp_path / "weeks")
    m, _ = make_tables([("MX", "C", f"Z{i}", "T", "P", "M", w, float(i + w)) for w in range(4) for i in range(20)])
    write_table(m, path, partition_by=("week",))
    table = spark.read.parquet(path)
    sums = Fp.partition_sums(table.where("week < 3"), ["week"])
    fresh = Fp.partition_sums(table.where("week = 3"), ["week"])
    assert "week#" in fresh._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters")[0]
    whole = Fp.fingerprint(table).first()
    assert Fp.combined(Fp.with_partitions(sums, fresh, ["week"]), Fp.structure(table)).first() == whole
    again = Fp.with_partitions(Fp.with_partitions(sums, fresh, ["week"]), fresh, ["week"])
    assert Fp.combined(again, Fp.structure(table)).first() == whole
    empty = Fp.combined(Fp.partition_sums(table.where("false"), ["week"]), Fp.structure(table)).first()
    assert empty == Fp.fingerprint(table.where("false")).first() and empty.row_count == 0


def test_a_report_is_kept_until_something_changes(spark, make_tables, tmp_path):
    rows = [("CO", "B", "Z", "Wealthy", "P", "Lead Penetration", 1, 100.0), ("CO", "B", "Z", "Wealthy", "P", "Lead Penetration", 0, 130.0)]
    m, o = make_tables(rows, [("CO", "B", "Z", 0, 5.0)])
    folder = str(tmp_path / "report")
    assert stored_key(spark, folder) is None
    first, there = cached_report(m, o, folder)
    assert not there
    lines = sorted((r.ord, r.line) for r in first.collect())
    again, there = cached_report(m, o, folder)
    assert there and sorted((r.ord, r.line) for r in again.collect()) == lines
    assert report_key(m, o, top_k_critical=5) != report_key(m, o, top_k_critical=4)
    assert report_key(m, o) != report_key(o.withColumns({"zone_type": F.lit("x"), "zone_prioritization": F.lit("x")}), o)
    changed, there = cached_report(m, o, folder, max_per_category=1)
    assert not there
    put(tmp_path / "report" / "key" / "part-0.txt", "{broken")
    assert not cached_report(m, o, folder, max_per_category=1)[1]
