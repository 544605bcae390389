"""Radix selection: order keys of doubles, and quantiles against numpy."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonepulse.functions.ranks import group_quantiles, key_value, order_key
from zonepulse.operators.slices import aggregate_series
from zonepulse.plans import queries as Q

EXTREME = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, 1 - 2**-53, 1 + 2**-52, 2.0**1023, 4e-310]


def doubles():
    rng = random.Random(2)
    some = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    near = [s * 2.0**e * (1 + d * 2**-52) for e in range(-40, 41, 8) for d in (-2, -1, 0, 1, 2) for s in (1, -1)]
    return [x for x in some if x == x] + near + EXTREME + [rng.gauss(0, 1) for _ in range(500)]


def test_order_key_orders_like_the_double_and_can_be_turned_back(spark):
    values = doubles()
    rows = spark.createDataFrame([(x,) for x in values], "x double").selectExpr("x", f"{order_key('x')} AS k")
    rows = rows.selectExpr("*", f"{key_value('k')} AS back").collect()
    assert all(r.back == r.x for r in rows)
    bits = lambda x: struct.unpack("<Q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1)
    assert all(r.k == bits(r.x) for r in rows)


def groups():
    rng = random.Random(7)
    close = [1.0 + i * 2**-52 for i in range(300)]  # told apart by the last bits only
    return {
        "normal": [rng.gauss(0, 3) for _ in range(801)],
        "ties": [rng.choice([-1.5, 0.0, 2.0]) for _ in range(400)],
        "close": close + [1e300, -1e300],
        "equal": [7.25] * 64,
        "one": [3.5],
        "wide": [s * 10.0**e for e in range(-300, 301, 7) for s in (1, -1)],
        "tiny": [i * 5e-324 for i in range(-50, 77)],
        None: [float(i) for i in range(10)],
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_group_quantiles_equal_numpy(spark, partitions):
    fractions = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    rows = [(g, x, -x) for g, xs in groups().items() for x in xs]
    rows += [("normal", None, math.nan), ("nothing", None, math.nan), (None, math.nan, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(partitions)
    wanted = {f"{c}_{n}": (c, p) for c in "ab" for n, p in fractions.items()}
    found = {r.g: r for r in group_quantiles(df, ["g"], wanted).collect()}
    assert set(found) == {*groups(), "nothing"}
    for g, xs in groups().items():
        for name, p in fractions.items():
            assert found[g][f"a_{name}"] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-320)
            assert found[g][f"b_{name}"] == pytest.approx(np.quantile([-x for x in xs], p), rel=1e-12, abs=1e-320)
    assert all(found["nothing"][n] is None for n in wanted)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(5.0,), (1.0,), (2.0,)], "v double")
    assert group_quantiles(df, [], {"m": ("v", 0.5), "q": ("v", 0.25)}).collect() == [(2.0, 1.5)]
    none = df.where("v > 9")
    assert group_quantiles(none, [], {"m": ("v", 0.5)}).collect() == [(None,)]
    assert group_quantiles(none.withColumn("g", F.lit(1)), ["g"], {"m": ("v", 0.5)}).collect() == []
    infinite = spark.createDataFrame([(math.inf,), (-math.inf,), (3.0,)], "v double")
    assert group_quantiles(infinite, [], {"a": ("v", 0.0), "m": ("v", 0.5), "z": ("v", 1.0)}).collect() == [(-math.inf, 3.0, math.inf)]


def test_two_groups_of_keys(spark):
    rows = [(i % 3 or None, str(i % 2), float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    found = {(r.a, r.b): r.m for r in group_quantiles(df, ["a", "b"], {"m": ("v", 0.5)}).collect()}
    for key in {r[:2] for r in rows}:
        assert found[key] == np.median([v for *k, v in rows if tuple(k) == key])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_building_a_quantile_frame_runs_no_job_and_plans_no_sort(spark, make_tables):
    rows = [("CO", "B", f"z{i}", "Wealthy", None, "Lead Penetration", 0, i) for i in range(30)]
    rows += [("CO", "B", f"z{i}", "Wealthy", None, "Perfect Orders", 0, -i) for i in range(30)]
    m, o = make_tables(rows, [("CO", "B", "z1", 0, 5.0)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "frames only")
    try:
        median = aggregate_series(m, ["country"], "median")
        both = Q.multivariable_filter(m, o, [("Lead Penetration", "high"), ("Perfect Orders", "low")])
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Sort" not in plan_of(median) and "parquet" not in plan_of(both)
    assert median.collect() == [("CO", 0.0 - 0.0 + np.median([float(i) for i in range(30)] + [-float(i) for i in range(30)]))]
    assert {r.zone for r in both.collect()} == {f"z{i}" for i in range(22, 30)}
