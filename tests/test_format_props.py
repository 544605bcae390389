"""Spark number formatting equals Python's formatting semantics."""

import random

from pyspark.sql import functions as F

from zonepulse.functions.format import fixed, format_metric_value, format_number, format_pct_ratio


def py_number(x, d=4):
    return str(int(x)) if float(x).is_integer() else f"{x:.{d}f}".rstrip("0").rstrip(".")


def sample_values():
    rng = random.Random(42)
    vals = [0.28125, 0.03125, 2.5, 0.125, -0.28125, 1.0, -3.0, 0.0, 12.345, 2.675, 1e-7, -1e-7, 123456.789]
    vals += [k / 2 ** n for k in range(1, 40, 3) for n in (3, 5, 7)]
    vals += [rng.uniform(-1000, 1000) for _ in range(300)]
    vals += [round(rng.uniform(0, 1), rng.randint(1, 7)) for _ in range(300)]
    return vals


def test_fixed_and_number_formats_match_python(spark):
    vals = sample_values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, x double")
    got = df.select("i", fixed("x", 2).alias("f2"), fixed("x", 4).alias("f4"),
                    format_number("x").alias("n4"), format_number("x", 2).alias("n2"),
                    format_pct_ratio("x").alias("p")).orderBy("i").collect()
    for v, r in zip(vals, got):
        assert r.f2 == f"{v:.2f}", (v, r.f2)
        assert r.f4 == f"{v:.4f}", (v, r.f4)
        assert r.n4 == py_number(v), (v, r.n4)
        assert r.n2 == py_number(v, 2), (v, r.n2)
        assert r.p == f"{v * 100:.2f}%", (v, r.p)


def test_metric_display_formats(spark):
    rows = [(1, 12.5, "integer", 0), (2, 13.5, "integer", 0), (3, 0.28125, "percentage_ratio", 2),
            (4, None, "number", 2), (5, 1.005, "number", 2)]
    df = spark.createDataFrame(rows, "i long, v double, f string, d int")
    got = [r.s for r in df.select("i", format_metric_value("v", F.col("f"), F.col("d")).alias("s")).orderBy("i").collect()]
    assert got == [str(int(round(12.5))), str(int(round(13.5))), f"{0.28125 * 100:.2f}%", "N/A", f"{1.005:.2f}"]
