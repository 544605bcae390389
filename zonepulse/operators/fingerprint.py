"""Dataset fingerprints (A5): order-insensitive, typed, and mergeable over partitions.

A row's text has a cell for each column: ``n`` for null, else the length of the
value's text, a colon and the text. No value can be taken for another one, or
run into its neighbour. Two numbers of 60 bits from the row's MD5 are added up
exactly, so that rows may come in any order and repeated rows count. The sums
of a partition stand for its rows: those of a table are the sums of its
partitions', and a week that arrives is read alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMS = ("row_count", "sum_a", "sum_b")
_EXACT = T.DecimalType(38, 0)


def structure(df: DataFrame, leave_out=()) -> str:
    """Names and types of the columns, in order."""
    return "|".join(f"{name}:{kind}" for name, kind in df.dtypes if name not in leave_out)


def _cell(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    simple = not isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    text = value.cast(T.StringType()) if simple else F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def partition_sums(df: DataFrame, by=()) -> DataFrame:
    """(``by``..., row_count, sum_a, sum_b): one row per partition, or one for the table (also an empty one)."""
    digest = F.md5(F.concat(*[_cell(df, c) for c in df.columns]))
    part = lambda at: F.conv(F.substring("_digest", at, 15), 16, 10).cast(_EXACT)
    rows = df.select(*by, digest.alias("_digest"))
    total = lambda at: F.coalesce(F.sum(part(at)), F.lit(0)).cast(_EXACT)
    sums = [F.count(F.lit(1)).alias("row_count"), total(1).alias("sum_a"), total(18).alias("sum_b")]
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def with_partitions(known: DataFrame, fresh: DataFrame, by) -> DataFrame:
    """Known sums with those of partitions that came in or were replaced: only their rows were read."""
    return known.join(fresh.select(*by), list(by), "left_anti").unionByName(fresh)


def combined(sums: DataFrame, columns: str) -> DataFrame:
    """(fingerprint, row_count) of the table whose partitions have these sums; ``columns`` is its ``structure``."""
    whole = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(_EXACT).alias(c) for c in SUMS])
    text = F.concat_ws("#", F.lit(columns), *[F.col(c).cast("string") for c in SUMS])
    return whole.select(F.sha2(text, 256).alias("fingerprint"), F.col("row_count").cast("long").alias("row_count"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A5: (fingerprint, row_count) of a table. One aggregation: partial per task, one final merge."""
    return combined(partition_sums(df), structure(df))
