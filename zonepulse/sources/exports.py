"""Finding and reading exports by name: which table of a folder is meant, and which column of a file.

The names of an export are compared in their canonical form (lower case,
letters and digits joined by underscores), tables and columns alike. CSV files
of one export may list their columns in any order and carry further ones: a
catalog of headers (one line read per file) groups the files, each group is one
scan, and the scans are united by name.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.functions.columns import union_all
from zonepulse.operators.prep import ORD, canonical_name
from zonepulse.sources.storage import Folders

# Canonical names of the tables of an export, and of the one that is not read.
METRICS_EXPORT, ORDERS_EXPORT = "raw_input_metrics", "raw_orders"
IGNORED_EXPORTS = ("raw_summary",)

#: Headers read at the same time.
READERS = 16


def find_exports(spark: SparkSession, folder: str, wanted=(METRICS_EXPORT, ORDERS_EXPORT), ignored=IGNORED_EXPORTS) -> dict[str, str]:
    """Canonical name -> path for each wanted table of a folder; files and folders count, endings do not.

    A table that is missing, or that several entries could be, is an error that
    lists what there is. Entries named in ``ignored`` may be there.
    """
    names = [n for n in Folders(spark).names(folder) if not n.startswith((".", "_"))]
    found = defaultdict(list)
    for name in names:
        found[canonical_name(name.rsplit(".", 1)[0] if "." in name else name)].append(name)
    there = ", ".join(n for n in names if canonical_name(n.rsplit(".", 1)[0]) not in ignored) or "nothing"
    for table in wanted:
        if len(found[table]) != 1:
            raise ValueError(f"{folder}: {'no' if not found[table] else 'more than one'} table is called {table}; there is {there}")
    return {table: f"{folder.rstrip('/')}/{found[table][0]}" for table in wanted}


def choose_folder(spark: SparkSession, root: str, hint: tuple[str, ...] = ()) -> str:
    """The folder below ``root`` that holds an export: the only one that has all its tables, or the
    only one of those whose canonical name contains every word of ``hint``. Else an error lists them."""
    fit = []
    for name in [n for n in Folders(spark).names(root) if not n.startswith((".", "_"))]:
        try:
            find_exports(spark, f"{root.rstrip('/')}/{name}")
        except ValueError:
            continue
        fit.append(name)
    if not fit:
        raise ValueError(f"{root}: no folder holds {METRICS_EXPORT} and {ORDERS_EXPORT}")
    named = [n for n in fit if all(word in canonical_name(n) for word in hint)] if hint else []
    chosen = fit if len(fit) == 1 else named
    if len(chosen) != 1:
        raise ValueError(f"{root}: several folders hold an export ({', '.join(fit)}); name one of them")
    return f"{root.rstrip('/')}/{chosen[0]}"


def header_catalog(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> files that begin with it. Reads one line of each file (compressed ones too)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in spark.read.text(path).inputFiles())
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(file)
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            plain = stream if codec is None else codec.createInputStream(stream)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()

    found = defaultdict(list)
    with ThreadPoolExecutor(READERS) as pool:
        for file, line in zip(files, pool.map(first_line, files), strict=True):
            if line is not None:  # an empty file has neither columns nor rows
                found[line].append(file)
    return dict(found)


def read_csv_by_name(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """CSV cells as text under canonical column names, whatever the order of a file's columns.

    A column that a file lacks is null there. Two columns of one file with the
    same canonical name are an error. ``with_order`` adds ``_ord``: file, place
    of the split in the file, row in the split.
    """
    scans = []
    for files in header_catalog(spark, path).values():
        df = spark.read.options(header=True, inferSchema=False, enforceSchema=False, nullValue="", encoding="UTF-8").csv(files)
        names = [canonical_name(c) for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{files[0]}: columns with the same name: {', '.join(sorted(n for n in set(names) if names.count(n) > 1))}")
        own = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)]
        if with_order:
            own.append(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(ORD))
        scans.append(df.select(*own))
    if not scans:
        raise ValueError(f"{path}: no file with a header")
    return union_all(scans, allow_missing=True)
