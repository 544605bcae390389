"""How filters that are applied one after another interact: every order of them, step by step.

A document's failures are one bit mask, so a part of the corpus (a source) is
at most 2^n mask cells, however many documents it has. A recursive CTE extends
prefixes of filters by each unused letter: a level joins the part's cells,
carries the bits applied so far, and emits the metrics of the step that it has
just taken. Prefixes, not orders, are walked: 325 a part for five filters, and
the 120 orders share them.

Only the marks of a document (id, part, digest, mask) leave the task that reads
its text. Copies are found by the smallest doc_id of each digest: a grouping
that adds up before its shuffle, joined back on (digest, doc_id), so that a
text held by a third of all rows is one row there and spread here.

Defined results: a null text is empty, a null part is the empty string (one part
with the empty one). A null doc_id is smaller than none and greater than none:
such rows fail no copy filter and cause none, and have no labels. Rows that
repeat an id with an equal text count each, and none is a copy of the other.
Where ``labels`` repeats an id, one row with the label is enough. Texts of any
length are read whole, inside one row. An empty table has no part and so no
row. Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored

#: Letters of the text filters and, last, of the filter of copies.
COPIES = "E"
MOST_FILTERS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """Letter of each text filter and whether ``text`` fails it.

    A: under 200 words; B: fewer distinct words than half the words; C: over
    two in a hundred characters are A-Z; D: holds one of ``#$%&*|``.
    """
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask) a row: the text filters that it fails, and its text's SHA-256."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): per part the masks that occur, each with its documents, good ones and toxic ones."""
    copy_bit = 1 << len(text_failures(F.lit("")))
    rows = marked.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    firsts = marked.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    )
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        rows.join(firsts, ["doc_id", "digest"], "left")
        .join(given, "doc_id", "left")
        .withColumn("mask", F.col("mask") + F.when(copy, copy_bit).otherwise(0))
        .groupBy("part", "mask")
        .agg(
            F.sum("rows").alias("n"),
            F.sum(F.when(F.col("good") == 1, F.col("rows")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic") == 1, F.col("rows")).otherwise(0)).alias("toxic"),
        )
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    )


#: {total}: sum of one field over a part's cells that meet a condition on their mask.
WALK = """
WITH RECURSIVE walk AS (
  SELECT part, '' AS prefix, '' AS letter, 0 AS applied, 0 AS step, 0L AS kept, 0L AS removed, 0L AS redundant,
         0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {cells}
  UNION ALL
  SELECT w.part, concat(w.prefix, w.next.letter), w.next.letter, w.applied | w.next.bit, w.step + 1,
         {kept}, {removed}, {redundant}, {unique_fails}, {good_lost}, {toxic_lost}
  FROM (
    SELECT part, prefix, applied, step, explode(filter({filters}, f -> (f.bit & applied) = 0)) AS next
    FROM walk WHERE step < {steps}
  ) w JOIN {cells} c ON c.part = w.part
)
SELECT * FROM walk WHERE step > 0
"""


def _total(field: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + IF({condition}, x.{field}, 0L))"


def walk(parts: DataFrame, letters: str) -> DataFrame:
    """One row per part and prefix of filters: the metrics of the prefix's last step."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"one to {MOST_FILTERS} different letters are needed, not {letters!r}")
    spark = parts.sparkSession
    here = "(x.mask & w.applied) = 0 AND (x.mask & w.next.bit) > 0"
    text = WALK.format(
        cells="{cells}",
        kept=_total("n", "(x.mask & (w.applied | w.next.bit)) = 0"),
        removed=_total("n", here),
        redundant=_total("n", "(x.mask & w.applied) > 0 AND (x.mask & w.next.bit) > 0"),
        unique_fails=_total("n", "x.mask = w.next.bit"),
        good_lost=_total("good", here),
        toxic_lost=_total("toxic", here),
        filters="array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters)) + ")",
        steps=len(letters),
    )
    return spark.sql(text, cells=parts)


def orders(walked: DataFrame, letters: str) -> DataFrame:
    """Every part, order and step, from the prefixes; ``shapley`` sums a filter's removals over all orders."""
    n = len(letters)
    completions = F.expr(f"CAST(factorial({n} - step) AS BIGINT)")  # orders that begin with the prefix
    shapley = walked.groupBy("part", "letter").agg(F.sum(F.col("removed") * completions).alias("shapley"))
    full = walked.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"))
    steps = full.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    return (
        steps.withColumn("prefix", F.expr("left(filter_order, step)"))
        .join(walked.drop("step", "applied"), ["part", "prefix"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """All orders of the filters A-E over every part of ``docs``, a row a step (see the module's docstring)."""
    spark = docs.sparkSession
    letters = "".join(text_failures(F.lit(""))) + COPIES
    parts = stored(cells(stored(marks(docs, part_col=part_col), "marks"), labels), "cells")
    limit = "spark.sql.cteRecursionRowLimit"  # rows grow with the parts; levels are as many as filters
    before = spark.conf.get(limit, None)
    try:
        spark.conf.set(limit, "-1")
        walked = stored(walk(parts, letters), "walk")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
    return orders(walked, letters)
