"""Exact dedup by content-defined chunk recipes (built-in functions only).

A text, with every run of white space replaced by one space, is cut into
chunks at places that its content defines, so that equal stretches of
different texts give equal chunks. Chunks are named by their SHA-256; one
aggregation over (name, chunk) moves each distinct chunk once per map task and
verifies that no name stands for two different chunks. Texts are then compared
by their recipes, the ordered lists of verified names, which hold about 32
bytes for each chunk of some 450 characters: long documents never move again.

Defined results. Null text counts as empty; all empty texts are one group.
Of equal texts the row with the smallest doc_id stays (null ids last); of
repeated rows with that same id exactly one stays, any of them. An empty table
gives an empty result. Extra input columns are not read. A name clash (two
chunks with one SHA-256) raises an error instead of merging texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import rows_named, stored, text_rows, with_row_id

#: White-space runs that are not one plain space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: A chunk ends after 256 to 4,096 characters, at the first of: vowel, letter, space, early letter; a doubled
#: character of any script but lower-case Latin letters, spaces and common marks; a doubled lower-case letter
#: inside 48 of them without a space. Else at 4,096.
CHUNK = r"(?s).{256,4094}?(?:[aeiou][a-zß-ÿ] (?=[a-d])|([^a-zß-ÿ\x20-\x2F])\1|([a-z])\2(?=[a-z]{46}))|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, RUNS, " ")


def chunk_list(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_name(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def clashing_names(texts: DataFrame, name=chunk_name, pattern: str = CHUNK) -> DataFrame:
    """Names that stand for more than one chunk (none, unless the hash is broken)."""
    chunks = texts.select(F.explode(chunk_list(F.col("norm"), pattern)).alias("chunk"))
    distinct = chunks.select(name(F.col("chunk")).alias("name"), "chunk").groupBy("name", "chunk").agg(F.count("*").alias("uses"))
    return distinct.groupBy("name").agg(F.count("*").alias("variants")).where("variants > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name=chunk_name, pattern: str = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    texts = text_rows(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    clashes = clashing_names(texts, name, pattern).count()
    if clashes:
        raise ValueError(f"{clashes} chunk names stand for different chunks")
    recipes = with_row_id(
        texts.select(
            "doc_id",
            F.transform(chunk_list(F.col("norm"), pattern), name).alias("recipe"),
            F.sha2("norm", 256).alias("text_sha256"),
        )
    )
    recipes = stored(recipes, "recipes")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    groups = recipes.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    # only recipes that repeat are joined back; a hot one is a skewed partition that the join can split
    groups = stored(groups.where("group_size > 1"), "equal-recipes")
    alone = F.col("group_size").isNull()
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("first.row_id"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdicts = exact_dedup(docs, id_col, text_col).select("doc_id", "text_sha256", "kept")
    return rows_named(docs, verdicts, F.sha2(normalised(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256), id_col)
