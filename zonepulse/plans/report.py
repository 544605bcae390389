"""Deterministic executive report (M6) and its sink (A4).

The report is a DataFrame of ordered lines: fixed headings, one bullet per
executive-summary finding, a block for each finding of the category sections
and all their recommendations. Every data line comes from the narrated
tables, whose sizes the run's arguments set; the fixed template lines are a
small literal table.

``ord`` numbers leave room for 10^8 blocks in a section and 10^4 lines in a
block, so that lines never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.model import CATEGORIES, CATEGORY_TITLES
from zonepulse.operators.narrative import cross_cutting_recommendations, narrate
from zonepulse.plans.insights import InsightRun
from zonepulse.session import materialize
from zonepulse.sources.tables import write_report_lines

# Report headings and empty-section sentences.
REPORT_TITLE = "# Weekly Executive Insights Report"
SUMMARY_HEADING = "## Executive Summary"
CATEGORIES_HEADING = "## Key Insights by Category"
RECOMMENDATIONS_HEADING = "## Cross-Cutting Recommendations"
NO_FINDINGS = "No material findings this week."
NO_ACTIONS = "- No cross-cutting actions were identified this week."

BLOCK = 10**4
SECTION = 10**12
#: Sections: title and summary 0, the categories' heading 1, the categories from 2 on, the recommendations last.
FIRST_CATEGORY = 2
RECOMMENDATIONS = FIRST_CATEGORY + len(CATEGORIES)


def _section_of_category():
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")) - 1 + FIRST_CATEGORY


def report_lines(run: InsightRun) -> DataFrame:
    """(ord, line) rows of the markdown report."""
    spark = run.curated.sparkSession
    # used by several branches: narrated and stored once
    chosen = run.executive_summary.unionByName(run.by_category, allowMissingColumns=True)
    told = materialize(narrate(chosen))
    summary, sections = told.where("summary_ord IS NOT NULL"), told.where("category_rank IS NOT NULL")
    recs = cross_cutting_recommendations(summary, sections)

    template = [(0, REPORT_TITLE), (1, ""), (2, SUMMARY_HEADING), (SECTION, ""), (SECTION + 1, CATEGORIES_HEADING),
                (RECOMMENDATIONS * SECTION, RECOMMENDATIONS_HEADING)]
    for i, (_, title) in enumerate(CATEGORY_TITLES):
        base = (FIRST_CATEGORY + i) * SECTION
        template += [(base, ""), (base + 1, f"### {title}")]
    fixed = spark.createDataFrame(template, "ord long, line string")

    n_summary = summary.select(F.count(F.lit(1))).scalar()
    n_recs = recs.select(F.count(F.lit(1))).scalar()
    placeholders = spark.createDataFrame(
        [(3, f"- {NO_FINDINGS}", "summary"), (RECOMMENDATIONS * SECTION + 1, NO_ACTIONS, "recs")]
        + [((FIRST_CATEGORY + i) * SECTION + 2, NO_FINDINGS, cat) for i, (cat, _) in enumerate(CATEGORY_TITLES)],
        "ord long, line string, category string",
    )
    present = sections.select("category").distinct()
    empty_lines = placeholders.join(present, "category", "left_anti").filter(
        ((F.col("category") != "summary") | (n_summary == 0)) & ((F.col("category") != "recs") | (n_recs == 0))
    ).select("ord", "line")

    bullets = summary.select(
        (F.col("summary_ord").cast("long") * BLOCK).alias("ord"),
        F.concat(F.lit("- **"), F.col("title_text"), F.lit("**: "), F.col("what_happened")).alias("line"),
    )
    block_base = _section_of_category().cast("long") * SECTION + F.col("category_rank").cast("long") * BLOCK
    blocks = sections.select(
        block_base.cast("long").alias("b"),
        F.array(
            F.struct(F.lit(0).alias("k"), F.concat(F.lit("#### "), F.col("title_text")).alias("line")),
            F.struct(F.lit(1).alias("k"), F.concat(F.lit("**What happened:** "), F.col("what_happened")).alias("line")),
            F.struct(F.lit(2).alias("k"), F.concat(F.lit("**Why it matters:** "), F.col("why_it_matters")).alias("line")),
            F.struct(F.lit(3).alias("k"), F.lit("**Evidence:**").alias("line")),
            F.struct(F.lit(9000).alias("k"), F.concat(F.lit("**Recommended action:** "), F.col("recommended_action")).alias("line")),
            F.struct(F.lit(9001).alias("k"), F.lit("").alias("line")),
        ).alias("parts"),
        "evidence_lines",
    )
    block_lines = blocks.select("b", F.explode("parts").alias("p")).select(
        (F.col("b") + F.col("p.k")).alias("ord"), F.col("p.line").alias("line")
    )
    evidence = blocks.select("b", F.posexplode("evidence_lines").alias("i", "e")).select(
        (F.col("b") + 10 + F.col("i")).alias("ord"), F.concat(F.lit("- "), F.col("e")).alias("line")
    )
    rec_lines = recs.select(
        (F.lit(RECOMMENDATIONS * SECTION + 1) + F.col("rec_ord")).cast("long").alias("ord"),
        F.concat(F.lit("- "), F.col("recommendation")).alias("line"),
    )
    return fixed.unionByName(empty_lines).unionByName(bullets).unionByName(block_lines).unionByName(
        evidence).unionByName(rec_lines)


def report_text(lines: DataFrame) -> str:
    """The report as one string (its size is set by the run's arguments)."""
    rows = lines.orderBy("ord").select("line").collect()
    return "\n".join(r.line for r in rows).strip() + "\n"


def write_report(run: InsightRun, path: str) -> None:
    """A4: write the report lines as one text file."""
    write_report_lines(report_lines(run), path)
