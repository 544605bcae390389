"""Registered text queries N1–N5 over conversations and documents.

The oracle SQL states its own rules and characters. The texts are invented
prose, so the registered tags and metrics are frequent words of it, passed
through the operators' parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from zonepulse.functions.text import is_email
from zonepulse.operators import text as Tx
from zonepulse.plans.registry import register
from zonepulse.sources.tables import read_table

# white space as str.split() knows it
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{WS}+', ' ', 'g')"


TERMS = (
    ("problem_zones", ("of the", "pour la")),
    ("underperforming_zones", ("in the",)),
    ("top_performing_zones", ("de la",)),
    ("fast_growing_zones", ("und der", "und die")),
    ("quality_issue_zones", ("eeue", "elee")),
)


def _marked(conversations):
    """All turns, every seventh says that it is clarified already; and a blank
    turn more for each turn of every eleventh conversation."""
    text = F.when(F.col("turn") % 7 == 6, F.concat("text", F.lit(" CLARIFICATION: given"))).otherwise(F.col("text"))
    blank = conversations.where(F.col("conv_id") % 11 == 10).withColumn("text", F.lit(" \t "))
    return conversations.withColumn("text", text).unionByName(blank)


@register("term_tags", f"""
src AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN text || ' CLARIFICATION: given' ELSE text END AS t FROM conversations
  UNION ALL SELECT conv_id, turn, ' ' || chr(9) || ' ' FROM conversations WHERE conv_id % 11 = 10),
norm AS (SELECT conv_id, turn, {_strip('t')} AS o,
                {_squeeze("lower(regexp_replace(strip_accents(t), '[^' || chr(1) || '-' || chr(127) || ']', '', 'g'))")} AS n FROM src),
tagged AS (SELECT conv_id, turn, o,
  CASE WHEN contains(n, 'clarification:') OR o = '' THEN NULL
       WHEN contains(n, 'of the') OR contains(n, 'pour la') THEN 'problem_zones'
       WHEN contains(n, 'in the') THEN 'underperforming_zones'
       WHEN contains(n, 'de la') THEN 'top_performing_zones'
       WHEN contains(n, 'und der') OR contains(n, 'und die') THEN 'fast_growing_zones'
       WHEN contains(n, 'eeue') OR contains(n, 'elee') THEN 'quality_issue_zones' END AS tag FROM norm)
SELECT conv_id, turn, tag AS term_tag, o || CASE tag
  WHEN 'problem_zones' THEN ' Clarification: this week''s lowest Perfect Orders or Gross Profit UE'
  WHEN 'underperforming_zones' THEN ' Clarification: main metrics under the average'
  WHEN 'top_performing_zones' THEN ' Clarification: this week''s highest Perfect Orders and Gross Profit UE'
  WHEN 'fast_growing_zones' THEN ' Clarification: largest recent gain in Orders'
  WHEN 'quality_issue_zones' THEN ' Clarification: this week''s lowest Perfect Orders' ELSE '' END AS enriched_text
FROM tagged""")
def term_tags(spark, sf_dir):
    """Business-term tags of every conversation turn (accent/case-insensitive)."""
    conv = _marked(read_table(spark, sf_dir, "conversations"))
    return Tx.tag_business_terms(conv, rules=TERMS).select("conv_id", "turn", "term_tag", "enriched_text")


_FOLLOW_CTE = f"""fsrc AS (SELECT *, lower({_strip("coalesce(text, '')")}) AS c FROM conversations),
ftok AS (SELECT *, [t FOR t IN regexp_split_to_array(regexp_replace(c, '[?.]', ' ', 'g'), '{WS}+') IF t <> ''] AS toks FROM fsrc)"""
_FOLLOW = """CASE WHEN c = '' THEN false ELSE regexp_matches(c, 'what about|and|same|only|now|also|this metric|this trend|this comparison|these results|these zones|those zones|this zone|compare these')
    OR (len(toks) <= 5 AND len(list_intersect(toks, ['in', 'for', 'there', 'them', 'it'])) > 0) END"""


@register("follow_up", _FOLLOW_CTE + f"""
SELECT conv_id, turn, {_FOLLOW} AS follow_up FROM ftok""")
def follow_up(spark, sf_dir):
    """Follow-up flag of every conversation turn."""
    conv = read_table(spark, sf_dir, "conversations")
    return Tx.with_follow_up(conv).select("conv_id", "turn", "follow_up")


METRIC_WORDS = ("Of The", "De La", "Und", "Pour")


@register("carry_forward", _FOLLOW_CTE + f""",
m AS (SELECT conv_id, turn, {_FOLLOW} AS follow_up,
        CASE WHEN contains(lower(coalesce(text, '')), 'of the') THEN 'Of The' WHEN contains(lower(coalesce(text, '')), 'de la') THEN 'De La'
             WHEN contains(lower(coalesce(text, '')), 'und') THEN 'Und' WHEN contains(lower(coalesce(text, '')), 'pour') THEN 'Pour' END AS metric FROM ftok),
c AS (SELECT *, last(metric IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m)
SELECT conv_id, turn, metric, follow_up,
       CASE WHEN metric IS NOT NULL THEN metric WHEN follow_up THEN prev END AS resolved_metric FROM c""")
def carry_forward(spark, sf_dir):
    """Metric named in each turn, carried forward into follow-ups."""
    conv = read_table(spark, sf_dir, "conversations")
    found = Tx.carry_forward_metric(conv, vocabulary=METRIC_WORDS, chunk=2)
    return found.select("conv_id", "turn", "metric", "follow_up", "resolved_metric")


@register("mask_email", f"""
f AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') AS emails FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(emails, 1) AS INTEGER) AS pos, unnest(emails) AS email FROM f),
s AS (SELECT doc_id, pos, {_strip('email')} AS v FROM e)
SELECT doc_id, pos, CASE WHEN NOT contains(v, '@') THEN '***'
       ELSE CASE WHEN length(split_part(v, '@', 1)) <= 2 THEN substring(split_part(v, '@', 1), 1, 1)
                 ELSE substring(split_part(v, '@', 1), 1, 2) END || '***@' || substring(v, strpos(v, '@') + 1) END AS masked_email
FROM s""")
def mask_email(spark, sf_dir):
    """E-mail addresses found in every document, masked."""
    docs = read_table(spark, sf_dir, "documents")
    return Tx.extract_masked_emails(docs)


@register("valid_emails", r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*')) AS w0 FROM documents),
v AS (SELECT doc_id, unnest([w0, replace(w0, '.', ''), w0 || '@x.y']) AS word FROM w)
SELECT doc_id, word, regexp_full_match(word, '[^@]+@[^@]+\.[^@]+') AS valid, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY doc_id, word""")
def valid_emails(spark, sf_dir):
    """Every word with an '@' of every document, as it is, without dots and
    with a second '@', and whether it is an e-mail address."""
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*"), F.lit(0))).alias("word"))
    variants = F.array("word", F.replace("word", F.lit("."), F.lit("")), F.concat("word", F.lit("@x.y")))
    words = words.select("doc_id", F.explode(variants).alias("word"))
    return words.groupBy("doc_id", "word", is_email("word").alias("valid")).agg(F.count("*").alias("n"))


@register("preview", f"""
s AS (SELECT conv_id, turn, {_squeeze('text')} AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN length(p) <= 96 THEN p ELSE substring(p, 1, 96) || '...' END AS preview FROM s""")
def preview(spark, sf_dir):
    """96-character one-line previews of every conversation turn."""
    conv = read_table(spark, sf_dir, "conversations")
    return Tx.previews(conv, ["conv_id", "turn"])
