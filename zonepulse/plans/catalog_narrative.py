"""Registered narrative queries M1–M7 with oracle SQL, whose texts and rules are written out here once more."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonepulse.functions.columns import squeeze
from zonepulse.functions.format import format_metric_value
from zonepulse.model import DEFAULT_DISPLAY, METRIC_DISPLAY
from zonepulse.operators import narrative as N
from zonepulse.plans.catalog_curation import INSIGHTS_CTE, _run
from zonepulse.plans.insights import collect_insights
from zonepulse.plans.registry import register
from zonepulse.plans.report import report_lines
from zonepulse.sources.adapter import zone_tables


def _sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _num(x: str, decimals: int = 4) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE regexp_replace(regexp_replace(printf('%.{decimals}f', {x}), '0+$', ''), '[.]$', '') END")


def _pct(x: str) -> str:
    return f"printf('%.2f%%', CAST({x} AS DOUBLE) * 100.0)"


_M = f"lower({_sq('metric')})"
_FAMILY = f"""CASE WHEN contains({_M}, 'gross profit') THEN 'margin' WHEN contains({_M}, 'perfect orders') THEN 'quality'
  WHEN contains({_M}, 'lead penetration') THEN 'penetration' WHEN contains({_M}, 'adoption') THEN 'adoption'
  WHEN contains({_M}, 'markdown') THEN 'cost_pressure' WHEN contains({_M}, 'orders') THEN 'demand' ELSE 'general' END"""


@register("metric_family", INSIGHTS_CTE + f"""
SELECT insight_id, metric, {_FAMILY} AS family FROM ins""")
def metric_family(spark, sf_dir):
    """M1: metric family of every finding's metric."""
    m, o = zone_tables(spark, sf_dir)
    ins = collect_insights(m, o)
    return ins.select("insight_id", "metric", N.metric_family(squeeze(F.col("metric"))).alias("family"))


_LINES = {
    "anomalies": [
        f"'Previous value: ' || {_num('week_1_value')}", f"'Current value: ' || {_num('week_0_value')}",
        f"'Week-over-week change: ' || {_pct('pct_change')}", f"'Absolute change: ' || {_num('abs_delta')}",
        f"CASE WHEN {_sq('confidence')} <> '' THEN 'Confidence: ' || upper(substring({_sq('confidence')}, 1, 1)) || lower(substring({_sq('confidence')}, 2)) END",
        "CASE WHEN coalesce(sign_flip, false) THEN 'Sign stability: Value crossed zero (high volatility)' END",
    ],
    "trends": [
        f"'Deterioration streak: ' || {_num('run_length')} || ' weeks'",
        f"'Start point: Week ' || {_num('start_week')} || ' at ' || {_num('start_value')}",
        f"'End point: Week ' || {_num('end_week')} || ' at ' || {_num('end_value')}",
        f"CASE WHEN net_change_pct IS NOT NULL THEN 'Net change over streak: ' || {_pct('net_change_pct')} END",
    ],
    "benchmarking": [
        f"'Zone value: ' || {_num('zone_value')}", f"'Peer average: ' || {_num('peer_mean')}",
        f"'Peer gap vs average: ' || {_pct('gap_pct')}", f"'Peer sample size: ' || {_num('peer_count')}",
    ],
    "correlations": [
        "'Metric pair: ' || metric_x || ' and ' || metric_y",
        f"'Correlation strength: r=' || coalesce({_num('correlation', 2)}, '') || ' (' || CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END || ')'",
        f"'Sample size: ' || {_num('sample_size')} || ' zones'",
    ],
    "opportunities": [
        f"'Orders growth (week 3 to week 0): ' || {_pct('orders_growth_pct')}",
        f"'Perfect Orders: ' || {_num('perfect_orders')}",
        f"'Country median Perfect Orders: ' || {_num('country_perfect_orders_median')}",
        f"'Lead Penetration: ' || {_num('lead_penetration')}",
        f"'Country P75 Perfect Orders: ' || {_num('country_quality_p75')}",
        f"'Country P25 Lead Penetration: ' || {_num('country_penetration_p25')}",
        f"'Gross Profit UE: ' || {_num('gross_profit_ue')}",
        f"'Country top decile Gross Profit UE: ' || {_num('country_gp_top_decile')}",
        f"'Turbo Adoption: ' || {_num('turbo_adoption')}",
        f"'Country median Turbo Adoption: ' || {_num('country_turbo_median')}",
    ],
}


def _lines_of(category: str) -> str:
    return f"[x FOR x IN [{', '.join(_LINES[category])}] IF x IS NOT NULL]"


_EVIDENCE = ("ev AS (" + " UNION ALL ".join(f"SELECT insight_id, {_lines_of(c)} AS lst FROM ins WHERE category = '{c}'" for c in _LINES)
             + ")\nSELECT insight_id, CAST(generate_subscripts(lst, 1) AS INTEGER) AS line_no, unnest(lst) AS line FROM ev")


@register("evidence_lines", INSIGHTS_CTE + ",\n" + _EVIDENCE)
def evidence_lines(spark, sf_dir):
    """M4: evidence lines of every finding (number and percentage formats)."""
    m, o = zone_tables(spark, sf_dir)
    ins = N.narrate(collect_insights(m, o))
    return ins.select("insight_id", F.posexplode("evidence_lines").alias("pos", "line")).select(
        "insight_id", (F.col("pos") + 1).alias("line_no"), "line")


_DIRECTION = f"""CASE WHEN {_sq('direction')} <> '' THEN {_sq('direction')}
  WHEN category = 'benchmarking' AND gap_pct > 0 THEN 'outperformance'
  WHEN category = 'benchmarking' AND gap_pct <= 0 THEN 'underperformance'
  WHEN category = 'correlations' AND correlation > 0 THEN 'positive'
  WHEN category = 'correlations' AND correlation <= 0 THEN 'negative'
  WHEN regexp_matches(lower(summary), 'deteriorat|declin') THEN 'deterioration'
  WHEN regexp_matches(lower(summary), 'improv|growth') THEN 'improvement' ELSE 'change' END"""

_WHY = """CASE category
  WHEN 'anomalies' THEN
    CASE WHEN direction_inferred = 'deterioration' AND family = 'margin' THEN 'Earnings per order in this zone shrank within one week.'
         WHEN direction_inferred = 'deterioration' AND family = 'quality' THEN 'More orders than usual went wrong here this week, and customers notice that first.'
         WHEN direction_inferred = 'deterioration' AND family IN ('adoption', 'penetration', 'demand') THEN 'Fewer customers or shops were reached here than a week ago.'
         WHEN direction_inferred = 'improvement' THEN 'Something here worked better than last week; other zones could learn what.'
         ELSE 'One week changed this number a lot; find out whether it is real.' END
  WHEN 'trends' THEN
    CASE family WHEN 'quality' THEN 'Quality has slipped week after week, so a single bad day does not explain it.'
                WHEN 'margin' THEN 'Each of the last weeks earned less than the one before.'
                ELSE 'The number has moved the wrong way for several weeks in a row.' END
  WHEN 'benchmarking' THEN
    CASE direction_inferred WHEN 'underperformance' THEN 'Similar zones in the country do better with the same offer.'
                            WHEN 'outperformance' THEN 'Similar zones in the country do worse with the same offer.'
                            ELSE 'Similar zones in the country show clearly other numbers.' END
  WHEN 'correlations' THEN
    CASE direction_inferred WHEN 'negative' THEN 'Where one of the two numbers is high, the other tends to be low.'
                            ELSE 'Where one of the two numbers is high, the other tends to be high as well.' END
  WHEN 'opportunities' THEN
    CASE WHEN family IN ('demand', 'penetration') THEN 'More orders could be won here without a new market.'
         ELSE 'The numbers of this zone leave room for a better result.' END
  ELSE 'The number is worth a look this week.' END
  || CASE WHEN category = 'anomalies' AND coalesce(sign_flip, false) THEN ' It also crossed zero, so one more week of data should confirm it.' ELSE '' END"""

_HINT = f"CASE WHEN {_sq('recommendation_hint')} <> '' THEN {_sq('recommendation_hint')} ELSE 'Decide with the team that owns the number what happens next.' END"
_ACTION = f"""CASE category
  WHEN 'anomalies' THEN
    CASE WHEN family = 'margin' AND direction_inferred = 'improvement' THEN 'Ask the zone which price or cost changed, and write it down.'
         WHEN family = 'margin' THEN 'Compare prices, discounts and costs of the two weeks line by line.'
         WHEN family = 'quality' AND direction_inferred = 'improvement' THEN 'Ask the zone what it changed and keep doing it.'
         WHEN family = 'quality' THEN 'List the failed orders of the week by cause and start with the largest.'
         WHEN family = 'penetration' THEN 'Check how many shops were signed and switched on in both weeks.'
         WHEN family = 'adoption' THEN 'Check whether couriers and shops were available at peak hours.'
         WHEN family = 'demand' THEN 'Check campaigns, holidays and outages of both weeks before reacting.'
         ELSE {_HINT} END
  WHEN 'trends' THEN
    CASE family WHEN 'quality' THEN 'Give the zone a quality target for the next two weeks and look at it daily.'
                WHEN 'margin' THEN 'Choose two cost items of the zone to bring down and review them weekly.'
                ELSE 'Name who owns the number and meet weekly until it turns.' END
  WHEN 'benchmarking' THEN
    CASE direction_inferred WHEN 'underperformance' THEN 'Visit the best zone of the group and copy one practice.'
                            ELSE 'Describe how this zone works and offer it to the weakest zone of the group.' END
  WHEN 'correlations' THEN 'Show both numbers on one chart and set targets for them together.'
  WHEN 'opportunities' THEN
    CASE WHEN contains(lower(title_text), 'quality risk') THEN 'Hold back new demand until quality is back at the country''s median.'
         WHEN contains(lower(title_text), 'low penetration') THEN 'Sign more shops and customers here first.'
         WHEN contains(lower(title_text), 'replication') THEN 'Try this zone''s way of working in two other zones.'
         ELSE 'Put a date and a name on this chance in the next plan.' END
  ELSE {_HINT} END"""

_NARRATED = f"""
narrated AS (
  SELECT *, {_WHY} AS why_it_matters, {_ACTION} AS recommended_action
  FROM (SELECT *, {_FAMILY} AS family, {_DIRECTION} AS direction_inferred,
               CASE WHEN {_sq('title')} <> '' THEN {_sq('title')} ELSE 'Untitled insight' END AS title_text
        FROM deduped)),
rec_src AS (
  SELECT n.recommended_action AS rec, d.summary_ord AS ord FROM diversity d JOIN narrated n USING (insight_id)
  UNION ALL
  SELECT n.recommended_action, 1000000 + 100000 * CASE t.category WHEN 'anomalies' THEN 0 WHEN 'trends' THEN 1
         WHEN 'benchmarking' THEN 2 WHEN 'correlations' THEN 3 ELSE 4 END + t.category_rank
  FROM top3 t JOIN narrated n USING (insight_id)),
recs AS (
  SELECT row_number() OVER (ORDER BY ord) AS rec_ord, rec FROM (SELECT rec, min(ord) AS ord FROM rec_src GROUP BY rec))"""


@register("recommendations", INSIGHTS_CTE + "," + _NARRATED + """
SELECT CAST(rec_ord AS INTEGER) AS rec_ord, rec AS recommendation FROM recs""")
def recommendations(spark, sf_dir):
    """M2, M3, M5: cross-cutting recommended actions of the report."""
    run = _run(spark, sf_dir)
    return N.cross_cutting_recommendations(N.narrate(run.executive_summary), N.narrate(run.by_category))


@register("why_it_matters", INSIGHTS_CTE + "," + _NARRATED + """
SELECT insight_id, direction_inferred, why_it_matters, recommended_action FROM narrated""")
def why_it_matters(spark, sf_dir):
    """M2 + M3: inferred direction, why it matters and the action for every curated finding."""
    run = _run(spark, sf_dir)
    return N.narrate(run.curated).select("insight_id", "direction_inferred", "why_it_matters", "recommended_action")


def _display_sql(x: str) -> str:
    fmt = "CASE metric WHEN 'Perfect Orders' THEN 'percentage_ratio' WHEN 'Orders' THEN 'integer' ELSE 'number' END"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' "
            f"WHEN {fmt} = 'integer' THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) "
            f"WHEN {fmt} = 'percentage_ratio' THEN printf('%.2f', {x} * 100.0) || '%' "
            f"ELSE printf('%.2f', {x}) END")


@register("formatted_values", f"""
allm AS (SELECT country, metric, "value" FROM metrics_long WHERE week = 0
         UNION ALL SELECT country, metric, "value" FROM orders_long WHERE week = 0),
agg AS (SELECT country, metric, avg("value") AS v FROM allm GROUP BY country, metric)
SELECT country, metric, round(v, 6) AS "value", {_display_sql('v')} AS display FROM agg""")
def formatted_values(spark, sf_dir):
    """M7: mean per country and metric at week 0, displayed by metric format."""
    m, o = zone_tables(spark, sf_dir)
    allm = m.select("country", "metric", "value", "week").unionByName(o.select("country", "metric", "value", "week"))
    agg = allm.filter(F.col("week") == 0).groupBy("country", "metric").agg(F.avg("value").alias("value"))
    fmt = F.lit(DEFAULT_DISPLAY[0])
    dec = F.lit(DEFAULT_DISPLAY[1])
    for name, (f, d) in METRIC_DISPLAY.items():
        fmt = F.when(F.col("metric") == name, F.lit(f)).otherwise(fmt)
        dec = F.when(F.col("metric") == name, F.lit(d)).otherwise(dec)
    return agg.select("country", "metric", "value", format_metric_value("value", fmt, dec).alias("display"))


_LOCATION = f"concat_ws(' | ', nullif({_sq('country')}, ''), nullif({_sq('city')}, ''), nullif({_sq('zone')}, ''))"
_HAPPENED = f"""{_sq('summary')} || CASE WHEN {_LOCATION} <> '' THEN ' Location: ' || {_LOCATION} || '.' ELSE '' END
  || CASE WHEN {_sq('metric')} <> '' THEN ' Metric: ' || {_sq('metric')} || '.' ELSE '' END"""
_CASES = " ".join(f"WHEN '{c}' THEN {_lines_of(c)}" for c in _LINES)

# ord: section * 10^12 + block * 10^4 + line; sections: 0 title and summary, 1 the
# categories' heading, 2-6 the categories, 7 the recommendations
_REPORT = f""",
narr AS (SELECT n.*, {_HAPPENED} AS what_happened, CASE category {_CASES} END AS ev FROM narrated n),
cats AS (SELECT * FROM (VALUES (2, 'anomalies', 'Anomalies'), (3, 'trends', 'Concerning Trends'), (4, 'benchmarking', 'Benchmarking'),
                               (5, 'correlations', 'Correlations'), (6, 'opportunities', 'Opportunities')) c(section, category, title)),
blocks AS (
  SELECT c.section * 1000000000000 + t.category_rank * 10000 AS b, n.*
  FROM top3 t JOIN narr n USING (insight_id) JOIN cats c ON c.category = t.category),
lines AS (
  SELECT * FROM (VALUES (0, '# Weekly Executive Insights Report'), (1, ''), (2, '## Executive Summary'), (1000000000000, ''),
                        (1000000000001, '## Key Insights by Category'), (7000000000000, '## Cross-Cutting Recommendations')) v(ord, line)
  UNION ALL SELECT section * 1000000000000, '' FROM cats
  UNION ALL SELECT section * 1000000000000 + 1, '### ' || title FROM cats
  UNION ALL SELECT 3, '- No material findings this week.' WHERE NOT EXISTS (SELECT 1 FROM diversity)
  UNION ALL SELECT 7000000000001, '- No cross-cutting actions were identified this week.' WHERE NOT EXISTS (SELECT 1 FROM recs)
  UNION ALL SELECT section * 1000000000000 + 2, 'No material findings this week.' FROM cats WHERE category NOT IN (SELECT category FROM top3)
  UNION ALL SELECT d.summary_ord * 10000, '- **' || n.title_text || '**: ' || n.what_happened FROM diversity d JOIN narr n USING (insight_id)
  UNION ALL SELECT b, '#### ' || title_text FROM blocks
  UNION ALL SELECT b + 1, '**What happened:** ' || what_happened FROM blocks
  UNION ALL SELECT b + 2, '**Why it matters:** ' || why_it_matters FROM blocks
  UNION ALL SELECT b + 3, '**Evidence:**' FROM blocks
  UNION ALL SELECT b + 9 + i, '- ' || line FROM (SELECT b, unnest(ev) AS line, generate_subscripts(ev, 1) AS i FROM blocks)
  UNION ALL SELECT b + 9000, '**Recommended action:** ' || recommended_action FROM blocks
  UNION ALL SELECT b + 9001, '' FROM blocks
  UNION ALL SELECT 7000000000001 + rec_ord, '- ' || rec FROM recs)
SELECT CAST(ord AS BIGINT) AS ord, line FROM lines"""


@register("report_lines", INSIGHTS_CTE + "," + _NARRATED + _REPORT)
def report(spark, sf_dir):
    """M6: the executive report as ordered (ord, line) rows."""
    return report_lines(_run(spark, sf_dir))
