"""Insight titles, summaries and hints as column expressions.

Titles and summaries follow fixed formats: later steps depend on them (the
dedup compares the whole normalised summary; the
narrative infers direction from summary words and picks actions from title
words). Recommendation hints are this project's own wording.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Title and summary formats ({} = column value, %.2f = two
# decimals). They must equal the source application's for identical results.
#   anomalies     title   "Large WoW {direction} in {metric}"
#                 summary "{metric} in {zone} ({city}, {country}) shows a {pct*100:.2f}% week-over-week {direction}."
#                 with a sign flip the summary ends instead with
#                         " week-over-week {direction} with a sign flip; treat this as high-volatility movement."
#   trends        title   "Concerning deterioration trend in {metric}"
#                 summary "{metric} in {zone} ({city}, {country}) has deteriorated for {run} consecutive weeks."
#   benchmarking  title   "{zone} diverges from peers on {metric}"
#                 summary "{zone} is {|gap|*100:.2f}% {above|below} peer average for {metric} within comparable zones in {country}."
#   correlations  title   "{x} and {y} show a strong {positive|negative} relationship", metric "{x} vs {y}"
#                 summary "In {country}, {x} and {y} are strongly {direction} across zones (r={r:.2f})."
#   opportunities rule 1  title "Growth momentum with quality risk", metric "Orders + Perfect Orders"
#                         summary "Orders are growing quickly in {zone} while Perfect Orders are below the country median."
#                 rule 2  title "High quality with low penetration upside", metric "Perfect Orders + Lead Penetration"
#                         summary "{zone} combines strong quality with low penetration, suggesting expansion potential."
#                 rule 3  title "Replication candidate zone", metric "Gross Profit UE + Turbo Adoption"
#                         summary "{zone} is in the top decile for Gross Profit UE and above median Turbo Adoption in {country}."
# ---------------------------------------------------------------------------
OPPORTUNITY_RULES = {
    1: ("Growth momentum with quality risk", "Orders + Perfect Orders"),
    2: ("High quality with low penetration upside", "Perfect Orders + Lead Penetration"),
    3: ("Replication candidate zone", "Gross Profit UE + Turbo Adoption"),
}


def pct2(c: Column) -> Column:
    from zonepulse.functions.format import fixed

    return fixed(c, 2)


def anomaly_title(direction: Column, metric: Column) -> Column:
    return F.concat(F.lit("Large WoW "), direction, F.lit(" in "), metric)


def anomaly_summary(metric, zone, city, country, pct, direction, flip) -> Column:
    head = F.concat(metric, F.lit(" in "), zone, F.lit(" ("), city, F.lit(", "), country, F.lit(") shows a "),
                    pct2(pct * 100.0), F.lit("% week-over-week "), direction)
    return F.when(flip, F.concat(head, F.lit(" with a sign flip; treat this as high-volatility movement."))).otherwise(
        F.concat(head, F.lit("."))
    )


def trend_title(metric) -> Column:
    return F.concat(F.lit("Concerning deterioration trend in "), metric)


def trend_summary(metric, zone, city, country, run) -> Column:
    return F.concat(metric, F.lit(" in "), zone, F.lit(" ("), city, F.lit(", "), country,
                    F.lit(") has deteriorated for "), run.cast("string"), F.lit(" consecutive weeks."))


def benchmark_title(zone, metric) -> Column:
    return F.concat(zone, F.lit(" diverges from peers on "), metric)


def benchmark_summary(zone, gap, metric, country) -> Column:
    direction = F.when(gap > 0, F.lit("above")).otherwise(F.lit("below"))
    return F.concat(zone, F.lit(" is "), pct2(F.abs(gap) * 100.0), F.lit("% "), direction,
                    F.lit(" peer average for "), metric, F.lit(" within comparable zones in "), country, F.lit("."))


def correlation_title(x, y, direction) -> Column:
    return F.concat(x, F.lit(" and "), y, F.lit(" show a strong "), direction, F.lit(" relationship"))


def correlation_summary(country, x, y, direction, r) -> Column:
    return F.concat(F.lit("In "), country, F.lit(", "), x, F.lit(" and "), y, F.lit(" are strongly "), direction,
                    F.lit(" across zones (r="), pct2(r), F.lit(")."))


def opportunity_summary(rule, zone, country) -> Column:
    return (
        F.when(rule == 1, F.concat(F.lit("Orders are growing quickly in "), zone,
                                   F.lit(" while Perfect Orders are below the country median.")))
        .when(rule == 2, F.concat(zone, F.lit(" combines strong quality with low penetration, suggesting expansion potential.")))
        .otherwise(F.concat(zone, F.lit(" is in the top decile for Gross Profit UE and above median Turbo Adoption in "),
                            country, F.lit(".")))
    )


# ---------------------------------------------------------------------------
# Recommendation hints (own wording): the first rule whose word is in the
# lower-cased metric and whose direction fits; the metric "orders" itself has
# a hint of its own, all others the last one.
# ---------------------------------------------------------------------------
ANOMALY_HINT_RULES = (
    ("gross profit", "deterioration", "See which cost or discount took the margin."),
    ("gross profit", None, "See which price or cost gave the margin."),
    ("perfect orders", None, "Sort the week's failed orders by cause."),
    ("lead penetration", None, "Count the shops signed and switched on."),
    ("adoption", None, "Look at availability during the busiest hours."),
)
ANOMALY_ORDERS_HINT = "Look for events that moved demand before changing spend."
ANOMALY_DEFAULT_HINT = "Ask the zone what changed within the week."
TREND_HINT = "Start from the week in which the decline began."
BENCHMARK_HINT = "Compare this zone with the best of its group."
CORRELATION_HINT = "Watch the two numbers side by side."
OPPORTUNITY_HINTS = {
    1: "Bring quality up before adding demand.",
    2: "Add shops and customers while quality is high.",
    3: "Write down how this zone works.",
}


def anomaly_hint(metric: Column, direction: Column) -> Column:
    name = F.lower(metric)
    chosen = [
        F.when(name.contains(word) & (F.lit(True) if way is None else direction == way), F.lit(hint))
        for word, way, hint in ANOMALY_HINT_RULES
    ]
    return F.coalesce(*chosen, F.when(name == "orders", F.lit(ANOMALY_ORDERS_HINT)), F.lit(ANOMALY_DEFAULT_HINT))
