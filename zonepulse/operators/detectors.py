"""The five insight detectors (K1–K5).

All of them read week vectors: one row per zone and metric with a cell for
each week and zone type (sum and number of its values, and whether the orders
table gave it). Building them is the only pass over the long tables, one
aggregation that adds up before its shuffle; an insight run stores them once.
K1 and K2 then need no further shuffle: they fold a row's cells. All findings
are returned; a caller may ask for the first ``max_insights`` (a distributed
top-k).

Output columns: the location keys, typed evidence columns, ``severity``
(clamped, unrounded) and ``severity_score`` (two decimals).

``*_ORDER`` name the columns of each detector's order, which are unique
together: K1 and K3 go by the unrounded severity, K2, K4 and K5 by the
two-decimal score. ``in_order`` sorts by them; nothing numbers all findings in
one task (``functions.ranks.numbered`` does it in a distributed way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.functions.columns import EPS, clamp, rel_change, round2, strip_ws
from zonepulse.functions.ranks import group_quantiles
from zonepulse.model import CORRELATION_PAIRS, GEO_KEYS, LOWER_IS_BETTER

BASE_COLS = ["country", "city", "zone", "metric", "week", "value"]
G = list(GEO_KEYS)


ANOMALY_ORDER = ("-severity", "-pct_change", *G, "metric")
TREND_ORDER = ("-severity_score", *G, "metric")
BENCHMARK_ORDER = ("-severity", *G, "metric", "zone_type")
CORRELATION_ORDER = ("-severity_score", "country", "pair")
OPPORTUNITY_ORDER = ("-severity_score", "rule", *G, "zone_type")


def in_order(findings: DataFrame, order) -> DataFrame:
    """Sorted by column names; a leading minus sorts downwards, nulls come last."""
    return findings.orderBy(*[F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in order])


def _first(findings: DataFrame, order, n: int | None) -> DataFrame:
    return findings if n is None else in_order(findings, order).limit(n)


def zone_vectors(metrics_df: DataFrame, orders_df: DataFrame | None, weeks=None, metrics=None) -> DataFrame:
    """One row per (country, city, zone, metric) with ``cells``: an array of
    (week, zone_type, orders, total, n), as long as a zone's weeks and types.

    Rows with a null key or value are left out; orders carry no zone_type.
    ``weeks`` and ``metrics`` keep only those, before anything is added up.
    """

    def rows(df: DataFrame, orders: bool) -> DataFrame:
        kind = F.lit(None).cast(T.StringType()) if orders else F.col("zone_type")
        df = df.na.drop(subset=BASE_COLS)
        df = df if weeks is None else df.where(F.col("week").isin(*weeks))
        df = df if metrics is None else df.where(F.col("metric").isin(*metrics))
        return df.select(*G, "metric", F.col("week").cast("int").alias("week"), kind.alias("zone_type"), F.lit(orders).alias("orders"), "value")

    base = rows(metrics_df, False)
    if orders_df is not None:
        base = base.unionByName(rows(orders_df, True))
    cells = base.groupBy(*G, "metric", "week", "zone_type", "orders").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    cell = F.struct("week", "zone_type", "orders", "total", "n")
    return cells.groupBy(*G, "metric").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _mean(test: str, cells: str = "cells") -> str:
    """SQL: mean of the values in the cells ``c`` that pass a test, null without any."""
    add = f"aggregate(filter({cells}, c -> {test}), named_struct('t', 0D, 'n', 0L), (s, c) -> named_struct('t', s.t + c.total, 'n', s.n + c.n), s -> IF(s.n > 0, s.t / s.n, NULL))"
    return add


def _typed_values(vectors: DataFrame, test: str) -> DataFrame:
    """(G, metric, zone_type, value): the week 0 means per zone type over the cells ``c`` that pass a test."""
    here = vectors.withColumn("_here", F.expr(f"filter(cells, c -> c.week = 0 AND {test})"))
    kinds = here.select(*G, "metric", "_here", F.explode(F.expr("array_distinct(transform(_here, c -> c.zone_type))")).alias("zone_type"))
    return kinds.select(*G, "metric", "zone_type", F.expr(_mean("c.zone_type <=> zone_type", "_here")).alias("value"))


# ---------------------------------------------------------------------------
# K1 week-over-week anomalies
# ---------------------------------------------------------------------------
def detect_anomalies(
    metrics_df: DataFrame,
    orders_df: DataFrame,
    threshold: float = 0.10,
    max_insights: int | None = None,
    min_baseline: float = 0.10,
    min_abs_delta: float = 0.05,
    sign_flip_min_delta: float = 0.20,
    vectors: DataFrame | None = None,
) -> DataFrame:
    if vectors is None:
        vectors = zone_vectors(metrics_df, orders_df, weeks=(0, 1))
    g = vectors.select(*G, "metric", F.expr(_mean("c.week = 0")).alias("week_0_value"), F.expr(_mean("c.week = 1")).alias("week_1_value"))
    w0, w1 = F.col("week_0_value"), F.col("week_1_value")
    g = (
        g.filter(w0.isNotNull() & w1.isNotNull())
        .withColumn("pct_change", rel_change(w0, w1))
        .withColumn("abs_delta", F.abs(w0 - w1))
        .withColumn("baseline_abs", F.abs(w1))
        .withColumn("sign_flip", (w0 * w1) < 0)
    )
    pct, delta, baseline, flip = F.col("pct_change"), F.col("abs_delta"), F.col("baseline_abs"), F.col("sign_flip")
    g = g.filter(
        pct.isNotNull()
        & (baseline >= min_baseline)
        & (delta >= min_abs_delta)
        & (F.abs(pct) >= threshold)
        & (~flip | (delta >= sign_flip_min_delta))
    )
    points = (
        F.when(baseline >= 1.0, 2).when(baseline >= 0.35, 1).otherwise(0)
        + F.when(delta >= 0.5, 2).when(delta >= 0.2, 1).otherwise(0)
        + F.when(F.abs(pct) >= 0.4, 2).when(F.abs(pct) >= 0.2, 1).otherwise(0)
        - F.when(flip, 2).otherwise(0)
    )
    confidence = (
        F.when((baseline < 0.3) & (F.abs(pct) > 2.5), "low")
        .when(points >= 5, "high")
        .when(points >= 3, "medium")
        .otherwise("low")
    )
    g = g.withColumn("confidence", confidence).filter(F.col("confidence").isin("high", "medium"))
    severity = F.abs(pct) * 180.0 + F.least(delta, F.lit(2.0)) * 20.0
    severity = severity * F.when(flip, 0.85).otherwise(1.0)
    severity = severity * F.when(F.col("confidence") == "medium", 0.93).otherwise(1.0)
    g = g.withColumn("severity", clamp(severity, 0.0, 100.0))
    out = _first(g, ANOMALY_ORDER, max_insights)
    direction = F.when(F.col("pct_change") > 0, "improvement").otherwise("deterioration")
    return out.select(
        *G, "metric", "week_0_value", "week_1_value", "pct_change", "abs_delta", "baseline_abs",
        "sign_flip", "confidence", direction.alias("direction"), "severity",
        round2("severity").alias("severity_score"),
    )


# ---------------------------------------------------------------------------
# K2 concerning trends (longest deteriorating run; gaps-and-islands)
# ---------------------------------------------------------------------------
def detect_trends(
    metrics_df: DataFrame,
    orders_df: DataFrame | None = None,
    min_consecutive_steps: int = 3,
    max_insights: int | None = None,
    lower_is_better=LOWER_IS_BETTER,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Per zone × metric, weeks oldest → newest; a step deteriorates when
    the next week is adjacent and the value falls (rises for lower-is-better
    metrics). The longest run of such steps wins, the oldest on ties. One fold
    over a row's weeks; orders do not take part.
    """
    keys = G + ["metric"]
    if vectors is None:
        vectors = zone_vectors(metrics_df, None)
    weekly = vectors.select(*keys, F.expr("filter(cells, c -> NOT c.orders)").alias("_own")).withColumn(
        "_weeks", F.expr("sort_array(array_distinct(transform(_own, c -> c.week)), false)")
    )
    points = weekly.where(F.size("_weeks") >= 4).select(
        *keys, F.expr(f"transform(_weeks, w -> named_struct('week', w, 'value', {_mean('c.week = w', '_own')}))").alias("_points")
    )
    points = points.withColumn("higher_is_better", ~F.col("metric").isin(*lower_is_better))
    falls = "(s.at.week - p.week = 1 AND IF(higher_is_better, p.value < s.at.value, p.value > s.at.value))"
    oldest = "get(_points, 0)"
    first = f"named_struct('at', {oldest}, 'start', {oldest}, 'run', 0, 'best', named_struct('run', 0, 'start', {oldest}, 'end', {oldest}))"
    step = (
        f"named_struct('at', p, 'start', IF({falls}, s.start, p), 'run', IF({falls}, s.run + 1, 0), "
        f"'best', IF({falls} AND s.run + 1 > s.best.run, named_struct('run', s.run + 1, 'start', s.start, 'end', p), s.best))"
    )
    folded = points.withColumn("_best", F.expr(f"aggregate(slice(_points, 2, size(_points)), {first}, (s, p) -> {step}, s -> s.best)"))
    best = folded.select(
        *keys, "higher_is_better", F.col("_best.run").cast("long").alias("run_length"),
        F.col("_best.start.week").alias("start_week"), F.col("_best.end.week").alias("end_week"),
        F.col("_best.start.value").alias("start_value"), F.col("_best.end.value").alias("end_value"),
    ).filter((F.col("run_length") >= 1) & (F.col("run_length") >= min_consecutive_steps))
    net = rel_change("end_value", "start_value")
    best = (
        best.withColumn("net_change_pct", net)
        .withColumn(
            "severity",
            clamp(F.least(F.lit(100.0), F.col("run_length") * 15.0 + F.coalesce(F.abs(net) * 120.0, F.lit(0.0))), 0.0, 100.0),
        )
        .withColumn("severity_score", round2("severity"))
    )
    return _first(best, TREND_ORDER, max_insights).select(
        *keys, "run_length", "start_week", "end_week", "start_value", "end_value",
        "net_change_pct", "higher_is_better", "severity", "severity_score",
    )


# ---------------------------------------------------------------------------
# K3 peer benchmarking at week 0
# ---------------------------------------------------------------------------
def detect_benchmarking(
    metrics_df: DataFrame,
    orders_df: DataFrame,
    min_peer_count: int = 5,
    gap_threshold: float = 0.15,
    max_insights: int | None = None,
    include_untyped: bool = False,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Peer group = country × metric × zone_type; peer mean excludes the zone.

    By default rows without a zone_type (all Orders rows) drop out before
    grouping, as in the source application; ``include_untyped=True`` groups
    them into a country × metric × ALL bucket instead.

    Buckets are few and may be skewed, so the peer statistics are an
    aggregation (partial before the shuffle) joined back; AQE turns that
    join into a broadcast once the statistics' real size is known.
    """
    if vectors is None:
        vectors = zone_vectors(metrics_df, orders_df, weeks=(0,))
    snap = _typed_values(vectors, "true" if include_untyped else "c.zone_type IS NOT NULL")
    typed = F.col("zone_type").isNotNull() & (strip_ws("zone_type") != "")
    snap = snap.withColumn("peer_type", F.when(typed, F.col("zone_type")).otherwise(F.lit("ALL")))
    peers = ["country", "metric", "peer_type"]
    stats = snap.groupBy(*peers).agg(F.sum("value").alias("peer_sum"), F.count("value").alias("peer_count"))
    j = snap.join(stats, peers).filter(F.col("peer_count") >= min_peer_count)
    # twelve decimals: the last bit of a sum depends on the order of its rows, and figures are shown with four
    pm = F.round((F.col("peer_sum") - F.col("value")) / F.greatest(F.col("peer_count") - 1, F.lit(1)), 12)
    j = j.withColumn("peer_mean", pm).filter((F.col("peer_count") > 1) & (F.abs(F.col("peer_mean")) > EPS))
    j = j.withColumn("gap_pct", F.try_divide(F.col("value") - F.col("peer_mean"), F.abs(F.col("peer_mean"))))
    j = j.filter(F.abs(F.col("gap_pct")) >= gap_threshold)
    j = j.withColumn("severity", clamp(F.least(F.abs(F.col("gap_pct")) * 180.0, F.lit(100.0)), 0.0, 100.0))
    out = _first(j, BENCHMARK_ORDER, max_insights)
    return out.select(
        *G, "metric", "zone_type", F.col("value").alias("zone_value"), "peer_mean", "gap_pct",
        "peer_count", F.when(F.col("gap_pct") > 0, "above").otherwise("below").alias("direction"),
        "severity", round2("severity").alias("severity_score"),
    )


# ---------------------------------------------------------------------------
# K4 metric-pair correlations per country at week 0
# ---------------------------------------------------------------------------
def detect_correlations(
    metrics_df: DataFrame,
    orders_df: DataFrame,
    min_sample_size: int = 8,
    corr_threshold: float = 0.45,
    max_insights: int | None = None,
    pairs=CORRELATION_PAIRS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Pearson r per country and metric pair over zones having both metrics.

    One pass for all pairs: the snapshot is reshaped per zone with one
    conditional mean per metric, each zone row is exploded into one row per
    pair, and moments are aggregated per (country, pair). r is
    cov / (sd_x · sd_y) via ``try_divide`` so constant metrics give null
    (``corr`` would raise a division by zero under ANSI mode).
    """
    names = sorted({m for p in pairs for m in p})
    slot = {m: f"m{i}" for i, m in enumerate(names)}
    if vectors is None:
        vectors = zone_vectors(metrics_df, orders_df, weeks=(0,), metrics=names)
    snap = vectors.where(F.col("metric").isin(*names)).select(*G, "metric", F.expr(_mean("c.week = 0")).alias("value"))
    wide = snap.groupBy(*G).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(slot[m]) for m in names]
    )
    pair_rows = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(x).alias("metric_x"), F.lit(y).alias("metric_y"),
                 F.col(slot[x]).alias("x"), F.col(slot[y]).alias("y"))
        for i, (x, y) in enumerate(pairs)
    ])
    long = wide.select("country", F.explode(pair_rows).alias("p")).select("country", "p.*")
    long = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    stats = long.groupBy("country", "pair", "metric_x", "metric_y").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.covar_pop("x", "y").alias("cov"),
        F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"),
    )
    r = F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))
    stats = stats.withColumn("correlation", F.when((F.col("sx") > 0) & (F.col("sy") > 0), r))
    found = stats.filter(
        (F.col("sample_size") >= min_sample_size)
        & F.col("correlation").isNotNull()
        & (F.abs(F.col("correlation")) >= corr_threshold)
    )
    sev = F.least(F.lit(100.0), F.abs(F.col("correlation")) * 100.0 + F.least(F.lit(20.0), F.col("sample_size") * 0.5))
    found = found.withColumn("severity", clamp(sev, 0.0, 100.0)).withColumn("severity_score", round2("severity"))
    out = _first(found, CORRELATION_ORDER, max_insights)
    return out.select(
        "country", "pair", "metric_x", "metric_y", "correlation", "sample_size",
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
        "severity", "severity_score",
    )


# ---------------------------------------------------------------------------
# K5 opportunities (three rules)
# ---------------------------------------------------------------------------
OPPORTUNITY_METRICS = {
    "Perfect Orders": "perfect_orders", "Lead Penetration": "lead_penetration",
    "Gross Profit UE": "gross_profit_ue", "Turbo Adoption": "turbo_adoption",
}
OPPORTUNITY_QUANTILES = {
    "country_perfect_orders_median": ("perfect_orders", 0.5),
    "country_quality_p75": ("perfect_orders", 0.75),
    "country_penetration_p25": ("lead_penetration", 0.25),
    "country_gp_top_decile": ("gross_profit_ue", 0.90),
    "country_turbo_median": ("turbo_adoption", 0.5),
}


def opportunity_view(vectors: DataFrame) -> DataFrame:
    """What the three rules look at: per zone and zone type the week 0 means of
    four metrics, the quantiles of its country (by radix selection) and the
    zone's growth in orders. A zone without a metric, or without orders in week
    0 or 3, has null there, which no rule accepts. Rows without a zone_type
    drop out. Growth uses every row of the orders table (any metric)."""
    snapshot = _typed_values(vectors.where(F.col("metric").isin(*OPPORTUNITY_METRICS)), "NOT c.orders AND c.zone_type IS NOT NULL")
    means = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(a) for m, a in OPPORTUNITY_METRICS.items()]
    wide = snapshot.groupBy(*G, "zone_type").agg(*means)
    ordered = vectors.select(*G, F.explode(F.expr("filter(cells, c -> c.orders AND c.week IN (0, 3))")).alias("c"))
    sums = [F.sum(F.when(F.col("c.week") == w, F.col(f"c.{x}"))).alias(f"_{x}{w}") for w in (0, 3) for x in ("total", "n")]
    growth = ordered.groupBy(*G).agg(*sums).select(*G, rel_change(F.col("_total0") / F.col("_n0"), F.col("_total3") / F.col("_n3")).alias("orders_growth_pct"))
    view = wide.join(group_quantiles(wide, ["country"], OPPORTUNITY_QUANTILES), "country")
    return view.join(growth, G, "left")


def _ratio_excess(value: Column, ref: Column, sign: int = 1) -> Column:
    """max(0, sign·(value − ref)/|ref|), 0 when |ref| ≤ 1e-9."""
    return F.greatest(
        F.lit(0.0), F.when(F.abs(ref) > EPS, sign * (value - ref) / F.abs(ref)).otherwise(F.lit(0.0))
    )


def _opportunity_rules(min_growth: float) -> dict[int, tuple[Column, Column, tuple[str, ...]]]:
    """Rule number -> (test, severity, evidence).

    1: orders grew by ``min_growth`` or more from week 3 to week 0 while Perfect
    Orders is below the country's median. 2: Perfect Orders ≥ country p75 and
    Lead Penetration ≤ country p25. 3: Gross Profit UE ≥ country p90 and Turbo
    Adoption > country median.
    """
    c = F.col
    grown, median = c("orders_growth_pct"), c("country_perfect_orders_median")
    quality, penetration = c("country_quality_p75"), c("country_penetration_p25")
    decile, turbo = c("country_gp_top_decile"), c("country_turbo_median")
    return {
        1: (
            (grown >= min_growth) & (c("perfect_orders") < median),
            F.greatest(F.lit(0.0), grown - min_growth) * 260.0 + _ratio_excess(c("perfect_orders"), median, sign=-1) * 120.0 + 25.0,
            ("orders_growth_pct", "perfect_orders", "country_perfect_orders_median"),
        ),
        2: (
            (c("perfect_orders") >= quality) & (c("lead_penetration") <= penetration),
            30.0 + _ratio_excess(c("perfect_orders"), quality) * 120.0 + _ratio_excess(c("lead_penetration"), penetration, sign=-1) * 140.0,
            ("perfect_orders", "lead_penetration", "country_quality_p75", "country_penetration_p25"),
        ),
        3: (
            (c("gross_profit_ue") >= decile) & (c("turbo_adoption") > turbo),
            25.0 + _ratio_excess(c("gross_profit_ue"), decile) * 160.0 + _ratio_excess(c("turbo_adoption"), turbo) * 100.0,
            ("gross_profit_ue", "turbo_adoption", "country_gp_top_decile", "country_turbo_median"),
        ),
    }


def _findings(view: DataFrame, numbers, min_growth: float = 0.10) -> DataFrame:
    """The findings of some rules, all from one reading of the view."""
    rules = {k: rule for k, rule in _opportunity_rules(min_growth).items() if k in numbers}
    evidence = list(dict.fromkeys(e for _, _, names in rules.values() for e in names))
    told = []
    for number, (test, severity, names) in rules.items():
        fields = [F.when(F.lit(e in names), F.col(e)).alias(e) for e in evidence]
        finding = F.struct(F.lit(number).alias("rule"), *fields, clamp(F.least(F.lit(100.0), severity), 0.0, 100.0).alias("severity"))
        told.append(F.when(test, finding))
    each = view.select(*G, "zone_type", F.explode(F.array(*told)).alias("f")).where("f IS NOT NULL")
    return each.select("f.rule", *G, "zone_type", *[f"f.{e}" for e in evidence], "f.severity", round2("f.severity").alias("severity_score"))


def opportunity_growth_quality(metrics_df: DataFrame, orders_df: DataFrame, min_growth: float = 0.10) -> DataFrame:
    """Rule 1."""
    return _findings(opportunity_view(zone_vectors(metrics_df, orders_df, weeks=(0, 3))), (1,), min_growth)


def opportunity_quality_penetration(metrics_df: DataFrame) -> DataFrame:
    """Rule 2."""
    return _findings(opportunity_view(zone_vectors(metrics_df, None, weeks=(0,), metrics=OPPORTUNITY_METRICS)), (2,))


def opportunity_replication(metrics_df: DataFrame) -> DataFrame:
    """Rule 3."""
    return _findings(opportunity_view(zone_vectors(metrics_df, None, weeks=(0,), metrics=OPPORTUNITY_METRICS)), (3,))


def detect_opportunities(
    metrics_df: DataFrame, orders_df: DataFrame, max_insights: int | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """All findings of the three rules."""
    if vectors is None:
        vectors = zone_vectors(metrics_df, orders_df, weeks=(0, 3))
    return _first(_findings(opportunity_view(vectors), (1, 2, 3)), OPPORTUNITY_ORDER, max_insights)
