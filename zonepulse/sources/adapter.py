"""Test-data adapter: TPC-H-style tables → zone × week metric tables.

The driver's tables carry no zones or weeks, so they are derived:

* country = region name, city = nation name, zone = nation + '_' + market segment
* zone_type = 'Wealthy' for AUTOMOBILE / FURNITURE segments, else 'Non Wealthy'
* zone_prioritization from nation key mod 3
* week = which of nine equal periods, counted back from the newest order date
  to the oldest, the order date lies in: every order falls into weeks 0..8

Plan (scales with line items, not with zones):

1. line items are pre-aggregated per order (map-side partial aggregation,
   then one shuffle on ``l_orderkey``) into the additive pieces every metric
   needs; the big join therefore moves one row per order, not per line;
2. the per-order rows join orders on the same key (the aggregate is already
   hash-partitioned on it, so only orders are exchanged), then customers,
   whose nation/region attributes come from the two tiny dimension tables
   (broadcast by Spark's own size check);
3. one aggregation per zone × week, partial before the shuffle, so a hot
   zone holding a third of all orders still shuffles one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.session import materialize as checkpoint_once
from zonepulse.sources.tables import read_table

# Fixed values of the adapter (must equal the oracle SQL below).
WEEKS = 9
WEALTHY_SEGMENTS = ("AUTOMOBILE", "FURNITURE")
PRIORITIZATION_BY_MOD3 = ("High Priority", "Prioritized", "Not Prioritized")
LEAD_PRIORITIES = ("1-URGENT", "2-HIGH")
TURBO_PRIORITY = "1-URGENT"
METRIC_NAMES = (
    "Perfect Orders",
    "Lead Penetration",
    "Gross Profit UE",
    "Turbo Adoption",
    "Restaurants Markdowns / GMV",
)
ZONE_COLUMNS = ("country", "city", "zone", "zone_type", "zone_prioritization")
MONEY = T.DecimalType(15, 2)


def zone_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer → zone attributes (one row per customer)."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("country"), F.col("n_name").alias("city")
    )
    prio = F.col("n_nationkey") % 3
    return customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        "c_custkey",
        "country",
        "city",
        F.concat(F.col("city"), F.lit("_"), F.col("c_mktsegment")).alias("zone"),
        F.when(F.col("c_mktsegment").isin(*WEALTHY_SEGMENTS), "Wealthy")
        .otherwise("Non Wealthy")
        .alias("zone_type"),
        F.when(prio == 0, PRIORITIZATION_BY_MOD3[0])
        .when(prio == 1, PRIORITIZATION_BY_MOD3[1])
        .otherwise(PRIORITIZATION_BY_MOD3[2])
        .alias("zone_prioritization"),
    )


def _line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive per-order pieces of the line-item metrics."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_extendedprice", "l_discount", "l_tax"
    )
    # Money columns carry cents; exact decimal sums make the metric values
    # independent of summation order (partial aggregation, task layout).
    price = F.col("l_extendedprice").cast(MONEY)
    discount = F.col("l_discount").cast(MONEY)
    tax = F.col("l_tax").cast(MONEY)
    perfect = (F.col("l_returnflag") != "R").cast(T.LongType())
    profit = price * (discount - tax)
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(perfect).alias("perfect_sum"),
        F.count(perfect).alias("perfect_cnt"),
        F.sum(profit).alias("profit_sum"),
        F.count(profit).alias("profit_cnt"),
        F.sum(price * discount).alias("markdown_sum"),
        F.sum(price).alias("gmv_sum"),
    )


def zone_week_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per zone × week with every metric as a column (wide form)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    # first and last order date as scalar subqueries: evaluated once, no join
    newest = orders.select(F.max(F.to_date("o_orderdate"))).scalar()
    oldest = orders.select(F.min(F.to_date("o_orderdate"))).scalar()
    age, days = F.datediff(newest, F.to_date("o_orderdate")), F.datediff(newest, oldest) + 1
    week = F.floor(age * WEEKS / days).cast(T.IntegerType())
    dated = orders.withColumn("week", week).select("o_orderkey", "o_custkey", "week", "o_orderpriority")
    pieces = _line_pieces(spark, sf_dir)
    facts = dated.join(pieces, dated.o_orderkey == pieces.l_orderkey).join(
        zone_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")
    )
    prio_known = F.col("o_orderpriority").isNotNull()
    lines_if_known = F.when(prio_known, F.col("n_lines"))
    lead_lines = F.when(prio_known, F.when(F.col("o_orderpriority").isin(*LEAD_PRIORITIES), F.col("n_lines")).otherwise(0))
    turbo_lines = F.when(prio_known, F.when(F.col("o_orderpriority") == TURBO_PRIORITY, F.col("n_lines")).otherwise(0))
    agg = facts.groupBy(*ZONE_COLUMNS, "week").agg(
        F.sum("perfect_sum").alias("perfect_sum"),
        F.sum("perfect_cnt").alias("perfect_cnt"),
        F.sum(lead_lines).alias("lead_sum"),
        F.sum(turbo_lines).alias("turbo_sum"),
        F.sum(lines_if_known).alias("prio_cnt"),
        F.sum("profit_sum").alias("profit_sum"),
        F.sum("profit_cnt").alias("profit_cnt"),
        F.sum("markdown_sum").alias("markdown_sum"),
        F.sum("gmv_sum").alias("gmv_sum"),
        F.count(F.lit(1)).alias("n_orders"),  # o_orderkey is the key of orders
    )

    def ratio(num, den):
        den_d = F.col(den).cast(T.DoubleType())
        return F.when(den_d != 0, F.col(num).cast(T.DoubleType()) / den_d)

    return agg.select(
        *ZONE_COLUMNS,
        "week",
        ratio("perfect_sum", "perfect_cnt").alias(METRIC_NAMES[0]),
        ratio("lead_sum", "prio_cnt").alias(METRIC_NAMES[1]),
        (ratio("profit_sum", "profit_cnt") / 1000.0).alias(METRIC_NAMES[2]),
        ratio("turbo_sum", "prio_cnt").alias(METRIC_NAMES[3]),
        ratio("markdown_sum", "gmv_sum").alias(METRIC_NAMES[4]),
        F.col("n_orders").cast(T.DoubleType()).alias("Orders"),
    )


def _week_label() -> F.Column:
    return F.concat(F.lit("l"), F.col("week").cast(T.StringType()), F.lit("w"))


def metrics_long_from_facts(facts: DataFrame) -> DataFrame:
    long = facts.unpivot(
        list(ZONE_COLUMNS) + ["week"], list(METRIC_NAMES), "metric", "value"
    )
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        *ZONE_COLUMNS, "metric", "week", _week_label().alias("week_label"), "value"
    )


def orders_long_from_facts(facts: DataFrame) -> DataFrame:
    return facts.select(
        "country", "city", "zone", F.lit("Orders").alias("metric"), "week",
        _week_label().alias("week_label"), F.col("Orders").alias("value"),
    )


def zone_tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(metrics_long, orders_long) derived from the TPC-H-style tables.

    The fact table (zones × 9 weeks, independent of the line-item volume) is
    checkpointed once to the shared checkpoint folder: both tables and all
    their consumers read it, the line items are scanned once, and a lost
    executor does not send anyone back to them. ``materialize=False`` leaves
    the plan lazy; then each use scans again.
    """
    facts = zone_week_facts(spark, sf_dir)
    if materialize:
        facts = checkpoint_once(facts)
    return metrics_long_from_facts(facts), orders_long_from_facts(facts)


# ---------------------------------------------------------------------------
# The same derivation in plain SQL (DuckDB dialect) for the oracle; computed
# per line item, without the per-order pre-aggregation used above.
# ---------------------------------------------------------------------------
ORACLE_BASE_CTE = """
anchor AS (SELECT max(CAST(o_orderdate AS DATE)) AS max_date, min(CAST(o_orderdate AS DATE)) AS min_date FROM orders),
zone_orders AS (
  SELECT o.o_orderkey, o.o_orderpriority,
         r.r_name AS country, n.n_name AS city,
         n.n_name || '_' || c.c_mktsegment AS zone,
         CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'Wealthy' ELSE 'Non Wealthy' END AS zone_type,
         CASE n.n_nationkey % 3 WHEN 0 THEN 'High Priority' WHEN 1 THEN 'Prioritized' ELSE 'Not Prioritized' END AS zone_prioritization,
         CAST(floor(date_diff('day', CAST(o.o_orderdate AS DATE), (SELECT max_date FROM anchor)) * 9
              / (SELECT date_diff('day', min_date, max_date) + 1 FROM anchor)) AS INTEGER) AS week
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
zone_lines AS (
  SELECT z.*, l.l_returnflag, CAST(l.l_extendedprice AS DECIMAL(15, 2)) AS price,
         CAST(l.l_discount AS DECIMAL(15, 2)) AS disc, CAST(l.l_tax AS DECIMAL(15, 2)) AS tax
  FROM lineitem l JOIN zone_orders z ON l.l_orderkey = z.o_orderkey
),
zone_week AS (
  SELECT country, city, zone, zone_type, zone_prioritization, week,
         avg(CAST(l_returnflag <> 'R' AS DOUBLE)) AS m_perfect,
         avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE)) AS m_lead,
         CAST(sum(price * (disc - tax)) AS DOUBLE) / count(price * (disc - tax)) / 1000.0 AS m_profit,
         avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS m_turbo,
         CAST(sum(price * disc) AS DOUBLE) / nullif(CAST(sum(price) AS DOUBLE), 0) AS m_markdown,
         CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS m_orders
  FROM zone_lines
  GROUP BY country, city, zone, zone_type, zone_prioritization, week
),
metrics_long AS (
  SELECT country, city, zone, zone_type, zone_prioritization, metric, week,
         'l' || CAST(week AS VARCHAR) || 'w' AS week_label, "value"
  FROM (
    SELECT country, city, zone, zone_type, zone_prioritization, week, 'Perfect Orders' AS metric, m_perfect AS "value" FROM zone_week
    UNION ALL SELECT country, city, zone, zone_type, zone_prioritization, week, 'Lead Penetration', m_lead FROM zone_week
    UNION ALL SELECT country, city, zone, zone_type, zone_prioritization, week, 'Gross Profit UE', m_profit FROM zone_week
    UNION ALL SELECT country, city, zone, zone_type, zone_prioritization, week, 'Turbo Adoption', m_turbo FROM zone_week
    UNION ALL SELECT country, city, zone, zone_type, zone_prioritization, week, 'Restaurants Markdowns / GMV', m_markdown FROM zone_week
  ) u
  WHERE "value" IS NOT NULL AND NOT isnan("value")
),
orders_long AS (
  SELECT country, city, zone, 'Orders' AS metric, week,
         'l' || CAST(week AS VARCHAR) || 'w' AS week_label, m_orders AS "value"
  FROM zone_week
)"""
