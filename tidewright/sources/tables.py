"""Series drawn from the star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    by = Window.partitionBy("series_id").orderBy(*order)
    return rows.withColumn("t", F.row_number().over(by).cast("long") - 1)


def v_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, value: monthly revenue of each return flag in millions; cents are summed exactly."""
    rows = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)
    rows = rows.groupBy(F.col("l_returnflag").alias("series_id"), F.trunc("l_shipdate", "month").alias("m")).agg((F.sum(cents) / F.lit(1e8)).alias("value"))
    return _numbered(rows, "m").select("series_id", "t", "value")


V_MONTH = """v_month AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY m) - 1 AS t, value FROM (
    SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate) AS m,
           CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) / 1e8::DOUBLE AS value
    FROM lineitem GROUP BY 1, 2))"""


def v_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, value: daily revenue of all lines ('ship') and daily order totals ('order'); t is the day."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)
    ship = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg((F.sum(cents) / F.lit(1e8)).alias("value"))
    order = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum(F.floor(F.col("o_totalprice") * 100)) / F.lit(1e8)).alias("value"))
    both = ship.select(F.lit("ship").alias("series_id"), "*").union(order.select(F.lit("order").alias("series_id"), "*"))
    return both.select("series_id", F.datediff("d", F.lit("1992-01-01").cast("date")).cast("long").alias("t"), "value")


V_DAY = """v_day AS (
  SELECT 'ship' AS series_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
         CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) / 1e8::DOUBLE AS value
  FROM lineitem GROUP BY 1, 2
  UNION ALL
  SELECT 'order', CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT),
         CAST(sum(CAST(floor(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 1e8::DOUBLE
  FROM orders GROUP BY 1, 2)"""


def v_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, value: the events of each type in the order of ts, event_id."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return _numbered(rows, "ts", "event_id").select("series_id", "t", "value")


V_EVENT = """v_event AS (
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value FROM events)"""


def v_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, value: how many events of each type each hour has, hours without any as 0."""
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 3600).alias("h"))
    ends = rows.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    # One row for each type, and one for the ends of all hours.
    grid = rows.select("event_type").distinct().join(F.broadcast(ends)).select("event_type", F.explode(F.sequence("a", "b")).alias("h"), "a")
    counts = rows.groupBy("event_type", "h").agg(F.count("*").alias("n"))
    out = grid.join(counts, ["event_type", "h"], "left")
    return out.select(F.col("event_type").alias("series_id"), (F.col("h") - F.col("a")).alias("t"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))


V_HOUR = """v_hour AS (
  SELECT g.event_type AS series_id, g.h - g.a AS t, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (
    SELECT event_type, a, unnest(range(a, b + 1)) AS h FROM (SELECT DISTINCT event_type FROM events),
      (SELECT min(CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS a, max(CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS b FROM events)) g
  LEFT JOIN (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2) c
    ON g.event_type = c.event_type AND g.h = c.h)"""



def v_evid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hid, seq, likelihood_ratio: the events of each user as evidence; ratios follow from the type's place by name."""
    rows = table(spark, sf_dir, "events")
    ratio = F.get(F.array(*[F.lit(x) for x in (1.2, 0.85, 1.1, 0.95, 1.0)]), F.pmod(F.length("event_type") + F.ascii("event_type"), F.lit(5)))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("hid"), F.row_number().over(by).alias("seq"), ratio.alias("likelihood_ratio"))


V_EVID = """v_evid AS (
  SELECT user_id AS hid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         [1.2::DOUBLE, 0.85, 1.1, 0.95, 1.0][1 + (len(event_type) + ascii(event_type)) % 5]::DOUBLE AS likelihood_ratio FROM events)"""
