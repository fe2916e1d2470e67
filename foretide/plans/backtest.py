"""Cohort conversion of early signals: first public signal per entity, tenders within a horizon, censoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.sources.tables import table

HORIZON_DAYS = 10


def backtest_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cohort key (``stage:*`` and ``stage:level``): entities, conversions within the horizon and their rate.

    An entity is a user; its first non-purchase event is the early signal, its first purchase the tender.
    Entities whose horizon ends after the data do are censored. One aggregation per entity, one explode of
    two cohort keys, one aggregation per key: two shuffles, both behind map-side partial aggregates.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    early = F.when(F.col("event_type") != "purchase", F.struct("ts", "event_id", "event_type", "value"))
    per = ev.groupBy("user_id").agg(
        F.min(early).alias("first"),
        F.collect_set(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("tenders"),
    )
    end = ev.agg(F.max("ts").alias("data_end"))
    per = per.filter("first is not null").crossJoin(F.broadcast(end))
    per = per.filter(F.expr(f"first.ts + interval {HORIZON_DAYS} days <= data_end"))
    hit = F.expr(f"exists(tenders, t -> t > first.ts and t <= first.ts + interval {HORIZON_DAYS} days)")
    level = F.when(F.col("first.value") >= 50, "high").otherwise("low")
    stage = F.col("first.event_type")
    keyed = per.select(
        F.explode(F.array(F.concat(stage, F.lit(":*")), F.concat(stage, F.lit(":"), level))).alias("cohort"),
        hit.cast("int").alias("hit"),
    )
    return keyed.groupBy("cohort").agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("converted"),
        F.round(F.sum("hit") / F.count("*"), 4).alias("rate"),
    )


QUERIES = {"backtest_cohorts": backtest_cohorts}
ORACLE_SQL = {
    "backtest_cohorts": f"""
WITH early AS (
  SELECT user_id, arg_min(event_type, (ts, event_id)) AS stage, arg_min(value, (ts, event_id)) AS value, min(ts) AS t0
  FROM events WHERE event_type <> 'purchase' GROUP BY user_id),
kept AS (SELECT * FROM early WHERE t0 + INTERVAL {HORIZON_DAYS} DAY <= (SELECT max(ts) FROM events)),
scored AS (
  SELECT k.*, EXISTS (SELECT 1 FROM events e WHERE e.user_id = k.user_id AND e.event_type = 'purchase'
    AND e.ts > k.t0 AND e.ts <= k.t0 + INTERVAL {HORIZON_DAYS} DAY)::INT AS hit FROM kept k),
keyed AS (
  SELECT stage || ':*' AS cohort, hit FROM scored
  UNION ALL SELECT stage || ':' || CASE WHEN value >= 50 THEN 'high' ELSE 'low' END, hit FROM scored)
SELECT cohort, count(*) AS n, CAST(sum(hit) AS BIGINT) AS converted, round(sum(hit) / count(*), 4) AS rate
FROM keyed GROUP BY cohort"""
}
