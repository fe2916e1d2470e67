"""Streams over the tables' files, run to their end: what has been emitted by then is what SQL finds behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.constants import STAGES
from foretide.plans.registry import registry
from foretide.plans.scalars import pick, s
from foretide.sources import shared
from foretide.sources.tables import table
from foretide.streaming import jobs
from foretide.streaming.batch import drained, table_stream

QUERIES, ORACLE_SQL, query = registry()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("""SELECT event_id % 100 AS source, event_id // 100 AS external_id, count(DISTINCT event_type) AS versions FROM events GROUP BY 1, 2""")
def stream_deduplicated(spark, d):
    """Records that are delivered twice pass once; a changed content passes again."""
    ev = events(spark, d).select((F.col("event_id") % 100).alias("source"), F.floor(F.col("event_id") / 100).alias("external_id"), F.col("event_type").alias("content_hash"), F.col("at").alias("read_at"))
    twice = ev.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return drained(jobs.deduplicated(twice, late="60 days"), "stream-dedup").groupBy("source", "external_id").agg(F.count("*").alias("versions"))


_LAST = "(SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 1 DAY AS w FROM events)"


@query(f"""WITH x AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 15:00:00') AS day_start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1, 2)
SELECT day_start, event_type, n, total FROM x, {_LAST} WHERE day_start + INTERVAL 1 DAY <= w""")
def stream_local_days(spark, d):
    ev = events(spark, d).select("at", "event_type", F.col("event_id").alias("value"))
    return drained(jobs.daily(ev, "at", ["event_type"]), "stream-daily").withColumn("day_start", F.col("day_start").cast("timestamp_ntz"))


@query(f"""WITH x AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOUR AS "start", event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2)
SELECT "start", event_type, n FROM x, {_LAST} WHERE "start" + INTERVAL 1 DAY <= w""")
def stream_sliding_days(spark, d):
    ev = events(spark, d).select("at", "event_type")
    return drained(jobs.sliding(ev, "at", ["event_type"]), "stream-sliding").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f),
x AS (SELECT user_id, run, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM r GROUP BY 1, 2) SELECT user_id, "start", "end", n FROM x, {_LAST} WHERE "end" <= w""")
def stream_sessions(spark, d):
    out = drained(jobs.sessions(events(spark, d).select("at", "user_id"), "at", "user_id"), "stream-sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT e.user_id, e.event_id AS early_id, t.event_id AS tender_id FROM events e JOIN events t ON e.user_id = t.user_id AND t.ts > e.ts AND t.ts <= e.ts + INTERVAL 36 HOUR WHERE e.event_type = 'signup' AND t.event_type = 'purchase'""")
def stream_early_to_tender(spark, d):
    """Two streams joined by key and interval."""
    of = lambda kind, at, name: events(spark, d).filter(F.col("event_type") == kind).select("user_id", F.col("at").alias(at), F.col("event_id").alias(name))
    joined = jobs.early_to_tender(of("signup", "early_at", "early_id"), of("purchase", "tender_at", "tender_id"), "user_id", "36 hours", "60 days", ("early_id", "tender_id"))
    return drained(joined, "stream-join").select("user_id", "early_id", "tender_id")


@query("""SELECT user_id AS org_id, event_id % 7 AS opportunity_id, max(event_id % 6) AS latest FROM events GROUP BY 1, 2""")
def stream_stage_alerts(spark, d):
    """The last alert of each customer and opportunity is its latest stage."""
    k = F.col("event_id")
    rec = events(spark, d).select(F.col("user_id").alias("org_id"), (k % 7).alias("opportunity_id"), pick(k, *STAGES).alias("stage"))
    out = drained(jobs.stage_alerts(rec), "stream-alerts")
    order = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(STAGES) for x in (n, i)]), F.col("stage"))
    return out.groupBy("org_id", "opportunity_id").agg(F.max(order).cast("long").alias("latest"))


@query("""WITH p AS (SELECT user_id, min(ts) AS t, min(event_id) AS e FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id AS opportunity_id, count(*) AS rows_, max(closed) AS closed FROM
 (SELECT user_id, 0 AS closed FROM p UNION ALL SELECT user_id, 1 FROM p WHERE t + INTERVAL 21 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 1 DAY) GROUP BY 1""")
def stream_tender_status(spark, d):
    """Tenders open when they appear and close by timer 21 days of event time later."""
    ev = events(spark, d).filter("event_type = 'signup'").select(F.col("user_id").alias("opportunity_id"), "at")
    out = drained(jobs.tender_status(ev), "stream-tenders")
    return out.groupBy("opportunity_id").agg(F.count("*").alias("rows_"), F.max((F.col("status") == "closed").cast("int")).alias("closed"))


@query("""SELECT user_id::VARCHAR AS institution, count(*) AS signals, CAST(sum(value_) AS BIGINT) AS total FROM (SELECT user_id, event_id AS value_ FROM events) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def stream_converged_owners(spark, d):
    """Owners that a change touches are recomputed from all their signals, batch by batch."""
    path = shared.new_path(spark, "stream-owners")
    owner = s(F.col("user_id")).alias("institution")
    changes = events(spark, d).filter("event_type = 'error'").select(owner)
    read = lambda: table(spark, d, "events").select(owner, F.col("event_id").alias("v"))
    compute = lambda df: df.groupBy("institution").agg(F.count("*").alias("signals"), F.sum("v").alias("total"))

    def write(rows: DataFrame, owners: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number:09}")

    jobs.converge(changes, compute, read, write, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{path}/rows")
    return every.groupBy("institution").agg(F.max_by(F.struct("signals", "total"), "batch").alias("x")).select("institution", "x.*")
