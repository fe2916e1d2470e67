"""Streaming jobs over files, run to the end and compared with their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from foretide.streaming import jobs

SCHEMA = "source string, external_id string, content_hash string, read_at timestamp, value double, key long"


def t(h):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)


def stream(spark, tmp_path, batches, schema=SCHEMA):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return [r.asDict() for r in spark.table(name).collect()]


def test_overlapping_reads_are_told_by_content(spark, tmp_path):
    a = [("s", "1", "h1", t(0), 1.0, 1), ("s", "2", "h2", t(1), 1.0, 1)]
    b = [("s", "2", "h2", t(2), 1.0, 1), ("s", "1", "h9", t(3), 1.0, 1)]
    got = run(spark, jobs.deduplicated(stream(spark, tmp_path, [a, b])), tmp_path, "dedup")
    assert sorted((r["external_id"], r["content_hash"]) for r in got) == [("1", "h1"), ("1", "h9"), ("2", "h2")]


def test_windows_equal_batch(spark, tmp_path):
    data = [[("s", str(i), "h", t(i * 5), float(i), i % 2) for i in range(j, j + 8)] for j in (0, 8, 16)]
    last = [("s", "z", "h", t(24 * 60), 0.0, 0)]
    src = stream(spark, tmp_path, [*data, last])
    batch = spark.createDataFrame([r for b in data for r in b], SCHEMA)
    day = jobs.daily(src, "read_at", ["key"])
    want = batch.groupBy(F.window("read_at", "1 day", startTime="15 hours"), "key").agg(F.count("*").alias("n"))
    got = run(spark, day, tmp_path, "days")
    assert sorted((r["day_start"], r["key"], r["n"]) for r in got) == sorted((r["window"]["start"], r["key"], r["n"]) for r in want.collect())
    slide = run(spark, jobs.sliding(src, "read_at", ["key"]), tmp_path, "slides")
    assert sum(r["n"] for r in slide) == 4 * batch.count()
    ses = run(spark, jobs.sessions(src, "read_at", "key", gap="12 hours"), tmp_path, "sessions_")
    assert sum(r["n"] for r in ses) == batch.count() and len({r["key"] for r in ses}) == 2


def test_early_signals_meet_their_tenders(spark, tmp_path):
    e = stream(spark, tmp_path / "e", [[(1, t(0)), (2, t(0))], [(9, t(24 * 900))]], "k long, early_at timestamp")
    x = stream(spark, tmp_path / "x", [[(1, t(24 * 100)), (2, t(24 * 600))], [(9, t(24 * 901))]], "k long, tender_at timestamp")
    got = run(spark, jobs.early_to_tender(e, x, "k"), tmp_path, "met")
    assert sorted(r["k"] for r in got) == [1, 9]


def test_alerts_only_when_the_stage_advances(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = "org_id long, opportunity_id long, stage string"
    src = stream(spark, tmp_path, [[(1, 7, "budget_line")], [(1, 7, "council_mention"), (1, 8, "prespec")], [(1, 7, "bid_notice")]], s)
    got = run(spark, jobs.stage_alerts(src), tmp_path, "alerts")
    assert sorted((r["opportunity_id"], r["stage"]) for r in got) == [(7, "bid_notice"), (7, "budget_line"), (8, "prespec")]


def test_tenders_close_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = stream(spark, tmp_path, [[(1, t(0))], [(2, t(24 * 30))], [(3, t(24 * 31))]], "opportunity_id long, at timestamp")
    got = run(spark, jobs.tender_status(src), tmp_path, "status")
    assert {(r["opportunity_id"], r["status"]) for r in got} == {(1, "bid_open"), (2, "bid_open"), (3, "bid_open"), (1, "closed")}


def test_owners_converge(spark, tmp_path):
    s = "id long, institution string, value long"
    src = stream(spark, tmp_path, [[(1, "A", 1), (2, "B", 1)], [(3, "A", 5)]], s)
    store: dict = {"rows": [], "sums": {}}

    def read():
        return spark.read.schema(s).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def write(result, owners, number):
        store["rows"].append(sorted(r["institution"] for r in owners.collect()))
        store["sums"] |= {r["institution"]: r["v"] for r in result.collect()}

    q = jobs.converge(src, lambda df: df.groupBy("institution").agg(F.sum("value").alias("v")), read, write, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and store["sums"] == {"A": 6, "B": 1} and store["rows"][-1] == ["A"]
