"""Streams whose records of a key come in any order."""

from datetime import timedelta

from test_streaming import run, stream, t

from foretide.streaming import jobs


def test_a_tender_closes_by_its_earliest_record(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda n: t(24 * n)
    # 1: the later record stands first in its batch. 2: an earlier one comes a batch later. The watermark ends at day 45, which
    # is 21 days after 3, and a thousandth of a second less after 4.
    batches = [[(1, day(40)), (1, day(2)), (2, day(40))], [(2, day(11))], [(3, day(24)), (4, day(24) + timedelta(milliseconds=1)), (9, day(75))]]
    got = run(spark, jobs.tender_status(stream(spark, tmp_path, batches, "opportunity_id long, at timestamp"), "30 days"), tmp_path, "order")
    assert sorted(r["opportunity_id"] for r in got if r["status"] == "bid_open") == [1, 2, 3, 4, 9]
    assert sorted((r["opportunity_id"], r["since"]) for r in got if r["status"] == "closed") == [(1, day(23)), (2, day(32)), (3, day(45))]
