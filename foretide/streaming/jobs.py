"""Streaming forms of the incremental operators.

Event time is when a record was published or read, never when its meeting was: minutes come out a month or two after
the meeting, and a watermark on the meeting would drop them. Each job returns the DataFrame to write, or starts a
query whose batches are idempotent, so that a restart from the checkpoint changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foretide.constants import BID_OPEN_DAYS, STAGES


def deduplicated(records: DataFrame, at: str = "read_at", late: str = "3 days") -> DataFrame:
    """Each version of a record once: the same (source, external id, content) within the overlap of two reads is
    dropped, a changed content passes."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark(["source", "external_id", "content_hash"])


def daily(events: DataFrame, at: str, keys: list[str], zone_shift: str = "15 hours", late: str = "1 day") -> DataFrame:
    """Counts and sums by local day: tumbling windows that start at 15:00 UTC, midnight in Seoul."""
    w = F.window(at, "1 day", startTime=zone_shift)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day_start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, keys: list[str], length: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = F.window(at, length, step)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's events without a silence longer than ``gap``."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def early_to_tender(early: DataFrame, tenders: DataFrame, key: str, horizon: str = "540 days", late: str = "7 days", carried: tuple[str, ...] = ()) -> DataFrame:
    """Early signals with the tenders of their entity within the horizon: an interval join of two streams, whose state
    the watermarks bound."""
    e = early.withWatermark("early_at", late).alias("e")
    t = tenders.withWatermark("tender_at", late).alias("t")
    on = F.expr(f"e.{key} = t.{key} AND tender_at > early_at AND tender_at <= early_at + interval {horizon}")
    return e.join(t, on).select(F.col(f"e.{key}").alias(key), "early_at", "tender_at", *carried)


class StageAlerts(StatefulProcessor):
    """For each (customer, opportunity): a row when it is new or its stage is later than any told before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "stage int")

    def handleInputRows(self, key, rows, timerValues):
        best = self.told.get()[0] if self.told.exists() else -1
        out = []
        for pdf in rows:
            for stage in pdf["stage"]:
                n = STAGES.index(stage)
                if n > best:
                    best = n
                    out.append((*key, stage))
        if out:
            self.told.update((best,))
        yield pd.DataFrame(out, columns=["org_id", "opportunity_id", "stage"])

    def close(self) -> None:
        pass


def stage_alerts(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("org_id", "opportunity_id").transformWithStateInPandas(
        statefulProcessor=StageAlerts(), outputStructType="org_id long, opportunity_id long, stage string", outputMode="Append", timeMode="None"
    )


class TenderStatus(StatefulProcessor):
    """A tender is bid_open when it appears and closed 21 days of event time after its earliest record, by timer. Records
    of a tender come in any order: an earlier one moves the timer of a tender that is still open."""

    CLOSED = -(2**62)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, handle.getValueState("published", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        first = min(at for pdf in rows for at in pdf["at"])
        ms = -(-pd.Timestamp(first).value // 1_000_000) + BID_OPEN_DAYS * 86_400_000
        new = []
        if not self.out.exists():
            new.append((key[0], "bid_open", pd.Timestamp(first)))
        elif ms < self.out.get()[0]:
            self.handle.deleteTimer(self.out.get()[0])
        else:
            ms = None
        if ms is not None:
            self.out.update((ms,))
            self.handle.registerTimer(ms)
        yield pd.DataFrame(new, columns=["opportunity_id", "status", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.out.update((self.CLOSED,))
        yield pd.DataFrame([(key[0], "closed", at)], columns=["opportunity_id", "status", "since"])

    def close(self) -> None:
        pass


def tender_status(tenders: DataFrame, late: str = "1 day") -> DataFrame:
    return tenders.withWatermark("at", late).groupBy("opportunity_id").transformWithStateInPandas(
        statefulProcessor=TenderStatus(), outputStructType="opportunity_id long, status string, since timestamp", outputMode="Append", timeMode="EventTime"
    )


def converge(changes: DataFrame, recompute: Callable[[DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Keep derived groups in step with arriving signals: each batch recomputes the institutions that it touches, from
    all their signals. ``read`` gives the stored signals, ``write`` replaces the results of the owners given; both see
    the batch's number, so that a repeated batch writes the same."""

    def batch(df: DataFrame, number: int) -> None:
        owners = df.select("institution").distinct().persist()
        write(recompute(read().join(owners, "institution", "left_semi")), owners, number)
        owners.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
