"""Transcripts from captions and timed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretide.operators.joins import asof, interval_overlap
from foretide.operators.ranking import runs


def turn_offsets(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Half-open character offsets of each turn in the transcript that joins them by newlines."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long")
    return df.withColumn("char_start", start).withColumn("char_end", (start + F.length(text)).cast("long"))


def caption_runs(captions: DataFrame) -> DataFrame:
    """Consecutive readings of one speaker as one span. Columns: media, t, speaker (null: nobody is named)."""
    return runs(captions, ["media"], "t", "speaker").groupBy("media", "run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.first("speaker").alias("speaker")
    )


def speakers(segments: DataFrame, captions: DataFrame, lead: str = "2 seconds") -> DataFrame:
    """Each segment (media, start timestamp, text) with the latest caption at or shortly after its start."""
    return asof(segments, captions, "media", "start", "t", ["speaker"], lead=lead)


def transcript(segments: DataFrame) -> DataFrame:
    """Turns of one speaker each, with their text and offsets. Columns: media, start, speaker, text."""
    named = runs(segments.withColumn("who", F.coalesce("speaker", F.lit("?"))), ["media"], "start", "who")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    turns = named.groupBy("media", "run").agg(F.min("start").alias("start"), F.first("speaker").alias("speaker"), F.array_join(parts, " ").alias("text"))
    return turn_offsets(turns, "media", "run", "text")


def evidence_times(evidence: DataFrame, timeline: DataFrame, width: int = 2000) -> DataFrame:
    """When evidence was said: the first and last timeline span (media, start, end in characters, t0, t1) that its
    characters overlap."""
    hit = interval_overlap(evidence, timeline, "media", width)
    return hit.groupBy(F.col("a.id").alias("id")).agg(F.min("b.t0").alias("t0"), F.max("b.t1").alias("t1"))
