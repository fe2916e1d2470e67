"""Idempotent upserts, caches, and the reasons why rows are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], content: str = "content_hash") -> DataFrame:
    """The table after an upsert, with ``action``: created, updated (content changed, parsing starts over), skipped
    (same content), kept (not in this batch). Of several incoming rows of a key the last by ``seq`` counts."""
    new = incoming.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in keys]), "seq").alias("n"))
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("o"))
    both = old.join(new, keys, "full")
    action = (
        F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "created")
        .when(F.col(f"o.{content}") == F.col(f"n.{content}"), "skipped").otherwise("updated")
    )
    fresh = F.col("action").isin("created", "updated")
    columns = [c for c in stored.columns if c not in keys]
    pick = lambda c: F.when(fresh, F.col(f"n.{c}") if c in incoming.columns else F.lit("pending") if c == "parse_status" else F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c)
    return both.withColumn("action", action).select(*keys, *[pick(c) for c in columns], "action")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored, one a key."""
    return incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row fails; null where it passes all."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def listing_filter(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, number of rows by reason)."""
    marked = rows.withColumn("reason", first_reason(rules))
    return marked.filter("reason is null").drop("reason"), marked.groupBy("reason").agg(F.count("*").alias("n"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def replace_recommendations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recommendations after a refresh: new scores keep their feedback; old ones that fell out stay only where the
    customer has acted on them or been told of them."""
    keys = ["org_id", "opportunity_id"]
    o = old.select(*keys, F.col("score").alias("old_score"), "feedback", "feedback_at", "notified_stage")
    both = new.select(*keys, "score").join(o, keys, "full")
    acted = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("feedback", "feedback_at", "notified_stage")])
    return both.filter(F.col("score").isNotNull() | acted).select(*keys, F.coalesce("score", "old_score").alias("score"), "feedback", "feedback_at", "notified_stage")


def merged_properties(a: Column, b: Column) -> Column:
    """Two string maps as one, the second winning."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
