"""Human reviews: decisions applied, links kept or redone, the review set exported and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretide.operators.evaluation import split_by_component
from foretide.operators.graph import components
from foretide.sources.shared import stored

FIELDS = ("title", "institution", "budget_krw", "expected_year", "expected_half", "commitment", "verdict", "stage", "category")


def fingerprint():
    """What of a signal a decision is about."""
    return F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)


def after_review(signals: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of reviewed signals' links: preserve, unlink, relink or link.

    A link stays when the signal is accepted and its institution unchanged, and it was set by hand, or nothing else is
    in its group, or the same content was decided before. ``decisions``: id, verdict. ``links``: id, opportunity_id,
    method, institution (of the group), fingerprint (of the last decision)."""
    size = links.groupBy("opportunity_id").agg(F.count("*").alias("members"))
    s = signals.drop("verdict").join(decisions.select("id", "verdict"), "id").withColumn("now", fingerprint())
    own = links.join(size, "opportunity_id").select("id", "opportunity_id", "method", F.col("institution").alias("owner"), F.col("fingerprint").alias("was"), "members")
    j = s.join(own, "id", "left")
    stays = (F.col("owner") == F.col("institution")) & ((F.col("method") == "manual") | (F.col("members") == 1) | (F.col("was") == F.col("now")))
    accepted = F.col("verdict") == "accepted"
    action = (
        F.when(accepted & F.coalesce(stays, F.lit(False)), "preserve").when(accepted & F.col("opportunity_id").isNotNull(), "relink")
        .when(accepted, "link").when(F.col("opportunity_id").isNotNull(), "unlink").otherwise("none")
    )
    return j.select("id", "opportunity_id", "verdict", action.alias("action"), F.col("now").alias("fingerprint"))


def review_split(samples: DataFrame) -> DataFrame:
    """train, dev or test for each sample (id, document_id, text_hash): samples that share a document or a text go
    together."""
    by = lambda c: samples.groupBy(c).agg(F.min("id").alias("b")).join(samples.select("id", c), c).select(F.col("id").alias("a"), "b")
    found = components(by("document_id").union(by("text_hash")))
    labelled = samples.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"))
    return split_by_component(labelled)


def ranked_rows(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of ``order`` (equal values by the line itself), by ranges: each range is
    numbered where it lies, from the count of those before it, of which there is one a range."""
    ranged = rows.repartitionByRange(order).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offset = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_first(order), "line"))
    return ranged.withColumn("place", place).join(F.broadcast(offset), "range").withColumn("rank", F.col("before") + F.col("place") - 1).drop("range", "place", "before")


def merkle_levels(lines: DataFrame, leaf: int = 1000, fan: int = 1000) -> list[DataFrame]:
    """Levels of (node, digest) over (rank, line), the leaves first, one root last: a leaf is the SHA-256 of the digests of
    ``leaf`` lines in their order, a node that of ``fan`` nodes. No node gathers more, and the tree hangs on ranks alone, so
    however rows lie the root is that of one sorted pass."""

    def up(df: DataFrame, at: str, digest, most: int) -> DataFrame:
        own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), digest.alias("d")))), lambda x: x["d"])
        return stored(df.groupBy(F.floor(F.col(at) / most).alias("node")).agg(F.sha2(F.concat_ws("", own), 256).alias("digest")), "digests")

    out = [up(lines, "rank", F.sha2("line", 256), leaf)]
    while out[-1].limit(2).count() > 1:
        out.append(up(out[-1], "node", F.col("digest"), fan))
    return out


def export(samples: DataFrame, fields: list[str], path: str, leaf: int = 1000, fan: int = 1000) -> DataFrame:
    """One JSON line for each sample, in the order of ``id``, as text files under ``path``/lines; then, when they are written,
    the digests of the leaves and one manifest line (samples, leaf, fan, root). Returns the manifest. Of any size: nothing
    is collected, and a part that was changed is found by its leaf."""
    rows = ranked_rows(samples.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")), "id")
    rows = stored(rows, "lines")
    rows.repartitionByRange("rank").sortWithinPartitions("rank").select(F.col("line").alias("value")).write.text(f"{path}/lines")
    levels = merkle_levels(rows, leaf, fan)
    levels[0].write.parquet(f"{path}/leaves")
    counted = rows.select(F.lit(1).alias("one"), F.lit(None).cast("string").alias("digest")).unionByName(levels[-1].select(F.lit(0).alias("one"), "digest"))
    totals = counted.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("samples"), F.max("digest").alias("root"))
    manifest = stored(totals.select("samples", F.lit(leaf).alias("leaf"), F.lit(fan).alias("fan"), "root"), "manifest")
    manifest.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/manifest")
    return manifest


def row_digests(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key the SHA-256 over its rows as JSON lines in their own order: equal digests, equal sets of rows."""
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def canonical_key(**parts):
    """SHA-256 of the parts as one JSON object, in the order given, without those that are null: a signal's key that
    does not hang on its row id or on the order of arrival."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), 256)
