"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text (white space deleted) is cut into chunks at places that depend only on the characters around them. Equal
chunks get one identifier, a document becomes the ordered list of its chunk identifiers, and two documents are equal
when their lists are. Texts never move between executors: a chunk is known by its SHA-256 and verified by a second,
independent hash and its length, all three of which must agree. What is shuffled is a few dozen bytes for each chunk of
about a kilobyte. The digest of the whole text is returned, but decides nothing.

Defined cases: null text counts as empty, all empty texts are one group; null ``doc_id`` comes after all others when
the row that stays is chosen, and among repeated rows the first read stays; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import SPACES, stored

#: A chunk ends before the first of these character sequences past its least size, or at its largest size.
MIN_CHUNK, MAX_CHUNK = 768, 8192
BOUNDARY = r"[eaio][rstnl][^a-z]|[^\w][^\w]"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?={BOUNDARY})|.{{1,{MAX_CHUNK}}}"


def chunked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: rid, doc_id, n_chars, text_sha256 and the ordered digests of its chunks (stored)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.length(whole).cast("long").alias("n_chars"),
        F.translate(whole, SPACES, "").alias("norm"),
    )
    digest = lambda c: F.struct(
        F.unhex(F.sha2(c, 256)).alias("sha"), F.xxhash64(c).alias("check"), F.length(c).alias("len")
    )
    return stored(
        cut.select(
            "rid", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)), digest).alias("digests"),
        ),
        "chunks",
    )


def recipes(listed: DataFrame) -> DataFrame:
    """``listed`` with ``recipe``, the ordered identifiers: an identifier is where its chunk was first seen."""
    occurs = listed.select("rid", F.posexplode("digests").alias("seq", "d")).select("rid", "seq", "d.*")
    # Stored, so that the join below has plain exchanges on both sides and a chunk of a third of all documents is split.
    ids = stored(occurs.groupBy("sha", "check", "len").agg(F.min(F.struct("rid", "seq")).alias("id")), "chunk-ids")
    lists = (
        occurs.join(ids, ["sha", "check", "len"])
        .groupBy("rid")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("recipe"))
    )
    return listed.drop("digests").join(lists, "rid", "left")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest id.
    """
    listed = stored(recipes(chunked(docs, text, doc_id)), "recipes")
    # A missing recipe is that of an empty text. Equal lists: one group, pre-aggregated in each task.
    key = ["recipe"]
    listed = listed.withColumn("recipe", F.coalesce("recipe", F.array().cast(listed.schema["recipe"].dataType)))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = listed.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    # Only texts that occur again are looked up; stored, so that a group of a third of all rows is split by the join.
    own = listed.join(stored(groups, "groups"), key, "left").withColumn("alone", F.col("group_size").isNull())
    return own.select(
        "doc_id",
        F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("alone") | (F.col("rid") == F.col("best.rid"))).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
