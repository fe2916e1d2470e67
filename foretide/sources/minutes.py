"""Listings of council minutes and budget books: revisions grouped, unseen ones picked, names spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.sources.procurement import compact_date

MEETING = ("RASMBLY_ID", "RASMBLY_NUMPR", "RASMBLY_SESN", "MINTS_ODR", "MTGNM", "MTG_DE")
# Fixed table: short province names in listings.
PROVINCES = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시", "대전": "대전광역시", "울산": "울산광역시",
    "세종": "세종특별자치시", "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충남": "충청남도", "전북": "전북특별자치도", "전남": "전라남도",
    "경북": "경상북도", "경남": "경상남도", "제주": "제주특별자치도",
}


def meetings(rows: DataFrame, since, until, pattern: str | None = None) -> DataFrame:
    """One row for each meeting in the window: its key's digest, its date, its revisions newest first."""
    r = rows.withColumn("day", compact_date(F.col("MTG_DE"))).filter(F.col("day").isNotNull() & F.col("DOCID").isNotNull() & F.col("day").between(F.lit(since), F.lit(until)))
    if pattern:
        r = r.filter(F.coalesce("MTGNM", F.lit("")).rlike(pattern))
    key = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MEETING]), 256)
    g = r.withColumn("external_id", key).groupBy("external_id").agg(F.min("day").alias("day"), F.sort_array(F.collect_set(F.col("DOCID").cast("string")), asc=False).alias("revisions"))
    return g


def to_read(found: DataFrame, known: DataFrame, since, cap: int | None = None) -> DataFrame:
    """Meetings whose detail has to be read, with the revision to read: new ones in the window, known ones with a
    revision not seen before. ``known``: external_id, seen (array)."""
    j = found.join(known, "external_id", "left")
    unseen = F.filter("revisions", lambda r: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r))
    j = j.withColumn("docid", F.get(unseen, 0)).filter(F.col("docid").isNotNull() & (F.col("seen").isNotNull() | (F.col("day") >= F.lit(since))))
    j = j.select("external_id", "day", "docid", F.col("seen").isNotNull().alias("revised"))
    return j.orderBy(F.desc("day"), "external_id").limit(cap) if cap is not None else j


def split_region(region: Column, name: Column, own: str = "본청") -> Column:
    """struct(sido, name): the listing's short province spelled out, and the body's name without it."""
    full = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROVINCES.items() for x in kv]), region), region)
    bare = F.when(name.startswith(region) & (F.length(name) > F.length(region)), F.substring(name, F.length(region) + 1, F.length(name))).otherwise(name)
    return F.struct(full.alias("sido"), F.when(bare == own, F.coalesce(full, bare)).otherwise(bare).alias("name"))


def budget_facts(title: Column) -> Column:
    """struct(fiscal_year, kind, adopted_by): year and round of a budget book, and the last day it can date from."""
    year = F.regexp_extract(title, r"(20\d{2})\s*(?:년|학년|회계)", 1).try_cast("int")
    extra = title.contains("추가경정") | title.contains("추경")
    round_ = F.regexp_extract(title, r"제?\s*(\d{1,2})\s*회", 1)
    kind = (
        F.when(extra & (round_ != ""), F.concat(F.lit("제"), round_.try_cast("int").cast("string"), F.lit("회 추가경정"))).when(extra, "추가경정")
        .when(title.contains("본예산") | title.contains("예산서"), "본")
    )
    by = F.when(kind == "본", F.make_date(year - 1, F.lit(12), F.lit(31))).when(kind.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))
    return F.struct(year.alias("fiscal_year"), kind.alias("kind"), by.alias("adopted_by"))
