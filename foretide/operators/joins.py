"""Joins that SQL engines have as special forms, as equi-joins, windows and explosions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, take: list[str], lead: str | None = None, bucket: str | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the latest ``right`` row of its key at or before ``left_at`` (plus the
    interval ``lead``): one union and one window, no row pairs. Ties of ``right`` go to the greatest ``take``; null keys
    and null times meet nothing.

    ``bucket`` (a unit of ``date_trunc``) cuts the rows of a key by time, so that no key is one task: of each bucket the
    last ``right`` row is found by partial aggregation, and the last one of the buckets before is put at its start."""
    at = F.expr(f"{left_at} + interval {lead}") if lead else F.col(left_at)
    rows = left.select(F.col(key).alias("__k"), at.alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"))
    known = right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull())
    other = known.select(F.col(key).alias("__k"), F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*take).alias("__r"))
    both, parts = other.unionByName(rows), ["__k"]
    if bucket:
        parts = ["__k", "__b"]
        both = both.withColumn("__b", F.date_trunc(bucket, F.col("__t")))
        last = F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__e")
        earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*parts).agg(last).withColumn("__e", F.last("__e", ignorenulls=True).over(earlier)).filter("__e is not null")
        both = both.unionByName(carried.select("__k", "__e.__t", F.lit(0).alias("__side"), F.lit(None).alias("__l"), "__e.__r", "__b"))
    order = Window.partitionBy(*parts).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__r", F.last("__r", ignorenulls=True).over(order)).filter("__side = 1")
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in take])


def interval_overlap(a: DataFrame, b: DataFrame, key: str, width: float, a_span=("start", "end"), b_span=("start", "end")) -> DataFrame:
    """Pairs of one key whose half-open intervals overlap. Intervals are laid over buckets of ``width``, joined by
    (key, bucket), and each pair is kept in the first bucket that both reach only."""
    (a0, a1), (b0, b1) = a_span, b_span
    bucket = lambda x: F.floor(x / width)
    reach = lambda s, e: F.explode(F.sequence(bucket(F.col(s)), F.greatest(bucket(F.col(s)), F.ceil(F.col(e) / width) - 1)))
    x = a.withColumn("__b", reach(a0, a1)).alias("a")
    y = b.withColumn("__b", reach(b0, b1)).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__b") == F.col("b.__b"))
    on &= (F.col(f"a.{a0}") < F.col(f"b.{b1}")) & (F.col(f"b.{b0}") < F.col(f"a.{a1}"))
    first = F.col("a.__b") == F.greatest(bucket(F.col(f"a.{a0}")), bucket(F.col(f"b.{b0}")))
    return x.join(y, on).filter(first)


def within_days(a: DataFrame, b: DataFrame, key: str, a_at: str, b_at: str, days: int) -> DataFrame:
    """Pairs of one key at most ``days`` apart: buckets of that many days, each a-row looked up in three, so a key with
    a long history is spread over its buckets instead of joined whole."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    x = a.withColumn("__b", F.explode(F.array(*[F.floor(day(F.col(a_at)) / days) + i for i in (-1, 0, 1)]))).alias("a")
    y = b.withColumn("__b", F.floor(day(F.col(b_at)) / days)).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__b") == F.col("b.__b"))
    return x.join(y, on & (F.abs(F.datediff(F.to_date(F.col(f"a.{a_at}")), F.to_date(F.col(f"b.{b_at}")))) <= days))


def references(signals: DataFrame) -> DataFrame:
    """(id, institution, kind, value): one row for each reference number that a signal carries; a tender is named by
    its own number, by the one it cancels, and by each of a list."""
    kinds = (("order_plan_no", "plan"), ("prespec_no", "prespec"), ("bid_notice_no", "bid"), ("cancels_bid_notice_no", "bid"))
    one = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"refs.{f}").alias("value")) for f, k in kinds])
    more = F.transform(F.coalesce("refs.bid_notice_nos", F.array().cast("array<string>")), lambda v: F.struct(F.lit("bid").alias("kind"), v.alias("value")))
    rows = signals.select("id", "institution", F.explode(F.concat(one, more)).alias("r")).select("id", "institution", "r.*")
    return rows.filter("value is not null and value <> ''").distinct()


def reference_matches(signals: DataFrame, members: DataFrame) -> DataFrame:
    """Per signal: target, the one group of its institution that shares a number with it; a shared tender number
    decides between several; conflict where more than one is left. ``members`` has group_id."""
    held = references(members).join(members.select("id", "group_id"), "id").select("institution", "kind", "value", "group_id").distinct()
    found = references(signals).join(held, ["institution", "kind", "value"]).groupBy("id").agg(
        F.collect_set("group_id").alias("all"), F.collect_set(F.when(F.col("kind") == "bid", F.col("group_id"))).alias("direct")
    )
    own = F.when((F.size("all") > 1) & (F.size("direct") > 0), F.col("direct")).otherwise(F.col("all"))
    return found.select("id", F.when(F.size(own) == 1, own[0]).alias("target"), (F.size(own) > 1).alias("conflict"))


def holding(left: DataFrame, json_column: str, path: str, id_column: str, right: DataFrame, right_id: str) -> DataFrame:
    """Rows of ``right`` whose id stands in a JSON list of objects in ``left``: ids are exploded once and semi-joined."""
    ids = left.select(F.explode(F.from_json(F.get_json_object(json_column, path), f"array<struct<{id_column} bigint>>")).alias("x"))
    return right.join(ids.select(F.col(f"x.{id_column}").alias(right_id)).distinct(), right_id, "left_semi")


def is_distinct(a, b):
    return ~a.eqNullSafe(b)
