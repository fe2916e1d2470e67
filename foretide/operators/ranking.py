"""Ranking, runs, running totals and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order`` (which has to be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each key with their rank; Spark keeps k rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_and_runner_up(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Per key the best row (ties to the least ``tie``), the next score (0 without one), and the lead between them."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    out = df.withColumn("__n", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return out.filter("__n = 1").drop("__n").withColumn("lead", F.col(score) - F.col("runner_up"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``df`` with ``run``, the number of the row's run of equal values within its key; null closes a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    change = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).isNull() | before.isNull() | (F.col(value) != before), 1).otherwise(0)
    return df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w)).drop("__c")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value that was not null, up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_balance(df: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """``df`` with balance_after and whether it is below zero (a ledger must never be)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("balance_after", F.sum(delta).over(w)).withColumn("overdrawn", F.col("balance_after") < 0)


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The page after a row: lexicographic condition on (column, descending) keys, then the first limit + 1 rows, the
    last of which says that there are more. Spark takes it as one TakeOrderedAndProject."""
    if after is not None:
        cond, equal = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, after, strict=True):
            cond = cond | (equal & (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.filter(cond)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit + 1)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per key the most frequent value that is not null; ties go to the one seen first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), "__first", value)).alias("__b")).select(*keys, F.col(f"__b.{value}").alias(value))


def ordered_distinct(column: str, order: list[str], most: int) -> Column:
    """Aggregate: values in ``order``, each once, the first ``most``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, column)))
    return F.slice(F.array_distinct(F.transform(rows, lambda r: r[column])), 1, most)


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Per key the least value that at least a share ``q`` of the values do not exceed. Values are counted first and
    the counts summed in order, so no key's values are ever gathered."""
    w = Window.partitionBy(*keys)
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    c = c.withColumn("__upto", F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    return c.filter(F.col("__upto") >= F.ceil(F.lit(q) * F.col("__all"))).groupBy(*keys).agg(F.min(value).alias(name))
