"""Reachability and connected components. Every round is a table in the shared folder: lineage stays short, and a lost
executor costs its own tasks only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.sources.shared import stored


def reachable(edges: DataFrame, most: int = 64) -> DataFrame:
    """(a, b): every b that a path of edges leads to from a. Path lengths double each round, so the rounds grow with
    the logarithm of the longest path."""
    now = edges.select("a", "b").distinct()
    n = -1
    for _ in range(most):
        now = stored(now, "paths")
        size = now.count()
        if size == n:
            return now
        n = size
        step = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        now = now.union(step).distinct()
    raise RuntimeError("paths did not settle")


def cyclic_core(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """The edges (a, b) that lie on a cycle or between two: nodes that nothing leads to, or that lead nowhere, are peeled
    off with their edges until none is left. No paths are held; rounds grow with the longest path outside of cycles, half
    of it as both ends are peeled, and each leaves a smaller table."""
    now = stored(edges.select("a", "b").distinct(), "core")
    n = now.count()
    for _ in range(rounds):
        kept = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        now, before = stored(kept, "core"), n
        n = now.count()
        if n in (0, before):
            return now
    raise RuntimeError("the core did not settle")


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node that each is connected with, by minimum labels and pointer jumping."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = stored(both, "edges")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    before = None
    for _ in range(rounds):
        state = label.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return label
        before = state
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        low = label.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
        up = low.select(F.col("node").alias("u"), F.col("label").alias("jump"))
        jumped = low.join(up, F.col("label") == F.col("u"), "left").select("node", F.coalesce("jump", "label").alias("label"))
        label = stored(jumped, "labels")
    raise RuntimeError("labels did not settle")
