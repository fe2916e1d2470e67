"""Scores of extraction, linking and matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.operators.joins import interval_overlap


def pairwise_scores(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall, F1 over pairs and purity, from group sizes alone: no pair is ever built."""
    cell = df.groupBy(truth, found).agg(F.count("*").alias("n"))
    pairs = lambda g: g.agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("p"))
    both = pairs(cell).withColumnRenamed("p", "both")
    a = pairs(cell.groupBy(truth).agg(F.sum("n").alias("n"))).withColumnRenamed("p", "truth_pairs")
    by = cell.groupBy(found).agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    b = by.agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("found_pairs"), (F.sum("m") / F.sum("n")).alias("purity"))
    one = both.crossJoin(a).crossJoin(b)  # one row each
    return one.select(
        F.round(F.col("both") / F.col("found_pairs"), 6).alias("precision"),
        F.round(F.col("both") / F.col("truth_pairs"), 6).alias("recall"),
        F.round(2 * F.col("both") / (F.col("found_pairs") + F.col("truth_pairs")), 6).alias("f1"),
        F.round("purity", 6).alias("purity"),
    )


def binary_scores(df: DataFrame, truth: str, found: str) -> DataFrame:
    t, f = F.col(truth) == 1, F.col(found) == 1
    g = df.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"))
    return g.select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


def best_overlap(gold: DataFrame, predicted: DataFrame, width: int = 500) -> DataFrame:
    """Greedy match within a document: gold spans in order take the unused prediction of the largest positive
    character overlap, ties to the smaller pred_id. Columns: doc, gold_id, start, end and doc, pred_id, start, end.

    Pairs that overlap come from a join by buckets of ``width`` characters; sorted, they are gone through once, holding
    the predictions that the document at hand has used."""
    import pyarrow as pa

    pairs = interval_overlap(gold, predicted, "doc", width)
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    pairs = pairs.select(F.col("a.doc").cast("long").alias("doc"), F.col("a.gold_id").cast("long").alias("gold_id"), F.col("b.pred_id").cast("long").alias("pred_id"), shared.cast("long").alias("overlap"))

    def run(batches):
        at, used = (None, None), set()
        for b in batches:
            out = []
            for doc, g, p, n in zip(*(b.column(c).to_pylist() for c in ("doc", "gold_id", "pred_id", "overlap")), strict=True):
                if doc != at[0]:
                    at, used = (doc, None), set()
                if g != at[1] and p not in used:
                    at = (doc, g)
                    used.add(p)
                    out.append((doc, g, p, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "gold_id", "pred_id", "overlap"])

    ordered = pairs.repartition("doc").sortWithinPartitions("doc", "gold_id", F.desc("overlap"), "pred_id")
    return ordered.mapInArrow(run, "doc long, gold_id long, pred_id long, overlap long")


def maximum_matching(edges: DataFrame) -> DataFrame:
    """A maximum bipartite matching per case by augmenting paths. Columns: case, left, right."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict = {}
        for x, y in zip(pdf["left"], pdf["right"], strict=True):
            ways.setdefault(x, set()).add(y)
        taken: dict = {}

        def augment(x, seen) -> bool:
            for y in sorted(ways[x]):
                if y not in seen:
                    seen.add(y)
                    if y not in taken or augment(taken[y], seen):
                        taken[y] = x
                        return True
            return False

        for x in sorted(ways):
            augment(x, set())
        return pd.DataFrame([(pdf["case"].iloc[0], x, y) for y, x in taken.items()], columns=["case", "left", "right"])

    return edges.groupBy("case").applyInPandas(match, "case string, left string, right string")


def two_pass_match(cases: DataFrame) -> DataFrame:
    """Greedy match per case: expectations take the first unused prediction that holds their keywords in its title, then
    those left in title and keywords. Columns: case, kind (expected or predicted), id, title, words (array)."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        want = pdf[pdf["kind"] == "expected"].sort_values("id").to_dict("records")
        free = pdf[pdf["kind"] == "predicted"].sort_values("id").to_dict("records")
        out, left = [], want
        for text in (lambda p: p["title"], lambda p: " ".join([p["title"], *p["words"]])):
            rest = []
            for w in left:
                hit = next((p for p in free if all(k in text(p) for k in w["words"])), None)
                if hit is None:
                    rest.append(w)
                else:
                    free.remove(hit)
                    out.append((w["case"], w["id"], hit["id"]))
            left = rest
        return pd.DataFrame(out, columns=["case", "expected", "predicted"])

    return cases.groupBy("case").applyInPandas(match, "case string, expected long, predicted long")


def split_by_component(components: DataFrame, train: int = 80, dev: int = 10) -> DataFrame:
    """train, dev or test for each component label, by the hash of the label."""
    bucket = F.conv(F.substring(F.sha2(F.col("label").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return components.withColumn("split", F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test"))
