"""The domain operators over signals that are derived from the shared tables: orders are observations, customers the
institutions they belong to, the first part of an order names its project."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.constants import STAGES
from foretide.operators import backtest, evaluation, governance, grounding, link, market, partition, retrospective
from foretide.plans import entities
from foretide.plans.registry import registry
from foretide.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
TODAY = date(2000, 1, 1)


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as signals: stage by key, title and keywords from the first line's part, a plan number for each third."""
    parts = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    o = table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (k % 6 + 1).cast("int"))
    bid = F.when(stage == "bid_notice", F.concat(F.lit("B"), k.cast("string")))
    return o.select(
        k.alias("id"), F.col("o_custkey").cast("string").alias("institution"), (k * 10).alias("document_id"), stage.alias("stage"), F.to_date("o_orderdate").alias("observed_at"),
        F.col("p_name").alias("title"), F.lower(F.split("p_type", " ")[0]).alias("category"), F.lit(None).cast("string").alias("department"), F.col("o_totalprice").cast("long").alias("budget_krw"),
        F.when(stage == "council_mention", "planned").alias("commitment"), F.lit(None).cast("int").alias("expected_year"), F.lit(None).cast("string").alias("expected_half"),
        F.split("p_name", " ").alias("keywords"),
        F.struct(
            F.when(k % 3 == 0, F.concat(F.lit("P"), (k % 50).cast("string"))).alias("order_plan_no"), F.lit(None).cast("string").alias("prespec_no"), bid.alias("bid_notice_no"),
            F.array().cast("array<string>").alias("bid_notice_nos"), F.lit(None).cast("string").alias("cancels_bid_notice_no"),
        ).alias("refs"),
        F.lit(None).cast("array<double>").alias("embedding"), F.sha2(k.cast("string"), 256).alias("stable_key"),
    )


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Each order as one signal of its customer, with what linking looks at: titles of its least part, plan and notice
    numbers, notices that are withdrawn, departments and books of budget rows, vectors of most parts."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("pk"))
    o = table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), F.col("pk") == F.col("p_partkey"))
    k, p = F.col("o_orderkey"), F.col("pk")
    stage = F.element_at(F.array(*[F.lit(x) for x in STAGES]), (k % 6 + 1).cast("int"))
    text = lambda c: c.cast("string")
    number = F.concat(F.lit("B"), text(p % 2))
    return o.select(
        k.alias("id"), text(F.col("o_custkey")).alias("institution"), (k % 20).alias("document_id"), stage.alias("stage"), F.to_date("o_orderdate").alias("observed_at"), F.col("p_name").alias("title"),
        F.lower(F.split("p_type", " ")[0]).alias("category"), F.when(k % 4 > 0, F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (p % 3 + 1).cast("int"))).alias("department"),
        F.when(k % 5 > 0, F.floor(F.col("o_totalprice") / 1000)).cast("long").alias("budget_krw"), F.when(stage == "council_mention", "planned").alias("commitment"), F.lit(None).cast("int").alias("expected_year"),
        F.lit(None).cast("string").alias("expected_half"), F.split("p_name", " ").alias("keywords"),
        F.struct(
            F.when(k % 9 == 0, F.concat(F.lit("P"), text(k % 2))).alias("order_plan_no"), F.lit(None).cast("string").alias("prespec_no"), F.when((stage == "bid_notice") & (p % 3 > 0), number).alias("bid_notice_no"),
            F.array().cast("array<string>").alias("bid_notice_nos"), F.when((stage == "bid_notice") & (p % 3 == 0), number).alias("cancels_bid_notice_no"),
        ).alias("refs"),
        F.when(p % 4 > 0, F.array(F.lit(1.0), p % 7 / F.lit(2.0), p % 5 / F.lit(2.0), -(p % 3).cast("double"))).alias("embedding"), F.sha2(text(k), 256).alias("stable_key"),
    )


def linked(spark: SparkSession, d: str) -> DataFrame:
    s = projects(spark, d)
    return s.join(partition.canonical_partition(s).select("id", "group_key"), "id")


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    g = link.summaries(linked(spark, d), TODAY)
    return g.withColumn("institution", F.split("group_key", ":")[0]).withColumn("opportunity_id", F.xxhash64("group_key"))


@query()
def link_partition(spark, d):
    return partition.canonical_partition(projects(spark, d))


@query()
def link_summaries(spark, d):
    return link.summaries(linked(spark, d), TODAY).drop("embedding")


@query()
def link_scores(spark, d):
    """How well groups match the customers' true projects, here the titles."""
    return evaluation.pairwise_scores(linked(spark, d).withColumn("truth", F.concat_ws(":", "institution", "title")), "truth", "group_key")


@query()
def recommend_top(spark, d):
    profiles = spark.range(1, 4).select(
        F.col("id").alias("org_id"), F.array(F.lit("steel"), F.lit("blue")).alias("keywords"), F.array(F.lit("zzz")).alias("exclude_keywords"), F.array(F.lit("standard")).alias("categories"),
        F.array().cast("array<string>").alias("region_codes"), F.lit(1000).cast("long").alias("budget_min"), F.lit(200000).cast("long").alias("budget_max"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    regions = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("institution"), F.col("c_nationkey").cast("string").alias("region_code"))
    out = market.recommend(opportunities(spark, d), profiles, regions, TODAY)
    return out.select("org_id", "opportunity_id", "score", "rank")


@query()
def feed_stage_counts(spark, d):
    opps = opportunities(spark, d)
    recs = opps.select(F.lit(1).alias("org_id"), "opportunity_id", F.col("conversion_prob").alias("score"), F.lit(None).cast("string").alias("feedback"))
    return market.stage_counts(market.feed(recs, opps, 1, TODAY, status=("open", "bid_open", "closed", "dormant")))


@query()
def freeze_open_forecasts(spark, d):
    return governance.freeze_open(opportunities(spark, d).withColumn("status", F.lit("open")))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey AS opp, o_orderkey % 6 AS st, CAST(o_orderdate AS DATE) AS available FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01'),
b AS (SELECT opp, min(available) FILTER (WHERE st = 4) AS bid_at FROM s GROUP BY opp),
e AS (SELECT s.opp, b.bid_at, arg_min(available, (available, id)) AS at FROM s JOIN b USING (opp) WHERE st IN (0, 1) GROUP BY s.opp, b.bid_at)
SELECT (SELECT count(*) FROM b WHERE bid_at IS NOT NULL) AS tenders, count(*) FILTER (WHERE at < bid_at) AS with_early_signal,
  round(count(*) FILTER (WHERE at < bid_at) / (SELECT count(*) FROM b WHERE bid_at IS NOT NULL), 3) AS rate FROM e""".replace(" AS at", " AS t0").replace("at < bid_at", "t0 < bid_at"))
def backtest_early_coverage(spark, d):
    return backtest.early_coverage(backtest.per_opportunity(_dated(spark, d), TODAY))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey AS opp, o_orderkey % 6 AS st, CAST(o_orderdate AS DATE) AS av FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01'),
f AS (SELECT opp, min(av) AS first_at, arg_min(st, (av, id)) AS st, min(av) FILTER (WHERE st = 4) AS bid_at FROM s GROUP BY opp),
m AS (SELECT *, CASE WHEN bid_at > first_at AND bid_at <= first_at + 540 THEN 1 ELSE 0 END AS hit FROM f WHERE st IN (0, 1) AND first_at + 540 <= DATE '2000-01-01'),
k AS (SELECT CASE st WHEN 0 THEN 'council_mention:planned' ELSE 'budget_line:committed' END AS cohort, hit FROM m UNION ALL SELECT CASE st WHEN 0 THEN 'council_mention:*' ELSE 'budget_line:*' END, hit FROM m)
SELECT cohort, count(*) AS n, CAST(sum(hit) AS BIGINT) AS converted, round(avg(hit), 3) AS rate FROM k GROUP BY cohort""")
def backtest_conversion(spark, d):
    return backtest.cohorts(backtest.per_opportunity(_dated(spark, d), TODAY), TODAY)


def _dated(spark, d):
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (k % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("opportunity_id"), k.alias("id"), stage.alias("stage"), F.to_date("o_orderdate").alias("available"),
        F.when(stage == "council_mention", "planned").alias("commitment"), F.lit(None).cast("string").alias("cancels"),
    )


@query()
def evidence_locate(spark, d):
    """Where a quote cut from each document's middle stands in it."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr("substring(text, cast(length(text) / 2 as int), 80)").alias("quote"))
    return docs.select("doc_id", grounding.locate_quote(F.col("text"), F.col("quote")).alias("q")).select("doc_id", "q.*")


@query("""
SELECT id, CASE WHEN a < 0 OR b > length(text) OR a >= b THEN 'offsets_out_of_range' WHEN substring(text, a + 1, b - a) <> quote THEN 'text_changed' ELSE 'valid' END AS reason
FROM (SELECT doc_id AS id, text, 10 AS a, 10 + 30 + CAST(doc_id % 3 AS INTEGER) AS b, substring(text, 11, 30) AS quote FROM documents)""")
def evidence_revalidation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    span = F.struct(F.substring("text", 11, 30).alias("quote"), F.lit(10).alias("start"), (40 + F.col("doc_id") % 3).cast("int").alias("end"))
    s = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.array(span).alias("evidence"))
    return governance.evidence_revalidation(s, docs.select(F.col("doc_id").alias("document_id"), "text"))


@query(entities.ORACLE_SQL["retrospective_notices"].replace("round(score, 6) AS score", "score").replace("row_number() OVER w AS rank", "CAST(row_number() OVER w AS INTEGER) AS rank"))
def retrospective_candidates(spark, d):
    """Parts as later notices of their customers' orders: what titles share with them."""
    s = signals(spark, d)
    early = s.filter(F.col("stage").isin("council_mention", "budget_line")).select(F.col("id").alias("signal_id"), "institution", "title", "observed_at")
    late = s.filter(F.col("stage") == "bid_notice").select(F.col("id").alias("notice_id"), "institution", F.col("title").alias("notice_title"), F.col("observed_at").alias("notice_date"))
    return retrospective.notice_candidates(early, late).drop("shared")
