"""One named DataFrame function for each read endpoint; every tenant's data is filtered by ``org_id`` first."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.functions.timing import month_span, remaining_window, stage_order
from foretide.operators.governance import latest_runs
from foretide.operators.ranking import keyset_page, nearest_rank


def opportunity_card(opportunities: DataFrame, recommendations: DataFrame, org_id: int, opportunity_id: int, today: date) -> DataFrame:
    """The card of one opportunity: its summary, the customer's score and feedback, what is left of its window."""
    o = opportunities.filter(F.col("opportunity_id") == opportunity_id)
    r = recommendations.filter((F.col("org_id") == org_id) & (F.col("opportunity_id") == opportunity_id)).select("opportunity_id", "score", "feedback")
    left = remaining_window(F.col("bid_window_start"), F.col("bid_window_end"), F.lit(today).cast("date"), F.col("bid_published_at"))
    return o.join(r, "opportunity_id", "left").withColumn("left", left).withColumn("when", F.when(F.col("left.start").isNotNull(), month_span(F.col("left.start"), F.col("left.end"))))


def opportunity_signals(signals: DataFrame, links: DataFrame, documents: DataFrame, chunks: DataFrame, opportunity_id: int) -> DataFrame:
    """Accepted signals of one opportunity with document and, where there is one, chunk; latest first."""
    own = links.filter((F.col("opportunity_id") == opportunity_id) & ~F.col("tentative")).select("id")
    s = signals.join(own, "id", "left_semi").filter("verdict = 'accepted'")
    return s.join(documents.select("document_id", F.col("title").alias("document_title"), "published_at"), "document_id").join(chunks.select("chunk_id", "labels"), "chunk_id", "left").orderBy(F.desc("observed_at"), F.desc("id"))


def budget_trajectory(signals: DataFrame) -> DataFrame:
    """Least, greatest and latest amount of each opportunity, and how many named one."""
    s = signals.filter("budget_krw > 0")
    return s.groupBy("opportunity_id").agg(F.min("budget_krw").alias("least"), F.max("budget_krw").alias("most"), F.max_by("budget_krw", F.struct("observed_at", "id")).alias("latest"), F.count("*").alias("n"))


def overview(documents: DataFrame, chunks: DataFrame, signals: DataFrame, opportunities: DataFrame, reviews: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """The funnel in one row: documents, chunks and those triaged in, accepted signals, open opportunities, open reviews,
    jobs done and failed in a day. Each table is read once; the parts are one row each."""
    day = F.col("finished_at") >= F.lit(now) - F.expr("interval 1 day")
    parts = [
        documents.agg(F.count("*").alias("documents"), F.count_if(F.col("parse_status") == "pending").alias("pending")), chunks.agg(F.count("*").alias("chunks"), F.count_if("triaged").alias("triaged")),
        signals.agg(F.count("*").alias("signals"), F.count_if(F.col("verdict") == "accepted").alias("accepted")), opportunities.agg(F.count_if(F.col("status").isin("open", "bid_open")).alias("open")),
        reviews.agg(F.count_if(F.col("status") == "open").alias("reviews")), jobs.agg(F.count_if(day & (F.col("state") == "done")).alias("done_24h"), F.count_if(day & (F.col("state") == "failed")).alias("failed_24h")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def source_status(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with its last run; a source that failed three times in a row is unhealthy."""
    last = latest_runs(runs).select("source", F.col("status").alias("last_status"), F.col("started_at").alias("last_run_at"))
    return sources.join(last, "source", "left").withColumn("last_status", F.coalesce("last_status", F.lit("never_recorded"))).withColumn("healthy", F.col("consecutive_failures") < 3)


def review_queue(reviews: DataFrame, signals: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Open reviews, oldest first, with what they are about."""
    q = reviews.filter("status = 'open'").orderBy("created_at", "review_id").limit(limit)
    return q.join(signals, q["signal_id"] == signals["id"]).join(chunks.select("chunk_id", F.col("text").alias("context")), "chunk_id", "left").orderBy("created_at", "review_id")


def pending_documents(documents: DataFrame, limit: int = 200) -> DataFrame:
    return documents.filter("parse_status = 'pending'").orderBy("published_at", "document_id").limit(limit)


def own_page(rows: DataFrame, org_id: int, key: str, limit: int, after=None) -> DataFrame:
    """A customer's latest rows by a descending key: ledger 30, payments 20, evaluations 50, root jobs 20."""
    return keyset_page(rows.filter(F.col("org_id") == org_id), [(key, True)], (after,) if after is not None else None, limit)


def institution_directory(institutions: DataFrame, q: str | None = None) -> DataFrame:
    found = institutions if not q else institutions.filter(F.col("name").contains(q) | F.exists("aliases", lambda a: F.contains(a, F.lit(q))))
    return found.select("code", "name", "kind", "sido", "sigungu").orderBy("code")


def feedback_event(org_id: int, opportunity_id: int, feedback: str, at, spark) -> DataFrame:
    """The event that a customer's feedback appends; anchors are taken from these (``governance.anchors``)."""
    return spark.createDataFrame([(org_id, opportunity_id, feedback, at)], "org_id long, opportunity_id long, feedback string, at timestamp")


def with_feedback(recommendations: DataFrame, events: DataFrame) -> DataFrame:
    """Recommendations with the latest feedback of their events."""
    last = events.groupBy("org_id", "opportunity_id").agg(F.max_by("feedback", "at").alias("fresh"))
    return recommendations.join(last, ["org_id", "opportunity_id"], "left").withColumn("feedback", F.coalesce("fresh", "feedback")).drop("fresh")


def extraction_scores(matched: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and field accuracies of an extraction: ``matched`` has gold_id and pred_id; both sides have
    category, commitment, budget_krw, expected_year."""
    side = lambda df, key, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("category", "commitment", "budget_krw", "expected_year")])
    m = matched.join(side(gold, "gold_id", "g"), "gold_id").join(side(predicted, "pred_id", "p"), "pred_id")
    same = lambda c: F.round(F.avg(F.col(f"g_{c}").eqNullSafe(F.col(f"p_{c}")).cast("double")), 4).alias(c)
    near = F.col("g_budget_krw").eqNullSafe(F.col("p_budget_krw")) | (F.abs(F.col("g_budget_krw") - F.col("p_budget_krw")) / F.greatest("g_budget_krw", "p_budget_krw") <= 0.01)
    hits = m.agg(F.count("*").alias("hits"), same("category"), same("commitment"), same("expected_year"), F.round(F.avg(F.coalesce(near, F.lit(False)).cast("double")), 4).alias("budget"))
    n = gold.agg(F.count("*").alias("gold")).crossJoin(predicted.agg(F.count("*").alias("predicted")))
    out = hits.crossJoin(n)
    return out.withColumn("precision", F.round(F.col("hits") / F.col("predicted"), 4)).withColumn("recall", F.round(F.col("hits") / F.col("gold"), 4))


def model_comparison(calls: DataFrame) -> DataFrame:
    """By model: cases, errors, tokens, cost, median and nearest-rank 95th percentile latency, histogram of errors. What
    is gathered is one entry for each kind of error."""
    g = calls.groupBy("model").agg(
        F.count("*").alias("cases"), F.count("error").alias("errors"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("usd").alias("usd"),
        F.percentile("seconds", 0.5).alias("p50"),
    )
    kinds = calls.filter("error is not null").groupBy("model", "error").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("error", "n"))).alias("error_counts"))
    return g.join(nearest_rank(calls, ["model"], "seconds", 0.95, "p95"), "model", "left").join(kinds, "model", "left")


def root_jobs(jobs: DataFrame, org_id: int, limit: int = 20, before: int | None = None) -> DataFrame:
    """A customer's jobs that no other started, latest first."""
    return own_page(jobs.filter("parent_id is null"), org_id, "id", limit, before)


def stage_histogram(opportunities: DataFrame) -> DataFrame:
    return opportunities.groupBy("stage").agg(F.count("*").alias("n")).orderBy(stage_order(F.col("stage")))
