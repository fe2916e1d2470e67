"""Read endpoints over small tables."""

import datetime as dt

from pyspark.sql import functions as F

from foretide.operators import endpoints as E
from foretide.operators import governance

D, T = dt.date, dt.datetime


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_card_and_signals(spark):
    opps = spark.createDataFrame([(1, "t", "open", D(2026, 1, 1), D(2026, 11, 1), None)], "opportunity_id long, title string, status string, bid_window_start date, bid_window_end date, bid_published_at date")
    recs = spark.createDataFrame([(7, 1, 0.9, "relevant"), (8, 1, 0.1, None)], "org_id long, opportunity_id long, score double, feedback string")
    (c,) = rows(E.opportunity_card(opps, recs, 7, 1, D(2026, 9, 1)))
    assert c["score"] == 0.9 and c["when"] == "2026년 9~11월"
    sig = spark.createDataFrame([(1, 10, 5, "accepted", D(2026, 1, 1), 100), (2, 10, None, "accepted", D(2026, 2, 1), 300), (3, 10, None, "rejected", D(2026, 3, 1), 1)], "id long, document_id long, chunk_id long, verdict string, observed_at date, budget_krw long")
    links = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 1, False)], "id long, opportunity_id long, tentative boolean")
    docs = spark.createDataFrame([(10, "d", D(2026, 1, 1))], "document_id long, title string, published_at date")
    chunks = spark.createDataFrame([(5, ["x"])], "chunk_id long, labels array<string>")
    assert [(r["id"], r["labels"]) for r in rows(E.opportunity_signals(sig, links, docs, chunks, 1))] == [(2, None), (1, ["x"])]
    (b,) = rows(E.budget_trajectory(sig.withColumn("opportunity_id", F.lit(1)).filter("id < 3")))
    assert (b["least"], b["most"], b["latest"], b["n"]) == (100, 300, 300, 2)


def test_overview_and_sources(spark):
    docs = spark.createDataFrame([(1, "parsed"), (2, "pending")], "document_id long, parse_status string").withColumn("published_at", F.lit("2026-01-01").cast("date"))
    chunks = spark.createDataFrame([(1, True), (2, False)], "chunk_id long, triaged boolean")
    sig = spark.createDataFrame([("accepted",), ("rejected",)], "verdict string")
    opps = spark.createDataFrame([("open",), ("closed",), ("bid_open",)], "status string")
    rev = spark.createDataFrame([("open",)], "status string")
    jobs = spark.createDataFrame([("done", T(2026, 1, 2)), ("failed", T(2026, 1, 2)), ("done", T(2025, 1, 1))], "state string, finished_at timestamp")
    (r,) = rows(E.overview(docs, chunks, sig, opps, rev, jobs, T(2026, 1, 2, 12)))
    assert r == {"documents": 2, "pending": 1, "chunks": 2, "triaged": 1, "signals": 2, "accepted": 1, "open": 2, "reviews": 1, "done_24h": 1, "failed_24h": 1}
    assert [x["document_id"] for x in rows(E.pending_documents(docs))] == [2]
    src = spark.createDataFrame([("a", 0), ("b", 4), ("c", 0)], "source string, consecutive_failures int")
    runs = spark.createDataFrame([(1, "a", "ok", T(2026, 1, 1)), (2, "a", "failed", T(2026, 1, 2)), (3, "b", "failed", T(2026, 1, 1))], "id long, source string, status string, started_at timestamp")
    assert {(x["source"], x["last_status"], x["healthy"]) for x in rows(E.source_status(src, runs))} == {("a", "failed", True), ("b", "failed", False), ("c", "never_recorded", True)}


def test_queue_pages_and_feedback(spark):
    rev = spark.createDataFrame([(1, 5, "open", T(2026, 1, 2)), (2, 6, "open", T(2026, 1, 1)), (3, 7, "done", T(2026, 1, 1))], "review_id long, signal_id long, status string, created_at timestamp")
    sig = spark.createDataFrame([(5, 1), (6, None)], "id long, chunk_id long")
    chunks = spark.createDataFrame([(1, "ctx")], "chunk_id long, text string")
    assert [(r["review_id"], r["context"]) for r in rows(E.review_queue(rev, sig, chunks))] == [(2, None), (1, "ctx")]
    led = spark.createDataFrame([(1, i) for i in range(1, 6)] + [(2, 9)], "org_id long, id long")
    assert [r["id"] for r in rows(E.own_page(led, 1, "id", 2))] == [5, 4, 3] and [r["id"] for r in rows(E.own_page(led, 1, "id", 2, after=4))] == [3, 2, 1]
    recs = spark.createDataFrame([(1, 1, None), (1, 2, "relevant")], "org_id long, opportunity_id long, feedback string")
    ev = E.feedback_event(1, 1, "dismissed", T(2026, 1, 2), spark).union(E.feedback_event(1, 1, "relevant", T(2026, 1, 1), spark))
    assert {(r["opportunity_id"], r["feedback"]) for r in rows(E.with_feedback(recs, ev))} == {(1, "dismissed"), (2, "relevant")}
    members = spark.createDataFrame([(1, 10, T(2025, 1, 1)), (1, 11, T(2026, 1, 1, 12))], "opportunity_id long, id long, linked_at timestamp")
    assert rows(governance.anchors(ev.select("opportunity_id", "at"), members)) == [{"opportunity_id": 1, "signal_ids": [10]}]


def test_scores_of_extraction_and_models(spark):
    f = "category string, commitment string, budget_krw long, expected_year int"
    gold = spark.createDataFrame([(1, "a", "planned", 100, 2026), (2, "b", None, None, None)], f"gold_id long, {f}")
    pred = spark.createDataFrame([(7, "a", "planned", 101, 2027)], f"pred_id long, {f}")
    (r,) = rows(E.extraction_scores(spark.createDataFrame([(1, 7)], "gold_id long, pred_id long"), gold, pred))
    assert (r["precision"], r["recall"], r["category"], r["budget"], r["expected_year"]) == (1.0, 0.5, 1.0, 1.0, 0.0)
    calls = spark.createDataFrame([("m", 1.0, None, 5, 1, 0.1), ("m", 3.0, "x", 5, 1, 0.1), ("m", 2.0, "x", 5, 1, 0.1)], "model string, seconds double, error string, input_tokens long, output_tokens long, usd double")
    (m,) = rows(E.model_comparison(calls))
    assert (m["cases"], m["errors"], m["p50"], m["p95"], m["error_counts"]) == (3, 2, 2.0, 3.0, [{"error": "x", "n": 2}])
    inst = spark.createDataFrame([("A", "가구", "k", "s", "g", ["나구"]), ("B", "다구", "k", "s", "g", [])], "code string, name string, kind string, sido string, sigungu string, aliases array<string>")
    assert [r["code"] for r in rows(E.institution_directory(inst, "나"))] == ["A"]
    opp = spark.createDataFrame([("bid_notice",), ("budget_line",), ("budget_line",)], "stage string")
    assert [(r["stage"], r["n"]) for r in rows(E.stage_histogram(opp))] == [("budget_line", 2), ("bid_notice", 1)]


def test_protected_snapshot_and_coverage(spark):
    docs = spark.createDataFrame([("I", "s", None, False, D(2026, 1, 1), "site", True), ("I", "s", "u", False, D(2026, 1, 2), None, False), ("J", "t", None, True, None, None, False)], "institution string, source string, raw_uri string, synthetic boolean, published_at date, published_from string, has_inline boolean")
    got = {(r["institution"], r["source"]): (r["collected"], r["raw_available"], r["undated"]) for r in rows(governance.coverage(docs, ["institution", "source"]))}
    assert got[("I", None)] == got[(None, "s")] == got[(None, None)] == (2, 1, 1)
    opps = spark.createDataFrame([(1, "I", "budget_line", "open", None, None, 0.7), (2, "J", "budget_line", "open", None, None, 0.7)], "opportunity_id long, institution string, stage string, status string, bid_window_start date, bid_window_end date, conversion_prob double")
    mem = spark.createDataFrame([(1, 10, 100, "budget_line", D(2026, 1, 1)), (2, 20, 200, "budget_line", D(2026, 1, 1))], "opportunity_id long, id long, document_id long, stage string, observed_at date")
    d = spark.createDataFrame([(100, D(2026, 1, 1)), (200, D(2026, 1, 1))], "document_id long, published_at date")
    assert [(r["record_type"], r["id"]) for r in rows(governance.forecast_snapshot(opps, mem, d, "I"))] == [("evidence", 10), ("lineage", 100), ("prediction", 1)]
    assert rows(governance.freeze_open(opps)) == [{"institution": "I", "n": 1}, {"institution": "J", "n": 1}]
    states = spark.createDataFrame([("A", 3, 3)], "institution string, generation int, reconciled int")
    new = {r["institution"]: r["generation"] for r in rows(governance.dirty(states, spark.createDataFrame([("A",), ("B",), ("A",)], "institution string")))}
    assert new == {"A": 4, "B": 1}
    mixed = mem.withColumn("verdict", F.lit("accepted")).withColumn("tentative", F.lit(False))
    assert governance.mixed_groups(mixed).count() == 0
