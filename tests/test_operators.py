"""Resolution, evidence, linking, back-test, market, governance on small inputs."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from foretide.operators import accounts, backtest, crawl, evaluation, fuzzy, governance, graph, grounding, ingest, joins, link, market, media, partition, ranking, resolve, retrospective
from foretide.sources import html, minutes, procurement, readers, world

D = dt.date


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- fuzzy, evidence ----------------------------------------------------------------------------------------------
def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequence_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(20))) for _ in range(2))
        assert fuzzy.subsequence(a, b) == brute_lcs(a, b)
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.only_grows("시설개선", "시설개선공사") and not fuzzy.only_grows("중원수련관", "수정수련관")


def test_quotes_are_found_where_they_stand():
    source = "의장:  내년도  본예산에 3억원을 반영하겠습니다. 끝"
    found, score, a, b, how = grounding.locate(source, "내년도 본예산에 3억원을 반영하겠습니다")
    assert found and how == "exact" and score == 100 and source[a:b] == "내년도  본예산에 3억원을 반영하겠습니다"
    found, score, a, b, how = grounding.locate(source, "내년도 본예산에 3억원을 반영하겠읍니다")
    assert found and how == "fuzzy" and 88 <= score < 100 and "3억원" in source[a:b]
    assert not grounding.locate(source, "전혀 다른 이야기입니다")[0] and not grounding.locate(source, "끝")[0]


def test_statements_leave_out_questions_reports_and_quotations():
    speech = "설치합니까? 설치하겠다고 말씀하셨습니다. 내년에 설치하겠습니다. \"추진하겠습니다\" 좋은 말이네요."
    assert grounding.statements(speech, 0, len(speech)) == ["내년에 설치하겠습니다."]
    assert grounding.commitment_issue(["내년에 추진하지 않겠습니다 분명히."], "committed") == "commitment_denied"
    assert grounding.commitment_issue(["예산이 확보되면 추진하겠습니다."], "committed") == "commitment_conditional"
    assert grounding.commitment_issue(["내년 예산에 반영하겠습니다 꼭."], "committed") is None and grounding.commitment_issue([], "reviewing") is None


def test_official_evidence():
    doc = "○이두리 의원  설치를 추진하겠습니다 라고 하셨죠.\n○교통과장 박세찌  내년도 예산에 반영하겠습니다.\n○최네모 위원  네.\n"
    at = doc.index("내년도")
    assert grounding.official_issue(doc, [(at, at + 16)], "committed") is None
    assert grounding.official_issue(doc, [(0, 20)], "committed") == "official_evidence_missing"


def test_verdicts(spark):
    ok, bad = {"found": True}, {"found": False}
    data = [(1, [ok], None, None, None, None, None, 0.9), (2, [], None, None, None, None, None, 0.9), (3, [ok, bad], None, None, None, None, None, 0.9), (4, [ok], 100, None, None, None, None, 0.9), (5, [ok], 100, 90, False, 2026, 2027, 0.1)]
    df = spark.createDataFrame(data, "id int, ev array<struct<found boolean>>, b long, p long, a boolean, y int, r int, c double")
    got = {r["id"]: r["v"] for r in rows(df.select("id", grounding.verdict(*[F.col(c) for c in ("ev", "b", "p", "a", "y", "r", "c")]).alias("v")))}
    assert got[1]["verdict"] == "accepted" and got[2] == {"issues": ["evidence_not_found"], "verdict": "rejected"} and got[3]["issues"] == ["partial_evidence"]
    assert got[4]["issues"] == ["budget_unsupported"] and got[5]["issues"] == ["budget_mismatch", "year_unverified", "low_confidence"]


# --- resolution ---------------------------------------------------------------------------------------------------
def test_resolution_cascade(spark):
    reg = spark.createDataFrame(
        [("A", "부산광역시 해운대구", "local_gov", "부산광역시", "해운대구", ["해운대구청"]), ("B", "대전광역시 중구", "local_gov", "대전광역시", "중구", []), ("C", "부산광역시 중구", "local_gov", "부산광역시", "중구", []),
         ("E", "부산광역시 중구의회", "council", "부산광역시", "중구", []), ("F", "경기도", "local_gov", "경기도", None, [])],
        "code string, name string, kind string, sido string, sigungu string, aliases array<string>",
    )
    asked = [
        (1, "무엇이든", "A", None), (2, "해운대 구청", None, None), (3, "해운대구 교통과", None, None), (4, "중구", None, None), (5, "중구 도로과", None, "대전광역시"), (6, "부산광역시 중구의회", None, None),
        (7, "경기도 관광과", None, None), (8, "부산광역시 해운데구청", None, None), (9, "한국무슨공단", None, None), (10, None, None, None),
    ]
    got = {r["id"]: (r["code"], r["method"]) for r in rows(resolve.resolve(spark.createDataFrame(asked, "id int, raw string, code_hint string, sido_hint string"), reg))}
    assert got[1] == ("A", "code") and got[2] == ("A", "exact") and got[3] == ("A", "exact") and got[4] == (None, "ambiguous") and got[5] == ("B", "context")
    assert got[6] == ("E", "exact") and got[7] == ("F", "exact") and got[9] == (None, "none") and got[10] == (None, "none") and len(got) == 10


# --- linking ------------------------------------------------------------------------------------------------------
def test_partition_finds_the_projects_and_ignores_order(spark):
    data = world.signal_rows(owners=3, projects=5)
    truth = {}
    for t in world.truths(owners=3, projects=5):
        truth[t["truth"]] = t
    df = spark.createDataFrame(data, link.SIGNAL)
    first = {r["id"]: r["group_key"] for r in rows(partition.canonical_partition(df))}
    assert len(first) == len(data)
    for seed in range(1):
        shuffled = list(data)
        random.Random(seed).shuffle(shuffled)
        again = {r["id"]: r["group_key"] for r in rows(partition.canonical_partition(spark.createDataFrame(shuffled, link.SIGNAL).repartition(3)))}
        assert again == first
    groups = {}
    for i, g in first.items():
        groups.setdefault(g, set()).add(data[i][1])
    assert all(len(owners) == 1 for owners in groups.values()) and len(groups) < len(data)


def signal(i, stage, at, title="중앙공원 정비", refs=None, **more):
    base = {"order_plan_no": None, "prespec_no": None, "bid_notice_no": None, "bid_notice_nos": [], "cancels_bid_notice_no": None} | (refs or {})
    row = {"institution": "I", "document_id": i, "category": "facility", "department": None, "budget_krw": None, "commitment": None, "expected_year": None, "expected_half": None, "keywords": [], "embedding": None} | more
    return (i, row["institution"], row["document_id"], stage, at, title, row["category"], row["department"], row["budget_krw"], row["commitment"], row["expected_year"], row["expected_half"], row["keywords"], base, row["embedding"], f"k{i:03}")


def grouped(spark, *cases):
    """The groups of each case's signals; each case is an institution of its own, all are linked together."""
    data = [(r[0], f"I{c}", *r[2:]) for c, case in enumerate(cases) for r in case]
    data = [(1000 * int(r[1][1:]) + r[0], *r[1:]) for r in data]
    out = {}
    for r in rows(partition.canonical_partition(spark.createDataFrame(data, link.SIGNAL))):
        out.setdefault(r["group_key"], set()).add(r["id"])
    return [sorted(sorted(i % 1000 for i in g) for g in out.values() if min(g) // 1000 == c) for c in range(len(cases))]


def test_shared_number_links_whatever_the_titles(spark):
    s = [signal(1, "order_plan", D(2026, 1, 1), "가나다 구매", {"order_plan_no": "P1"}), signal(2, "prespec", D(2026, 2, 1), "전혀 다른 이름", {"order_plan_no": "P1"}), signal(3, "order_plan", D(2026, 1, 5), "마바사 제작", {"order_plan_no": "P2"})]
    assert grouped(spark, *[[s[i] for i in order] for order in itertools.permutations(range(3))]) == [[[1, 2], [3]]] * 6


def test_conflicting_numbers_and_same_book_rows_stay_apart(spark):
    two = [signal(1, "bid_notice", D(2026, 1, 1), refs={"bid_notice_no": "B1"}), signal(2, "bid_notice", D(2026, 1, 2), refs={"bid_notice_no": "B2"})]
    both = [signal(1, "budget_line", D(2026, 1, 1), document_id=9, budget_krw=100), signal(2, "budget_line", D(2026, 1, 1), document_id=9, budget_krw=100)]
    next_book = [signal(1, "budget_line", D(2026, 1, 1), document_id=9, budget_krw=100), signal(2, "budget_line", D(2026, 6, 1), document_id=10, budget_krw=100)]
    sites = [signal(1, "council_mention", D(2026, 1, 1), "중원청소년수련관 시설개선", budget_krw=5), signal(2, "budget_line", D(2026, 2, 1), "수정청소년수련관 시설개선", budget_krw=5)]
    assert grouped(spark, two, both, next_book, sites) == [[[1], [2]], [[1], [2]], [[1, 2]], [[1], [2]]]


def summary(spark, today, *signals):
    df = spark.createDataFrame(list(signals), link.SIGNAL).withColumn("group_key", F.lit("g"))
    return rows(link.summaries(df, today))[0]


def test_summary_of_a_life_cycle(spark):
    s = summary(
        spark, D(2026, 8, 1), signal(1, "council_mention", D(2026, 1, 1), "말", commitment="planned", keywords=["a"], embedding=[1.0, 0.0], expected_year=2027),
        signal(2, "budget_line", D(2026, 3, 1), "[긴급] 2026년 예산서 이름", budget_krw=7, department="도로과", keywords=["b", "a"], embedding=[0.0, 1.0]),
    )
    assert (s["stage"], s["title"], s["status"], s["est_budget_krw"], s["department"], s["best_commitment"]) == ("budget_line", "예산서 이름", "open", 7, "도로과", "planned")
    assert s["keywords"] == ["b", "a"] and s["bid_window_start"] == D(2027, 1, 15) and s["bid_window_end"] == D(2027, 11, 30) and s["conversion_prob"] == 0.75
    assert [round(x, 4) for x in s["embedding"]] == [0.7071, 0.7071]


def test_summary_of_tenders(spark):
    bid = signal(1, "bid_notice", D(2026, 7, 20), refs={"bid_notice_no": "B1"})
    assert summary(spark, D(2026, 8, 1), bid)["status"] == "bid_open" and summary(spark, D(2026, 9, 1), bid)["status"] == "closed"
    gone = signal(2, "bid_notice", D(2026, 7, 25), refs={"cancels_bid_notice_no": "B1"})
    s = summary(spark, D(2026, 8, 1), bid, gone)
    assert s["status"] == "closed" and s["bid_published_at"] == D(2026, 7, 20)
    s = summary(spark, D(2026, 8, 1), bid, gone, signal(3, "budget_line", D(2026, 1, 1)))
    assert s["status"] == "open" and s["stage"] == "budget_line" and s["bid_published_at"] is None
    again = signal(4, "bid_notice", D(2026, 7, 30), refs={"bid_notice_no": "B1"})
    assert summary(spark, D(2026, 8, 1), bid, gone, again)["status"] == "bid_open"
    assert summary(spark, D(2030, 1, 1), signal(1, "council_mention", D(2026, 1, 1)))["status"] == "dormant"


def test_identities_keep_exact_then_greatest_overlap(spark):
    old = spark.createDataFrame([("I", 7, i) for i in (1, 2, 3)] + [("I", 8, 4), ("I", 8, 5)], "institution string, opportunity_id long, id long")
    new = spark.createDataFrame([("I", "a", 1), ("I", "b", 2), ("I", "b", 3), ("I", "c", 4), ("I", "c", 5), ("I", "d", 9)], "institution string, group_key string, id long")
    assert {r["group_key"]: r["opportunity_id"] for r in rows(link.keep_identities(new, old))} == {"b": 7, "c": 8}
    events = rows(link.membership_events(old.select("id", "opportunity_id"), spark.createDataFrame([(1, 7), (2, 8), (9, 8)], "id long, opportunity_id long")))
    assert {(e["id"], e["event"]) for e in events} == {(2, "moved"), (3, "unlinked"), (4, "unlinked"), (5, "unlinked"), (9, "linked")}


def test_reference_matches(spark):
    def frame(data, extra=""):
        return spark.createDataFrame(data, f"id long, institution string, refs {link.REFS}{extra}")

    none = {"order_plan_no": None, "prespec_no": None, "bid_notice_no": None, "bid_notice_nos": None, "cancels_bid_notice_no": None}
    members = frame([(1, "I", none | {"order_plan_no": "P"}, 10), (2, "I", none | {"order_plan_no": "P", "bid_notice_no": "B"}, 20), (3, "J", none | {"order_plan_no": "P"}, 30)], ", group_id long")
    asked = frame([(11, "I", none | {"order_plan_no": "P"}), (12, "I", none | {"order_plan_no": "P", "cancels_bid_notice_no": "B"}), (13, "J", none | {"order_plan_no": "P"})])
    got = {r["id"]: (r["target"], r["conflict"]) for r in rows(joins.reference_matches(asked, members))}
    assert got == {11: (None, True), 12: (20, False), 13: (30, False)}


# --- back-test, follow-up -----------------------------------------------------------------------------------------
def test_backtest_censors_and_never_looks_ahead(spark):
    s = "opportunity_id long, id long, stage string, observed_at date, published_at date, commitment string, published_from string, council_id string, cancels string"
    data = [
        (1, 1, "council_mention", D(2024, 1, 1), D(2024, 1, 10), "planned", "site", None, None), (1, 2, "bid_notice", D(2024, 7, 1), D(2024, 7, 1), None, "site", None, None),
        (2, 3, "budget_line", D(2024, 2, 1), D(2024, 2, 1), None, "site", None, None),
        (3, 4, "budget_line", D(2026, 1, 1), D(2026, 1, 1), None, "site", None, None),  # horizon not over
        (4, 5, "budget_line", D(2024, 1, 1), D(2024, 1, 1), None, "crawled", None, None),  # date proves nothing
        (5, 6, "budget_line", D(2024, 1, 1), D(2024, 1, 1), None, "site", None, None), (5, 7, "bid_notice", D(2024, 3, 1), D(2024, 3, 1), None, "site", None, "B"),
    ]
    dated, left = backtest.publicly_dated(spark.createDataFrame(data, s))
    assert left.first()[0] == 1
    today = D(2026, 6, 1)
    per = backtest.per_opportunity(dated, today)
    got = {r["cohort"]: (r["n"], r["converted"]) for r in rows(backtest.cohorts(per, today))}
    assert got == {"council_mention:planned": (1, 1), "council_mention:*": (1, 1), "budget_line:committed": (2, 0), "budget_line:*": (2, 0)}
    assert backtest.censored(per, today).first()[0] == 1
    lead = {r["stage"]: (r["n"], r["median"]) for r in rows(backtest.lead_times(per))}
    assert lead == {None: (1, 173.0), "council_mention": (1, 173.0)}
    assert rows(backtest.early_coverage(per))[0] == {"tenders": 1, "with_early_signal": 1, "rate": 1.0}
    assert backtest.calibration(backtest.cohorts(per, today), least=2).collect()[0]["cohort"] == "budget_line:committed"


def test_follow_up(spark):
    pred = spark.createDataFrame(
        [(i, st, None, D(2025, 3, 1), D(2025, 4, 1)) for i, st in enumerate(["budget_line", "budget_line", "bid_notice", "budget_line"], 1)],
        "opportunity_id long, stage string, bid_published_at date, bid_window_start date, bid_window_end date",
    )
    out = spark.createDataFrame([(1, D(2025, 3, 10)), (4, D(2025, 1, 1))], "opportunity_id long, published_at date")
    cover = spark.createDataFrame([(1, D(2025, 1, 1), D(2025, 6, 1)), (1, D(2025, 6, 2), D(2026, 1, 1)), (2, D(2025, 1, 1), D(2025, 5, 1))], "opportunity_id long, start date, end date")
    got = {r["opportunity_id"]: r for r in rows(backtest.follow_up(pred, out, cover, D(2025, 1, 15), D(2026, 1, 1), None, horizon=200))}
    assert (got[1]["status"], got[1]["lead_days"], got[1]["window_hit"]) == ("evaluated", 54, True)
    assert (got[2]["status"], got[2]["window_hit"]) == ("coverage_incomplete", False) and got[3]["status"] == "already_published" and got[4]["status"] == "outcome_predates_freeze"
    late = {r["opportunity_id"]: r["status"] for r in rows(backtest.follow_up(pred, out, cover, D(2025, 1, 15), D(2025, 6, 1), None, horizon=200))}
    assert late[1] == "right_censored"


# --- market -------------------------------------------------------------------------------------------------------
OPP = "opportunity_id long, institution string, title string, category string, stage string, status string, keywords array<string>, embedding array<double>, est_budget_krw long, conversion_prob double, bid_window_start date, bid_window_end date, last_signal_at date"


def opportunities(spark):
    e = lambda *x: list(map(float, x))
    return spark.createDataFrame(
        [
            (1, "I", "스마트쉘터 구축", "smart_city", "budget_line", "open", ["쉘터"], e(1, 0), 100, 0.7, D(2026, 9, 1), D(2026, 12, 1), D(2026, 3, 1)),
            (2, "J", "도서관 보수", "facility", "bid_notice", "bid_open", [], e(0, 1), 100, 1.0, D(2026, 6, 1), D(2026, 6, 1), D(2026, 5, 1)),
            (3, "I", "폐기물 처리", "energy_env", "budget_line", "closed", ["쉘터"], e(1, 0), 100, 0.7, None, None, D(2026, 3, 1)),
            (4, "I", "담배 자판기 쉘터", "other", "council_mention", "open", [], None, None, 0.3, D(2026, 1, 1), D(2026, 2, 1), D(2026, 4, 1)),
        ],
        OPP,
    )


def test_recommendations_and_feed(spark):
    opps = opportunities(spark)
    prof = spark.createDataFrame([(9, ["스마트 쉘터", "쉘터"], ["담배"], ["smart_city"], ["41"], 50, 200, [1.0, 0.0])], "org_id long, keywords array<string>, exclude_keywords array<string>, categories array<string>, region_codes array<string>, budget_min long, budget_max long, embedding array<double>")
    regions = spark.createDataFrame([("I", "41135"), ("J", "26110")], "institution string, region_code string")
    got = {r["opportunity_id"]: r for r in rows(market.recommend(opps, prof, regions, D(2026, 6, 1)))}
    assert set(got) == {1, 2, 4} and got[1]["rank"] == 1
    want = 0.26 * 1 + 0.22 * 1 + 0.12 + 0.08 + 0.08 + 0.14 * 0.7 + 0.10 * 1.0
    assert got[1]["score"] == round(want, 4) and got[4]["excluded"] == ["담배"]
    dirty = spark.createDataFrame([("I", 3, 2)], "institution string, generation int, reconciled int")
    assert {r["opportunity_id"] for r in rows(market.recommend(opps, prof, regions, D(2026, 6, 1), dirty))} == {2}
    recs = spark.createDataFrame([(9, 1, 0.9, None, None), (9, 2, 0.5, "dismissed", None), (9, 4, 0.7, "relevant", "council_mention")], "org_id long, opportunity_id long, score double, feedback string, notified_stage string")
    page = lambda **k: [r["opportunity_id"] for r in rows(market.feed_page(market.feed(recs, opps, 9, D(2026, 6, 1), **k)))]
    assert page() == [1, 4] and page(include_dismissed=True) == [1, 4, 2] and page(sort="recent") == [4, 1] and page(sort="soon") == [4, 1] and page(q="쉘터") == [1, 4]
    whole = market.feed(recs, opps, 9, D(2026, 6, 1), include_dismissed=True)
    first = rows(market.feed_page(whole, limit=1))
    assert len(first) == 2
    nxt = rows(market.feed_page(whole, after=(first[0]["sort_key"], first[0]["score"], first[0]["opportunity_id"]), limit=5))
    assert [r["opportunity_id"] for r in nxt] == [4, 2]
    rules = spark.createDataFrame([(9, 0.55, "daily", None)], "org_id long, min_score double, mode string, stages array<string>")
    assert [r["opportunity_id"] for r in rows(market.fresh_alerts(recs, opps.drop("score"), rules))] == [1]
    assert market.stage_counts(whole).count() == 3


def test_delivery_states(spark):
    df = spark.createDataFrame([("pending", 0, "sent"), ("pending", 0, "transient"), ("pending", 2, "transient"), ("pending", 4, "transient"), ("pending", 0, "permanent"), ("sent", 1, "sent")], "s string, a int, o string")
    got = [tuple(r["x"].values()) for r in rows(df.select(market.delivery(F.col("s"), F.col("a"), F.col("o")).alias("x")))]
    assert got == [("sent", 1, None, False), ("pending", 1, 5.0, False), ("pending", 3, 20.0, False), ("failed", 5, None, False), ("failed", 1, None, True), ("sent", 1, None, False)]
    hours = [r["q"] for r in rows(spark.range(24).select(market.quiet(F.col("id")).alias("q")))]
    assert [h for h in range(24) if hours[h]] == [0, 1, 2, 3, 4, 5, 6, 7, 22, 23]


# --- governance, accounts -----------------------------------------------------------------------------------------
def test_protected(spark):
    opps = spark.createDataFrame([(i, "I") for i in range(1, 9)], "opportunity_id long, institution string")
    m = "opportunity_id long, id long, signal_institution string, method string, tentative boolean, verdict string"
    members = spark.createDataFrame([(i, i * 10, "I", "manual" if i == 1 else "similarity", False, "needs_review" if i == 2 else "accepted") for i in range(1, 9)], m)
    reviews = spark.createDataFrame([(30, "resolved", None, None, None), (80, "open", None, None, [4])], "signal_id long, status string, resolved_at timestamp, resolved_by string, mentions array<bigint>")
    rel = spark.createDataFrame([(5, 99)], "project_id long, contract_id long")
    ev = spark.createDataFrame([([6], [70])], "opportunity_ids array<bigint>, evidence_signal_ids array<bigint>")
    cores = spark.createDataFrame([(8, [80, 81])], "opportunity_id long, signal_ids array<bigint>")
    got = {r["opportunity_id"] for r in rows(governance.protected(opps, members, reviews, rel, ev, cores, ["I"]))}
    assert got == set(range(1, 9))
    fine = governance.protected(opps, members.filter("id > 20"), reviews.limit(0), rel.limit(0), ev.limit(0), spark.createDataFrame([(8, [80])], cores.schema), ["I"])
    assert fine.count() == 0


def test_relations(spark):
    opps = spark.createDataFrame([(1, "I"), (2, "I"), (3, "J")], "opportunity_id long, institution string")
    ev = spark.createDataFrame([(10, 1, "I", "budget_line", "accepted", False, "x"), (20, 2, "I", "bid_notice", "accepted", False, "y")], "signal_id long, opportunity_id long, institution string, stage string, verdict string, tentative boolean, fingerprint string")
    r = "relation_id long, project_id long, contract_id long, status string, evidence array<struct<signal_id bigint, fingerprint string>>"
    both = [{"signal_id": 10, "fingerprint": "x"}, {"signal_id": 20, "fingerprint": "y"}]
    changed = [both[0], {"signal_id": 20, "fingerprint": "old"}]
    rel = spark.createDataFrame([(1, 1, 2, "confirmed", both), (2, 1, 2, "confirmed", changed), (3, 1, 3, "rejected", both), (4, 1, 1, "proposed", both[:1])], r)
    got = {x["relation_id"]: (x["reasons"], x["effective_status"]) for x in rows(governance.relation_validity(rel, opps, ev))}
    assert got[1] == ([], "confirmed") and got[2] == (["evidence_changed"], "stale") and got[3][1] == "rejected" and "institution_mismatch" in got[3][0]
    assert {"self_relation", "evidence_ids_invalid"} <= set(got[4][0]) and got[4][1] == "stale"
    log = spark.createDataFrame([(1, 1, "proposed", 1, 2, "a"), (1, 2, "confirmed", 1, 2, "b"), (1, 2, "confirmed", 1, 2, "b"), (2, 1, "confirmed", 5, 2, "c")], "relation_id long, version int, status string, project_id long, contract_id long, idempotency_key string")
    state = governance.relation_state(log)
    assert {(x["relation_id"], x["status"]) for x in rows(state)} == {(1, "confirmed"), (2, "confirmed")} and governance.relation_violations(state).first()["n"] == 2


def test_accounts(spark):
    e = spark.createDataFrame([(1, 1, 10, 10, "a"), (1, 2, -4, 6, "b"), (1, 3, -9, -3, "c"), (2, 4, 5, 6, None), (1, 5, 1, -2, "a")], "org_id long, id long, delta long, balance_after long, idempotency_key string")
    e = e.withColumnRenamed("balance_after", "balance_after")
    assert {r["id"] for r in rows(accounts.ledger_audit(e))} == {3, 4, 5}
    assert [r["b"] for r in rows(spark.range(1, 5).select(accounts.backoff_seconds(F.col("id")).alias("b")))] == [30, 60, 120, 240]
    df = spark.createDataFrame([("past_due", 0, "paid"), ("active", 0, "failed"), ("past_due", 3, "failed")], "s string, a int, o string")
    assert [tuple(r["x"].values()) for r in rows(df.select(accounts.renewal(F.col("s"), F.col("a"), F.col("o")).alias("x")))] == [("active", 0, None), ("past_due", 1, 1), ("ended", 4, None)]
    jobs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    assert {(r["id"], r["depth"]) for r in rows(accounts.job_tree(jobs, 1))} == {(1, 0), (2, 1), (3, 2)}


def test_ingest(spark):
    s = "source string, external_id string, title string, content_hash string, parse_status string"
    old = spark.createDataFrame([("s", "1", "a", "h1", "parsed"), ("s", "2", "b", "h2", "parsed"), ("s", "3", "c", "h3", "parsed")], s)
    new = spark.createDataFrame([("s", "1", "a", "h1", 1), ("s", "2", "B", "h9", 2), ("s", "4", "d", "h4", 3), ("s", "4", "D", "h5", 4)], "source string, external_id string, title string, content_hash string, seq int")
    got = {r["external_id"]: (r["title"], r["parse_status"], r["action"]) for r in rows(ingest.upsert(old, new, ["source", "external_id"]))}
    assert got == {"1": ("a", "parsed", "skipped"), "2": ("B", "pending", "updated"), "3": ("c", "parsed", "kept"), "4": ("D", "pending", "created")}
    rules = [("unmapped", F.col("id") > 0), ("window", F.col("id") < 5)]
    kept, why = ingest.listing_filter(spark.range(8), rules)
    assert kept.count() == 4 and {r["reason"]: r["n"] for r in rows(why)} == {"unmapped": 1, "window": 3, None: 4}
    recs = "org_id long, opportunity_id long, score double, feedback string, feedback_at timestamp, notified_stage string"
    before = spark.createDataFrame([(1, 1, 0.1, None, None, None), (1, 2, 0.2, "relevant", None, None), (1, 3, 0.3, None, None, None)], recs)
    after = ingest.replace_recommendations(before, spark.createDataFrame([(1, 3, 0.9), (1, 4, 0.8)], "org_id long, opportunity_id long, score double"))
    assert {(r["opportunity_id"], r["score"]) for r in rows(after)} == {(2, 0.2), (3, 0.9), (4, 0.8)}


# --- evaluation, media, retrospective, sources --------------------------------------------------------------------
def test_matchings(spark):
    e = spark.createDataFrame([("c", "a", "x"), ("c", "a", "y"), ("c", "b", "x")], "case string, left string, right string")
    assert {(r["left"], r["right"]) for r in rows(evaluation.maximum_matching(e))} == {("a", "y"), ("b", "x")}
    g = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 8, 20)], "doc long, gold_id long, start long, end long")
    p = spark.createDataFrame([(1, 7, 9, 18), (1, 8, 2, 9)], "doc long, pred_id long, start long, end long")
    assert {(r["gold_id"], r["pred_id"]) for r in rows(evaluation.best_overlap(g, p))} == {(1, 8), (2, 7)}
    c = spark.createDataFrame([("c", "expected", 1, "", ["쉘터"]), ("c", "expected", 2, "", ["쉘터"]), ("c", "predicted", 5, "도서관", ["쉘터"]), ("c", "predicted", 6, "쉘터", [])], "case string, kind string, id long, title string, words array<string>")
    assert {(r["expected"], r["predicted"]) for r in rows(evaluation.two_pass_match(c))} == {(1, 6), (2, 5)}


def test_transcripts(spark):
    ts = lambda s: dt.datetime(2026, 1, 1, 10, 0, s)
    seg = spark.createDataFrame([("m", ts(1), "가"), ("m", ts(5), "나"), ("m", ts(9), "다")], "media string, start timestamp, text string")
    cap = spark.createDataFrame([("m", ts(2), "A"), ("m", ts(8), "B")], "media string, t timestamp, speaker string")
    got = sorted(rows(media.transcript(media.speakers(seg, cap))), key=lambda r: r["start"])
    assert [(r["speaker"], r["text"], r["char_start"], r["char_end"]) for r in got] == [("A", "가 나", 0, 3), ("B", "다", 4, 5)]
    runs = sorted(rows(media.caption_runs(spark.createDataFrame([("m", i, s) for i, s in enumerate(["A", "A", None, "A", "B"])], "media string, t int, speaker string"))), key=lambda r: r["start"])
    assert [(r["speaker"], r["start"], r["end"]) for r in runs] == [("A", 0, 1), (None, 2, 2), ("A", 3, 3), ("B", 4, 4)]


def test_asof_cut_by_time_equals_brute_force(spark):
    rng = random.Random(2)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 4000)) if rng.random() < 0.95 else None
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left, right = [(i, key(), at()) for i in range(150)], [(key(), at(), rng.randint(0, 5)) for _ in range(60)]
    a, b = spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "k int, u timestamp, v int")
    want = {}
    for i, k, t in left:
        found = [(u, v) for rk, u, v in right if k is not None and t is not None and rk == k and u is not None and u <= t]
        want[i] = max(found)[1] if found else None
    for bucket in (None, "day", "week", "month"):
        assert {r["id"]: r["v"] for r in rows(joins.asof(a, b, "k", "t", "u", ["v"], bucket=bucket))} == want
    assert not rows(joins.asof(a.filter("false"), b, "k", "t", "u", ["v"], bucket="day"))


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(2)
    a, b = ([(k, i, s, s + rng.randrange(1, 60)) for i in range(40) for k, s in [(rng.randrange(3), rng.randrange(300))]] for _ in range(2))
    df = lambda x: spark.createDataFrame(x, "k long, id long, start long, end long")
    got = sorted((r[0], r[1]) for r in joins.interval_overlap(df(a), df(b), "k", 25).select(F.col("a.id"), F.col("b.id")).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_retrospective(spark):
    tok = lambda t: spark.createDataFrame([(t,)], "t string").select(retrospective.name_tokens(F.col("t")).alias("o")).first()["o"]
    assert tok("2027년 대장지구도서관 건립사업 공공도서관 건립") == ["대장지구도서관", "공공도서관"]
    own = lambda d, i: spark.createDataFrame([(d, i)], "d string, i string").select(retrospective.belongs_to(F.col("d"), F.col("i")).alias("o")).first()["o"]
    assert own("경기도 고양시 덕양구", "고양시") and own("충청북도 도로관리사업소", "충청북도") and not own("충청북도 청주시", "충청북도") and not own("충청북도교육청", "충청북도")
    s = spark.createDataFrame([(1, "서산시", "서산시 공공도서관 건립", D(2026, 1, 1))], "signal_id long, institution string, title string, observed_at date")
    n = spark.createDataFrame([(5, "서산시", "대장지구도서관 건립공사", D(2026, 5, 1)), (6, "서산시", "도로 포장", D(2026, 5, 1)), (7, "서산시", "공공도서관", D(2025, 5, 1))], "notice_id long, institution string, notice_title string, notice_date date")
    assert [(r["notice_id"], r["shared"]) for r in rows(retrospective.notice_candidates(s, n))] == [(5, ["도서관"])]


def test_procurement_items(spark):
    items = spark.createDataFrame([("R26BK00000001", "001", "쉘터 구축", "2026-03-05 10:00", "0", "12,000,000.5", "취소공고", "구청"), ("X", None, None, "20260301", "1", None, None, None)], "bidNtceNo string, bidNtceOrd string, bidNtceNm string, bidNtceDt string, asignBdgtAmt string, presmptPrce string, ntceKindNm string, dminsttNm string")
    r = rows(procurement.map_items(items, "bid_notice"))
    assert len(r) == 1 and r[0]["external_id"] == "R26BK00000001-001" and r[0]["published_at"] == D(2026, 3, 5) and r[0]["amount_krw"] == 12_000_000
    assert r[0]["refs"]["cancels_bid_notice_no"] == "R26BK00000001" and r[0]["refs"]["bid_notice_no"] is None
    plan = spark.createDataFrame([("P1", "사업", "202603", "R26BK01739589000, R26BK01739589", "500")], "orderPlanUntyNo string, bizNm string, nticeDt string, bidNtceNoList string, sumOrderAmt string")
    r = rows(procurement.map_items(plan, "order_plan"))[0]
    assert r["published_at"] == D(2026, 3, 1) and r["refs"]["bid_notice_nos"] == ["R26BK01739589"] and r["amount_krw"] is None


def test_minutes_listing(spark):
    base = {"RASMBLY_ID": "1", "RASMBLY_NUMPR": "9", "RASMBLY_SESN": "3", "MINTS_ODR": "1", "MTGNM": "본회의", "MTG_DE": "20260301"}
    data = [base | {"DOCID": "a"}, base | {"DOCID": "b"}, base | {"DOCID": "c", "MTG_DE": "20250101"}]
    found = minutes.meetings(spark.createDataFrame([tuple(r.values()) for r in data], ", ".join(f"{k} string" for k in data[0])), D(2026, 1, 1), D(2026, 12, 31))
    assert [r["revisions"] for r in rows(found)] == [["b", "a"]]
    known = found.select("external_id", F.array(F.lit("a")).alias("seen"))
    assert [(r["docid"], r["revised"]) for r in rows(minutes.to_read(found, known, D(2026, 1, 1)))] == [("b", True)]
    facts = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(minutes.budget_facts(F.col("t")).alias("o")).first()["o"])
    assert facts("2027년도 서울특별시 강남구 제1회 추가경정예산서") == (2027, "제1회 추가경정", D(2027, 12, 31)) and facts("2027년도 본예산서") == (2027, "본", D(2026, 12, 31))
    assert tuple(spark.createDataFrame([("서울", "서울강남구")], "r string, n string").select(minutes.split_region(F.col("r"), F.col("n")).alias("o")).first()["o"]) == ("서울특별시", "강남구")


def test_html():
    page = "<html><nav>메뉴</nav><body><h1>제목</h1><p>한 줄<br>두  줄</p><b>○의장</b>말<script>x()</script></body></html>"
    assert html.page_text(page) == "제목\n\n한 줄\n두 줄\n\n○의장  말" or html.page_text(page).replace("\n\n", "\n") == "제목\n한 줄\n두 줄\n○의장  말"
    assert html.canonical_url("http://A.kr/x/", "../y?b=2&a=1#z") == "http://a.kr/y?a=1&b=2" and html.canonical_url("http://a.kr", "javascript:x") is None


CLIENT = """
import datetime as dt


def pages(path, since, until, page, rows):
    days = (until - since).days + 1
    items = [{"path": path, "day": (since + dt.timedelta(days=i)).isoformat()} for i in range(days)]
    return items[(page - 1) * rows : page * rows], len(items)
"""


def test_paged_source(spark, tmp_path):
    (tmp_path / "paged_client.py").write_text(CLIENT)
    readers.register(spark)
    options = {"paths": "a,b", "since": "2026-01-01", "until": "2026-01-17", "rows": "3", "client": "paged_client:pages", "client_path": str(tmp_path)}
    df = spark.read.format("paged_records").options(**options).load()
    got = rows(df)
    assert len(got) == 34 and {r["path"] for r in got} == {"a", "b"} and df.rdd.getNumPartitions() == 6
    assert readers.weeks(D(2026, 1, 1), D(2026, 1, 8)) == [(D(2026, 1, 1), D(2026, 1, 7)), (D(2026, 1, 8), D(2026, 1, 8))]
    days = []
    for until in ("2026-01-17", "2026-01-20"):
        stream = spark.readStream.format("paged_records").options(**{**options, "until": until}).load()
        q = stream.writeStream.foreachBatch(lambda df, i: days.extend(r["item"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert len(set(days)) == 46 and len(days) == 40 + 14  # three days before each batch are read again


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, b"x")], "id int, content binary")
    kept = readers.put_blobs(df, str(tmp_path / "blobs"))
    assert kept.columns == ["id", "raw_sha256"]
    back = readers.get_blobs(spark, str(tmp_path / "blobs"), kept.filter("id = 3"))
    assert [bytes(r["content"]) for r in back.collect()] == [b"x"]
    readers.put_blobs(df.union(spark.createDataFrame([(4, b"z")], "id int, content binary")), str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 3


def test_ranking_and_graph(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (1, 9), (2, 1)], "k long, v long").withColumn("id", F.monotonically_increasing_id())
    assert ranking.top_k(df, ["k"], [F.desc("v"), F.asc("id")], 2).count() == 3
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert not graph.has_cycle(edges) and graph.has_cycle(edges.union(spark.createDataFrame([(3, 1)], "a long, b long")))
    assert {r["node"]: r["label"] for r in rows(graph.components(edges))} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert set(evaluation.split_by_component(spark.range(200).withColumnRenamed("id", "label")).toPandas()["split"]) == {"train", "dev", "test"}


def test_plans_have_no_products(spark):
    from foretide.plans import catalog

    for name in ("join_asof", "join_interval_overlap", "join_equi_and_range", "join_semi_exists", "window_latest_per_key"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_identities_by_rounds_are_the_greedy_choice(spark):
    rng = random.Random(4)
    groups = [(f"I{i % 2}", f"g{rng.randrange(12)}", i) for i in range(120)]
    old = [(f"I{i % 2}", 100 * (i % 2) + rng.randrange(12), i) for i in range(120) if rng.random() < 0.8]
    want = {}
    for inst in ("I0", "I1"):
        new, had = {}, {}
        for n, g, i in groups:
            if n == inst:
                new.setdefault(g, set()).add(i)
        for n, o, i in old:
            if n == inst:
                had.setdefault(o, set()).add(i)
        free = set(had)
        for _, _, g, o in sorted((new[g] != had[o], -len(new[g] & had[o]), g, o) for g in new for o in had if new[g] & had[o]):
            if (inst, g) not in want and o in free:
                want[inst, g] = o
                free.discard(o)
    got = link.keep_identities(spark.createDataFrame([(a, f"{a}:{g}", i) for a, g, i in groups], "institution string, group_key string, id long"), spark.createDataFrame(old, "institution string, opportunity_id long, id long"))
    assert {tuple(r["group_key"].split(":")): r["opportunity_id"] for r in rows(got)} == want and len(want) > 15


def test_the_core_of_a_graph_is_its_cycles_and_what_lies_between(spark):
    e = "a long, b long"
    chain, ring = [(i, i + 1) for i in range(9)], [(20, 21), (21, 22), (22, 20)]
    between = [(22, 30), (30, 31), (31, 40), (40, 41), (41, 40)]
    got = graph.cyclic_core(spark.createDataFrame([*chain, *ring, *between, (9, 20), (41, 50), (60, 60)], e))
    assert {(r["a"], r["b"]) for r in rows(got)} == {*ring, *between, (60, 60)}
    assert graph.cyclic_core(spark.createDataFrame([], e)).count() == 0 and not graph.has_cycle(spark.createDataFrame(chain, e))


def test_words_of_any_length_are_found_in_titles(spark):
    titles = ["Abcde x", "ab", "a%b c_d", "가나다 라", "", "zz\\y"]
    words = ["BCD", "a", "%", "_", "c_d", "나다", "a%b", "", "abcdef", "ab_de"]
    got = market.title_holds(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(w,) for w in words], "k string"))
    import re

    like = lambda w: re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in w) + ".*", re.S | re.I)
    want = sorted((t, w) for t in titles for w in words if like(w).fullmatch(t))
    assert sorted((r["title"], r["k"]) for r in rows(got)) == want


def test_crawl_rounds_and_reasons(spark):
    u = lambda p, h="a.kr": f"https://{h}{p}"
    links = [(u("/list"), u(f"/post/{i}")) for i in range(4)] + [(u("/list"), u("/list?page=2")), (u("/list?page=2"), u("/post/9")), (u("/post/1"), u("/file/1.pdf")), (u("/post/1"), u("/list")), (u("/post/2"), u("/x", "b.kr")), (u("/post/9"), u("/file/9.pdf")), (u("/file/1.pdf"), u("/deep")), (u("/post/1"), "mailto:x"), (u("/post/3"), u("/post/1"))]
    there = [u(p) for p in ("/list", "/list?page=2", "/post/0", "/post/1", "/post/2", "/post/9", "/file/1.pdf", "/file/9.pdf", "/deep")]
    rules = [("A.kr", "/post", False), ("a.kr", "/post/", True), ("a.kr", "/post/2", False), ("a.kr", "/file/9", False), ("a.kr", "/file/9", True), ("b.kr", "/", False)]
    df = lambda rows_, s: spark.createDataFrame(rows_, s)
    args = (df([(u("/list"),)], "url string"), df(links, "url string, target string"), df(rules, "host string, prefix string, allow boolean"), df([(x,) for x in there], "url string"))
    got = {r["url"]: (r["round"], r["reason"]) for r in rows(crawl.crawl(*args, depth=3, hosts=df([("a.kr",)], "host string")))}
    assert got == {
        u("/list"): (0, None), u("/post/0"): (1, None), u("/post/1"): (1, None), u("/post/2"): (1, "robots"), u("/post/3"): (1, "absent"), u("/list?page=2"): (1, None),
        u("/file/1.pdf"): (2, None), u("/post/9"): (2, None), "mailto:x": (2, "no_host"), u("/deep"): (3, None), u("/file/9.pdf"): (3, None),
    }
    assert len(rows(crawl.crawl(*args, depth=1))) == 6 and crawl.crawl(args[0].limit(0), *args[1:], depth=3).count() == 0
    assert {r["url"]: r["allow"] for r in rows(crawl.deciding_rules(args[3], args[2]))}[u("/post/0")] is True


def test_spelling_is_that_of_all_pairs(spark):
    """Names are aliases with letters left out, put in and changed; many end alike; some are a letter long."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    aliases = [(f"c{i}", word(rng.randint(1, 22)) + rng.choice(["", "xyxyzz", "xyxyzz"])) for i in range(150)] + [("c1", "aaaaaaaaaaaaaa"), ("d", "h")]
    names = []
    for i in range(300):
        t = list(rng.choice(aliases)[1])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        names.append((i, "".join(t)))
    kept = {(r["nid"], r["code"], r["alias_jamo"]) for r in rows(resolve.near_spellings(spark.createDataFrame(names, "nid long, jamo string"), spark.createDataFrame(aliases, "code string, alias_jamo string"), 84))}
    want, near = {}, 0
    for i, n in names:
        best = {}
        for c, a in aliases:
            s = fuzzy.ratio(n, a) if n else 0.0
            if s >= 84:
                assert (i, c, a) in kept, (n, a, s)
                near += 1
            best[c] = max(best.get(c, 0.0), s)
        first, second = sorted(best.values(), reverse=True)[:2]
        if first >= resolve.FUZZY_SCORE and first - second >= resolve.FUZZY_LEAD:
            want[i] = (max(c for c in best if best[c] == first), first)
    got = {r["nid"]: (r["fuzzy_code"], r["fuzzy_score"]) for r in rows(resolve.spelled_like(spark.createDataFrame(names, "nid long, jamo string"), spark.createDataFrame(aliases, "code string, alias_jamo string")))}
    assert got == want and len(want) > 100 and near > 200 and len(kept) < 0.5 * len(names) * len(aliases)
