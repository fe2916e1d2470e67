"""Scalar functions against tables of inputs and outputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foretide.functions import chunks, money, scores, text, timing, udfs
from foretide.functions.money import amounts_in

D = dt.date


def value(spark, column, **inputs):
    """One expression over one row of inputs."""
    kinds = {str: "string", int: "bigint", float: "double", D: "date", list: "array<string>"}
    schema = ", ".join(f"`{k}` {kinds[type(v)] if v is not None else 'string'}" for k, v in inputs.items()) or "x int"
    row = tuple(inputs.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("said", "won"),
    [
        ("3억 5천만원", 350_000_000), ("3억5,000만 원", 350_000_000), ("350,000천원", 350_000_000), ("350백만원", 350_000_000), ("1.2억", 120_000_000),
        ("삼억 오천만 원", 350_000_000), ("2억 8천 정도", 280_000_000), ("2억 4000 정도", 240_000_000), ("금 일억이천삼백원", 100_002_300), ("1조 2천", 1_200_000_000_000),
        ("12,000원", 12_000), ("일부 이천 시민", None), ("2억 2027년", 200_000_000), ("만원", None),
    ],
)
def test_amounts(said, won):
    found = [a["value"] for a in amounts_in(said)]
    assert (max(found) if found else None) == won


def test_amount_offsets_and_table_cells(spark):
    got = amounts_in("교량 352,000 328,000", unit=1000, bare=True)
    assert [(a["value"], a["raw"]) for a in got] == [(352_000_000, "352,000"), (328_000_000, "328,000")]
    rows = value(spark, money.find_amounts(F.col("t")), t="총 3억원과 500만원")
    assert [(r["value"], r["start"], r["end"], r["won"]) for r in rows] == [(300_000_000, 2, 5, True), (5_000_000, 7, 12, True)]
    assert value(spark, money.parse_krw("t"), t="1,234") == 1234
    assert value(spark, money.table_unit(F.col("t")), t="(단위: 천원)") == 1000
    assert value(spark, money.table_unit(F.col("t")), t="없음") is None


@pytest.mark.parametrize(("won", "shown"), [(350_000_000, "3억 5,000만원"), (50_000_000, "5,000만원"), (0, "0원"), (12_345, "1만 2,345원"), (1_200_000_000_001, "12,000억원")])
def test_format_krw(spark, won, shown):
    assert value(spark, money.format_krw(F.col("v")), v=won) == shown


def test_amounts_agree(spark):
    ok = lambda a, b: value(spark, money.amounts_agree(F.col("a"), F.col("b")), a=a, b=b)
    assert ok(100, 100) and ok(1000, 1009) and not ok(1000, 1020) and not ok(0, 5)


@pytest.mark.parametrize(
    ("said", "at", "year", "half"),
    [
        ("내년도 본예산에 반영하겠습니다", D(2025, 12, 1), 2026, None), ("'27년 상반기", D(2025, 1, 1), 2027, "H1"), ("2026년 9월 발주", D(2025, 1, 1), 2026, "H2"),
        ("하반기에 발주", D(2026, 9, 1), 2026, "H2"), ("상반기에 착수", D(2026, 9, 1), 2027, "H1"), ("내후년 추경", D(2025, 3, 1), 2027, "H2"), ("28년도 예산", D(2025, 3, 1), 2028, None),
    ],
)
def test_resolve_timing(spark, said, at, year, half):
    got = value(spark, timing.resolve_timing(F.col("t"), F.col("d")), t=said, d=at)
    assert (got["year"], got["half"]) == (year, half)


def test_no_timing(spark):
    assert value(spark, timing.resolve_timing(F.col("t"), F.col("d")), t="검토하겠습니다", d=D(2025, 1, 1)) is None


@pytest.mark.parametrize(("a", "b", "shown"), [(D(2026, 7, 1), None, "2026년 7월"), (D(2026, 9, 1), D(2026, 11, 3), "2026년 9~11월"), (D(2026, 11, 1), D(2027, 2, 1), "2026년 11월~2027년 2월")])
def test_month_span(spark, a, b, shown):
    assert value(spark, timing.month_span(F.col("a"), F.col("b").cast("date")), a=a, b=b) == shown


def test_forecast_and_remaining_window(spark):
    w = lambda stage, d, y, h: tuple(value(spark, timing.forecast_window(F.col("s"), F.col("d"), F.col("y").cast("int"), F.col("h")), s=stage, d=d, y=y, h=h))
    assert w("council_mention", D(2026, 1, 1), None, None) == (D(2026, 6, 30), D(2027, 6, 25))
    assert w("budget_line", D(2026, 3, 1), 2026, "H1") == (D(2026, 3, 1), D(2026, 6, 30))
    assert w("budget_line", D(2026, 9, 1), 2026, "H1") == (D(2026, 10, 31), D(2027, 6, 28))
    left = lambda a, b, t, p: tuple(value(spark, timing.remaining_window(F.col("a"), F.col("b"), F.col("t"), F.col("p").cast("date")), a=a, b=b, t=t, p=p))
    assert left(D(2026, 1, 1), D(2026, 11, 1), D(2026, 9, 1), None) == (D(2026, 9, 1), D(2026, 11, 1), False)
    assert left(D(2025, 1, 1), D(2025, 11, 1), D(2026, 9, 1), None) == (D(2025, 1, 1), D(2025, 11, 1), True)
    assert left(D(2025, 1, 1), D(2025, 11, 1), D(2026, 9, 1), D(2026, 8, 1)) == (D(2026, 8, 1), D(2026, 8, 1), False)


def test_plausible_order(spark):
    ok = lambda a, x, b, y: value(spark, timing.plausible_order(F.col("a"), F.col("x"), F.col("b"), F.col("y")), a=a, x=x, b=b, y=y)
    assert ok("council_mention", D(2026, 3, 1), "bid_notice", D(2026, 1, 15)) and not ok("council_mention", D(2026, 6, 1), "bid_notice", D(2026, 1, 15))
    assert ok("bid_notice", D(2026, 6, 1), "council_mention", D(2026, 1, 1))


def test_text_functions(spark):
    assert value(spark, text.normalize("t"), t="Ａ​Ｂ  ◎ x \n y ") == "AB ○ x\ny"
    got = value(spark, text.normalize_with_map("t"), t=" a  ｂ\nc ")
    assert (got["text"], got["map"]) == ("a b c", [1, 2, 4, 5, 6])
    assert value(spark, text.hangul_tokens(F.col("t")), t="가나 abc 다 라마바") == ["가나", "라마바"]
    assert value(spark, text.char_ngrams(F.col("t"), 2), t="a bc") == ["ab", "bc"] and value(spark, text.char_ngrams(F.col("t"), 3), t="ab") == []
    assert value(spark, text.to_jamo(F.col("t")), t="해운대a닭") == "ㅎㅐㅇㅜㄴㄷㅐaㄷㅏㄺ"
    assert value(spark, text.canonicalize(F.col("t")), t="스마트 버스정류장과 홈페이지") == "스마트쉘터과 누리집"
    assert value(spark, text.canonical_terms(F.col("t")), t="학교 앞 씨씨티비") == ["어린이보호구역", "CCTV"]
    assert value(spark, text.canonical_title(F.col("t")), t="[긴급] 2027년 스마트쉘터 구축사업 (협상에 의한 계약)") == "스마트쉘터 구축사업"
    same = lambda a, b: value(spark, text.title_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert same("스마트쉘터 구축", "[긴급] 2026년 스마트 쉘터 구축") == 1.0 and same("가나다", "라마바") == 0.0 and same("홈페이지 개편", "누리집 전면 재구축") >= 0.8
    assert value(spark, text.terms_conflict(F.col("a"), F.col("b")), a="스마트쉘터", b="스마트폴") is True
    assert value(spark, text.jurisdiction_conflict(F.col("a"), F.col("b")), a="수정구 건설과", b="중원구 건설과") is True
    assert value(spark, text.jurisdiction_conflict(F.col("a"), F.col("b")), a="도로과", b="중원구 건설과") is False
    assert value(spark, text.region_matches(F.col("a"), F.col("b")), a="41135", b="41") is True


def test_scores(spark):
    v = value(spark, scores.vote(F.col("t")), t="디지털트윈 플랫폼 구축")
    assert v["category"] == "smart_city" and 0.5 < v["confidence"] <= 1
    assert value(spark, scores.vote(F.col("t")), t="없음")["category"] == "other"
    assert value(spark, scores.commitment(F.col("t")), t="내년도에 반영하겠습니다") == "committed"
    assert value(spark, scores.commitment(F.col("t")), t="적극 검토") == "reviewing" and value(spark, scores.commitment(F.col("t")), t="안녕") is None
    t = lambda s, kind, amount=False: value(spark, scores.triage(F.col("t"), F.col("k"), F.lit(amount)), t=s, k=kind)
    assert t("", "record") == 1.0 and t("추진", "procedure") == 0.0
    assert t("의사일정 산회를 선포합니다", "exchange") < 0.35 < t("내년도 예산에 반영하겠습니다 CCTV 설치", "exchange", True)
    assert value(spark, scores.conversion_probability(F.col("s"), F.col("c"), F.lit(2), F.lit(None).cast("double")), s="council_mention", c="committed") == 0.61
    assert value(spark, scores.conversion_probability(F.col("s"), F.col("c"), F.lit(9), F.lit(0.5)), s="budget_line", c="x") == 0.65
    assert value(spark, scores.keyword_hits(F.col("k"), F.col("t")), k=["스마트 쉘터", "없다", " "], t="스마트쉘터 구축") == ["스마트 쉘터"]
    assert value(spark, scores.exclusive_quantile(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), 0.25)) == 1.25


def test_embedding_is_unit_and_near_for_near_titles():
    a, b, c = (udfs.embed_text(t) for t in ("스마트쉘터 구축", "스마트쉘터 구축 사업", "도서관 보수"))
    assert abs((a * a).sum() - 1) < 1e-9 and a @ b > a @ c


MINUTES = """제1차 본회의
○의장 김하나  회의를 시작하겠습니다.
○이두리 의원  스마트쉘터는 언제 설치합니까?
○의장 김하나  과장님 답변하여 주시기 바랍니다.
○교통과장 박세찌  내년도 예산에 3억원을 반영하겠습니다.
상세한 내용은 서면으로 드리겠습니다.
○최네모위원  감사합니다.
○의장 김하나  산회를 선포합니다."""


def test_turns_and_exchanges():
    said = chunks.turns(MINUTES)
    assert [(t[0], t[1]) for t in said] == [("의장", "김하나"), ("의원", "이두리"), ("의장", "김하나"), ("교통과장", "박세찌"), ("위원", "최네모"), ("의장", "김하나")]
    got = chunks.minutes(MINUTES)
    assert [c["kind"] for c in got] == ["procedure", "exchange", "exchange", "procedure"]
    assert "서면으로" in got[1]["text"] and all(MINUTES[c["char_start"] : c["char_end"]] == c["text"] for c in got)
    bare = "위원장\n김하나\n시작합니다.\n이두리\n위원\n언제입니까?\n도로과장 박세찌\n내년입니다."
    assert [(t[0], t[1]) for t in chunks.turns(bare)] == [("위원장", "김하나"), ("위원", "이두리"), ("도로과장", "박세찌")]


def test_long_speeches_are_cut_within_the_limit():
    t = "○이두리 의원  " + "말이 길어집니다. " * 600
    got = chunks.minutes(t)
    assert len(got) > 2 and all(len(c["text"]) <= 2400 for c in got) and got[-1]["char_end"] >= len(t) - 2


def test_plain_budget_and_block_chunks():
    t = "\n".join(f"줄 {i} " + "가" * 60 for i in range(100))
    got = chunks.plain(t)
    assert got[0]["char_start"] == 0 and got[-1]["char_end"] == len(t)
    assert all(b["char_start"] == a["char_end"] - 200 for a, b in zip(got, got[1:]))
    blocks = chunks.line_blocks(t)
    assert "".join(c["text"] for c in blocks) == t and all(len(c["text"]) <= 1000 for c in blocks)
    book = "부서: 도로과\n(단위: 천원)\n보행교 설치공사 352,000 300,000 52,000\n ○ 설계비 52,000천원\n가로등 교체 10,000 0 10,000\n부서: 교통과\n주차장 조성 5,000 1,000 4,000"
    rows = chunks.budget(book)
    assert [c["labels"] for c in rows] == [["도로과", "보행교 설치공사"], ["도로과", "가로등 교체"], ["교통과", "주차장 조성"]] and "설계비" in rows[0]["text"]


def test_registered_for_sql(spark):
    udfs.register(spark)
    assert spark.sql("SELECT parse_krw('3억원') AS v").first()["v"] == 300_000_000
    spark.createDataFrame([(MINUTES,)], "t string").createOrReplaceTempView("m")
    assert spark.sql("SELECT u.name FROM m, LATERAL turns(m.t) u").count() == 6
    assert spark.sql("SELECT c.kind FROM m, LATERAL chunks(m.t, 'minutes') c").count() == 4


def test_decoding_and_repair():
    assert udfs.decode_bytes("가나".encode("cp949")) == "가나" and udfs.decode_bytes("가".encode()) == "가"
    assert udfs.correct_ocr("35O,000 원") == "350,000 원" and udfs.correct_ocr("1.234.567원") == "1,234,567원"


def test_table_function_and_aggregate_from_sql(spark):
    from foretide.functions import udfs

    udfs.register(spark)
    t = spark.createDataFrame([(1, "3억원과 2만 원", 7), (2, None, 8), (3, "없음", 9)], "id int, words string, amount int")
    got = spark.sql("SELECT * FROM find_amounts(TABLE({t}), 'words')", t=t)
    assert got.columns == ["id", "words", "amount", "raw", "start_at", "end_at", "amount_"]
    assert sorted((r["id"], r["amount"], r["amount_"], r["start_at"]) for r in got.collect()) == [(1, 7, 20000, 5), (1, 7, 300000000, 0)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM find_amounts(TABLE({t}), 'x')", t=t).collect()
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("a", None), ("b", None), ("c", [0.0, 0.0])], "k string, v array<double>")
    got = {r["k"]: r["u"] for r in spark.sql("SELECT k, mean_unit_vector(v) AS u FROM {v} GROUP BY k", v=v).collect()}
    assert [round(x, 9) for x in got["a"]] == [0.6, 0.8] and got["b"] is None and got["c"] is None
