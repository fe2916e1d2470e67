"""Text, money and time functions over texts that are rendered from the shared tables: the SQL computes what has to come
back from the columns that went in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from foretide import constants as K
from foretide.functions import extract, money, parse, scores, text, timing, udfs
from foretide.operators import fuzzy, grounding, market, resolve, retrospective
from foretide.plans.registry import registry
from foretide.sources.tables import spread, table

QUERIES, ORACLE_SQL, query = registry()


def part_key() -> Column:
    return F.col("p_partkey")


def part_name() -> Column:
    return F.col("p_name")


def part_size() -> Column:
    return F.col("p_size")


def s(c: Column) -> Column:
    return c.cast("string")


def pick(c: Column, *values: str) -> Column:
    """The value at the column's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def sql_pick(c: str, *values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({c} % {len(values)} AS INTEGER) + 1]"


def parts(spark, d):
    return table(spark, d, "part")


# --- text ---------------------------------------------------------------------------------------------------------
_WIDE = ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))


@query("SELECT p_partkey, p_name || ' x' || chr(10) || '○끝' AS shown FROM part")
def text_normalize(spark, d):
    raw = F.concat(F.lit("​  "), F.translate(part_name(), *_WIDE), F.lit("\t 　x  \n ◎끝 "))
    return parts(spark, d).select("p_partkey", text.normalize(raw).alias("shown"))


@query("SELECT p_partkey, p_name || ' end' AS shown, CAST(length(p_name) + 4 AS BIGINT) AS n, 2::BIGINT AS first_at, CAST(length(p_name) + 7 AS BIGINT) AS last_at FROM part")
def text_normalize_with_map(spark, d):
    m = text.normalize_with_map(F.concat(F.lit("  "), part_name(), F.lit(" \n\tend")))
    out = parts(spark, d).select("p_partkey", m.alias("m"))
    return out.select("p_partkey", F.col("m.text").alias("shown"), F.size("m.map").cast("long").alias("n"), F.get("m.map", F.lit(0)).cast("long").alias("first_at"), F.element_at("m.map", -1).cast("long").alias("last_at"))


_DIGITS = ("0123456789", "가나다라마바사아자차")


@query(f"""SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(translate(p_partkey::VARCHAR, '{_DIGITS[0]}', '{_DIGITS[1]}') || ' x' || translate(p_size::VARCHAR, '{_DIGITS[0]}', '{_DIGITS[1]}') || 'y가', '[가-힣]+'),
  lambda x: length(x) >= 2), '|') AS tokens FROM part""")
def text_hangul_tokens(spark, d):
    t = F.concat(F.translate(s(part_key()), *_DIGITS), F.lit(" x"), F.translate(s(part_size()), *_DIGITS), F.lit("y가"))
    return parts(spark, d).select("p_partkey", F.array_join(text.hangul_tokens(t), "|").alias("tokens"))


#: Syllables for digits, and their letters.
_SYLLABLES = {"0": ("가", "ㄱㅏ"), "1": ("낙", "ㄴㅏㄱ"), "2": ("됫", "ㄷㅚㅅ"), "3": ("렁", "ㄹㅓㅇ"), "4": ("물", "ㅁㅜㄹ"), "5": ("빛", "ㅂㅣㅊ"), "6": ("쌌", "ㅆㅏㅆ"), "7": ("읽", "ㅇㅣㄺ"), "8": ("줘", "ㅈㅝ"), "9": ("흙", "ㅎㅡㄺ")}


def _jamo_sql(c: str) -> str:
    for digit, (_, letters) in _SYLLABLES.items():
        c = f"replace({c}, '{digit}', '{letters}')"
    return c


@query(f"SELECT p_partkey, {_jamo_sql('p_partkey::VARCHAR')} || ' steel' AS jamo FROM part")
def text_jamo(spark, d):
    t = F.translate(s(part_key()), "".join(_SYLLABLES), "".join(v[0] for v in _SYLLABLES.values()))
    return parts(spark, d).select("p_partkey", text.to_jamo(F.concat(t, F.lit(" steel"))).alias("jamo"))


@query("SELECT p_partkey, p_name AS title FROM part")
def text_canonical_title(spark, d):
    t = F.concat(pick(part_key(), "[긴급] ", "", "[재공고][일반] "), pick(part_size(), "2026년 ", "'26년도 ", "26년 "), part_name(), pick(part_key(), " (협상에 의한 계약)", " (긴급)", ""))
    return parts(spark, d).select("p_partkey", text.canonical_title(t).alias("title"))


_SPOKEN, _CANON = ("스쿨존", "DRT", "홈페이지", "스마트 버스정류장", "리노베이션"), ("어린이보호구역", "수요응답형교통", "누리집", "스마트쉘터", "리모델링")


@query(f"""SELECT p_partkey, p_name || ' ' || {sql_pick('p_partkey', *_CANON)} || ' 정비' AS title, {sql_pick('p_partkey', *_CANON)} AS terms FROM part""")
def text_synonyms(spark, d):
    t = F.concat_ws(" ", part_name(), pick(part_key(), *_SPOKEN), F.lit("정비"))
    return parts(spark, d).select("p_partkey", text.canonicalize(t).alias("title"), F.array_join(text.canonical_terms(t), "|").alias("terms"))


_GRAM = "list_distinct(CASE WHEN length({t}) < {n} THEN [] ELSE list_transform(range(1, length({t}) - {n} + 2), lambda i: substring({t}, i, {n})) END)"


def _jaccard_sql(n: int) -> str:
    a, b = (_GRAM.format(t=f"replace({c}, ' ', '')", n=n) for c in ("a.p_name", "b.p_name"))
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


@query(f"""SELECT a.p_partkey, round(greatest({_jaccard_sql(2)}, {_jaccard_sql(3)}, 0.8::DOUBLE * CASE WHEN a.p_partkey % 3 = 0 AND b.p_partkey % 3 = 0 THEN 1 ELSE 0 END), 6) AS similarity
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 3 WHERE a.p_partkey % 3 <> 0""")
def text_title_similarity(spark, d):
    p = spread(parts(spark, d).select("p_partkey", F.concat(F.lit("[긴급] 2026년 "), part_name()).alias("t")))
    a, b = p.filter(part_key() % 3 != 0), p.select((part_key() - 3).alias("p_partkey"), F.col("t").alias("u"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(text.title_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


_TERM, _GU = ("누리집", "챗봇", "CCTV", ""), ("강남구", "서초구", "", "중구보건소")


@query(f"""WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', *_TERM)} AS a, {sql_pick('p_size', *_TERM)} AS b, {sql_pick('p_partkey', '강남구', '서초구', '', '중구')} AS ga, {sql_pick('p_size', '강남구', '서초구', '', '중구')} AS gb FROM part)
SELECT p_partkey, a <> '' AND b <> '' AND a <> b AS terms, ga <> '' AND gb <> '' AND ga <> gb AS places FROM x""")
def text_conflicts(spark, d):
    titled = lambda c: F.concat(part_name(), F.lit(" "), pick(c, *_TERM), F.lit(" 구매"))
    dept = lambda c: F.concat(pick(c, *_GU), F.lit(" 교통과"))
    return spread(parts(spark, d)).select("p_partkey", text.terms_conflict(titled(part_key()), titled(part_size())).alias("terms"), text.jurisdiction_conflict(dept(part_key()), dept(part_size())).alias("places"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN left(own, 2) = left(lpad((p_partkey % 60)::VARCHAR, 2, '0') || '110', 2) ELSE own = lpad((p_partkey % 60)::VARCHAR, 2, '0') || '110' END AS matches
FROM (SELECT p_partkey, p_size, lpad((p_size % 20)::VARCHAR, 2, '0') || '110' AS own FROM part)""")
def text_region_match(spark, d):
    code = lambda c, n: F.concat(F.lpad(s(c % n), 2, "0"), F.lit("110"))
    wanted = F.when(part_size() % 2 == 0, F.substring(code(part_key(), 60), 1, 2)).otherwise(code(part_key(), 60))
    return parts(spark, d).select("p_partkey", text.region_matches(code(part_size(), 20), wanted).alias("matches"))


_MAGIC = {"application/pdf": "255044462D312E37", "application/x-hwp": "D0CF11E0A1B11AE1", "application/hwp+zip": "504B030414000600", "application/octet-stream": "3C68746D6C3E0A0A"}


@query(f"SELECT p_partkey, {sql_pick('p_partkey', *_MAGIC)} AS mime FROM part")
def text_mime_sniff(spark, d):
    raw = F.unhex(F.concat(pick(part_key(), *_MAGIC.values()), F.hex(part_name())))
    return parts(spark, d).select("p_partkey", text.sniff_mime(raw).alias("mime"))


@query("SELECT doc_id, 512::BIGINT AS dims, CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def text_embedding(spark, d):
    v = table(spark, d, "documents").select("doc_id", udfs.embed(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query("SELECT doc_id, text AS decoded FROM documents")
def text_decode(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.decode(F.encode("text", "UTF-8")).alias("decoded"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '00,000원 ' || p_name AS fixed FROM part")
def text_ocr_numbers(spark, d):
    raw = F.concat(s(part_size()), pick(part_key(), "00,00O 윈 ", "00, 000원 ", "0O,000웬 "), part_name())
    return parts(spark, d).select("p_partkey", udfs.ocr_corrected(raw).alias("fixed"))


# --- money ---------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, ((p_partkey % 90 + 1) * 100000000 + p_size * 10000) || '|' || (p_size * 1000) || '|' || (p_partkey % 9 + 1) * 10000000000000 AS amounts,
  (p_partkey % 90 + 1) || '억 ' || p_size || '만원' AS first_raw, 2::BIGINT AS first_at, (p_partkey % 9 + 1) * 10000000000000 AS largest FROM part""")
def money_amounts(spark, d):
    t = F.concat(F.lit("총 "), s(part_key() % 90 + 1), F.lit("억 "), s(part_size()), F.lit("만원, 별도 "), F.format_number(part_size() * 1000, 0), F.lit("원 및 "), s(part_key() % 9 + 1), F.lit("십조 원"))
    out = parts(spark, d).select("p_partkey", money.find_amounts(t).alias("a"), money.parse_krw(t).alias("largest"))
    first = F.get("a", F.lit(0))
    return out.select("p_partkey", F.array_join(F.transform("a", lambda x: s(x["value"])), "|").alias("amounts"), first["raw"].alias("first_raw"), first["start"].cast("long").alias("first_at"), "largest")


@query("""SELECT p_partkey, CAST(n AS INTEGER) AS nth, CASE n WHEN 0 THEN (p_partkey % 90 + 1) * 100000000 + p_size * 10000 WHEN 1 THEN p_size * 1000 ELSE (p_partkey % 9 + 1) * 10000000000000 END AS amount, CASE WHEN n = 0 THEN (p_partkey % 90 + 1) || '억 ' || p_size || '만원' END AS first_raw FROM part, range(3) r(n)""")
def sql_find_amounts(spark, d):
    """SQL calls the table function on a table; whatever columns that has come along."""
    udfs.register(spark)
    t = F.concat(F.lit("총 "), s(part_key() % 90 + 1), F.lit("억 "), s(part_size()), F.lit("만원, 별도 "), F.format_number(part_size() * 1000, 0), F.lit("원 및 "), s(part_key() % 9 + 1), F.lit("십조 원"))
    found = spark.sql("SELECT * FROM find_amounts(TABLE({t}), 'words')", t=parts(spark, d).select("p_partkey", t.alias("words")))
    nth = F.row_number().over(Window.partitionBy("p_partkey").orderBy("start_at")) - 1
    return found.select("p_partkey", nth.cast("int").alias("nth"), "amount", "raw").withColumn("first_raw", F.when(F.col("nth") == 0, F.col("raw"))).drop("raw")


@query(f"SELECT p_partkey, {'[1, 1000, 10000, 1000000, 100000000]'}[CAST(p_partkey % 5 AS INTEGER) + 1]::BIGINT AS factor FROM part")
def money_table_unit(spark, d):
    t = F.concat(part_name(), F.lit("\n( 단위 : "), pick(part_key(), "원", "천원", "만원", "백만원", "억원"), F.lit(" )"))
    return parts(spark, d).select("p_partkey", money.table_unit(t).cast("long").alias("factor"))


# --- time ----------------------------------------------------------------------------------------------------------
_WHEN = ("2027년 하반기에", "'26년 추진", "내년 상반기", "하반기에", "3월부터", "내후년에", "언젠가")


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 0 THEN 2027 WHEN 1 THEN 2026 WHEN 2 THEN y + 1 WHEN 3 THEN y WHEN 4 THEN y + (m > 6)::INT WHEN 5 THEN y + 2 END AS INTEGER) AS year,
  CASE k WHEN 0 THEN 'H2' WHEN 2 THEN 'H1' WHEN 3 THEN 'H2' WHEN 4 THEN 'H1' END AS half FROM x""")
def timing_resolve(spark, d):
    t = timing.resolve_timing(pick(F.col("o_orderkey"), *_WHEN), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", "t.year", "t.half")


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, year(a) || '년 ' || month(a) || CASE WHEN year(a) = year(b) AND month(a) = month(b) THEN '월' WHEN year(a) = year(b) THEN '~' || month(b) || '월' ELSE '월~' || year(b) || '년 ' || month(b) || '월' END AS span FROM x""")
def timing_month_span(spark, d):
    a = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", timing.month_span(a, F.date_add(a, (F.col("o_orderkey") % 500).cast("int"))).alias("span"))


@query("""WITH x AS (SELECT o_orderkey, l_linenumber, o_orderkey % 6 AS sa, l_linenumber % 6 AS sb, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, o_orderstatus = 'F' OR sa >= 4 AS is_out, CASE WHEN sa <= sb THEN date_diff('day', a, b) >= -60 ELSE date_diff('day', b, a) >= -60 END AS plausible FROM x""")
def timing_stage_order(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = pick(F.col("o_orderkey"), *K.STAGES), pick(F.col("l_linenumber"), *K.STAGES)
    at, then = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    published = F.when(F.col("o_orderstatus") == "F", at)
    return x.select("o_orderkey", "l_linenumber", timing.tender_is_out(a, published).alias("is_out"), timing.plausible_order(a, at, b, then).alias("plausible"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS sa, l_linenumber % 6 AS sb, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, round(greatest(0::DOUBLE, 1 - CASE WHEN greatest(date_diff('day', b + 30, a), date_diff('day', a, b), 0) > 540 THEN 0.6 ELSE 0 END - CASE WHEN sa < sb AND date_diff('day', b, a) > 60 THEN 0.7 ELSE 0 END), 6) AS value FROM x""")
def score_timeline(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    at, then = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    v = scores.timeline_plausibility(pick(F.col("o_orderkey"), *K.STAGES), at, pick(F.col("l_linenumber"), *K.STAGES), then, F.date_add(then, 30), then)
    return x.select("o_orderkey", "l_linenumber", F.round(v, 6).alias("value"))


# --- lexicons and scores --------------------------------------------------------------------------------------------
_SAID = {"반영하겠습니다": "committed", "추진할 계획": "planned", "적극 검토": "reviewing", "어렵습니다": "declined", "좋습니다": None, "어렵습니다만 확정": "committed"}


@query(f"SELECT p_partkey, nullif({sql_pick('p_partkey', *[v or '' for v in _SAID.values()])}, '') AS level FROM part")
def score_commitment(spark, d):
    return parts(spark, d).select("p_partkey", scores.commitment(F.concat(part_name(), F.lit(" "), pick(part_key(), *_SAID))).alias("level"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'record' WHEN 1 THEN 'procedure' WHEN 2 THEN 'budget_line' ELSE 'exchange' END AS kind, p_partkey % 2 = 0 AS verb, p_partkey % 3 = 0 AS word, p_size % 2 = 0 AS said, p_size % 3 = 0 AS soon, p_size % 5 = 0 AS noise, p_size % 7 = 0 AS amount FROM part)
SELECT p_partkey, CASE kind WHEN 'record' THEN 1 WHEN 'procedure' THEN 0 ELSE round(1 / (1 + exp(-(-2.4::DOUBLE + 0.55::DOUBLE * verb::INT + 0.6::DOUBLE * word::INT + 1.3::DOUBLE * said::INT + 0.45::DOUBLE * soon::INT - 0.9::DOUBLE * noise::INT + (1.1::DOUBLE * amount::INT + 1.6::DOUBLE * (kind = 'budget_line')::INT)))), 4) END AS score FROM x""")
def score_triage(spark, d):
    word = lambda c, n, w: F.when(c % n == 0, w)
    t = F.concat_ws(" ", part_name(), word(part_key(), 2, "용역"), word(part_key(), 3, "주차"), word(part_size(), 2, "확정"), word(part_size(), 3, "내후년"), word(part_size(), 5, "속기"))
    kind = F.when(part_key() % 11 == 0, "record").when(part_key() % 11 == 1, "procedure").when(part_key() % 11 == 2, "budget_line").otherwise("exchange")
    return parts(spark, d).select("p_partkey", scores.triage(t, kind, part_size() % 7 == 0).alias("score"))


_TITLES = {"도서관 리모델링": "facility", "누리집 개편": "public_sw", "스마트쉘터 설치": "smart_city", "어르신 돌봄 IoT": "welfare_care", "공영주차장 조성": "mobility", "교육 공연 축제": "other", "장비 구입": "safety_cctv", "이름 없음": "other"}


@query(f"SELECT p_partkey, {sql_pick('p_partkey', *_TITLES.values())} AS category FROM part")
def score_budget_category(spark, d):
    found = extract.budget_category(pick(part_key(), *_TITLES), F.concat(F.lit(" ○ 방범 CCTV "), part_name(), F.lit("\n다음 사업 1,000 900 100\n ○ 주차")))
    return parts(spark, d).select("p_partkey", found["category"].alias("category"))


@query("""WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS k, replace(p_type || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name ELSE '' END, ' ', '') AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(k, lambda w: contains(t, w)), '|') AS hits FROM x""")
def score_keyword_hits(spark, d):
    t = F.concat_ws(" ", "p_type", "p_brand", F.when(part_key() % 2 == 0, part_name()))
    return parts(spark, d).select("p_partkey", F.array_join(scores.keyword_hits(F.split("p_name", " "), t), "|").alias("hits"))


_PRIOR = "([0.35, 0.7, 0.85, 0.95, 1.0, 1.0]::DOUBLE[])"
_LEVELS = ("committed", "planned", "reviewing", "declined", "unsaid")


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % 6 AS st, {_PRIOR}[CAST(p_partkey % 6 AS INTEGER) + 1] * CASE WHEN p_partkey % 6 = 0 THEN ([1.6, 1.2, 0.6, 0.15, 1.0]::DOUBLE[])[CAST(p_size % 5 AS INTEGER) + 1] ELSE 1 END AS prior,
  CASE WHEN p_size % 4 = 0 THEN 0.4::DOUBLE END AS calibrated, p_size % 7 AS docs FROM part)
SELECT p_partkey, CASE WHEN st >= 4 THEN 1 ELSE round(least(0.98::DOUBLE, coalesce(calibrated, prior) + 0.05::DOUBLE * least(greatest(docs - 1, 0), 3)), 3) END AS probability FROM x""")
def score_conversion(spark, d):
    p = scores.conversion_probability(pick(part_key(), *K.STAGES), pick(part_size(), *_LEVELS), part_size() % 7, F.when(part_size() % 4 == 0, 0.4))
    return parts(spark, d).select("p_partkey", p.alias("probability"))


@query("""WITH x AS (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS sem, (p_partkey % 10) / 10.0::DOUBLE AS title, CASE WHEN p_partkey % 3 = p_size % 3 THEN 1 WHEN p_partkey % 3 = 2 OR p_size % 3 = 2 THEN 0.5 ELSE 0 END::DOUBLE AS cat, (p_partkey % 5) / 4.0::DOUBLE AS b, (p_size % 3) / 2.0::DOUBLE AS t FROM part)
SELECT p_partkey, round(0.35::DOUBLE * greatest(sem - 0.2::DOUBLE, 0) + 0.3::DOUBLE * title + 0.15::DOUBLE * cat + 0.1::DOUBLE * b + 0.1::DOUBLE * t - CASE WHEN p_partkey % 7 = 0 THEN 0.15 ELSE 0 END::DOUBLE, 4) AS score FROM x""")
def score_candidate(spark, d):
    cat = scores.category_agreement(pick(part_key(), "a", "b", "other"), pick(part_size(), "a", "b", "other"))
    v = scores.candidate_score(part_size() % 11 / 10 - 0.2, part_key() % 10 / 10, cat, part_key() % 5 / 4, part_size() % 3 / 2, part_key() % 7 == 0)
    return parts(spark, d).select("p_partkey", v.alias("score"))


@query("""WITH x AS (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS sem, p_partkey % 4 AS hits, p_partkey % 7 = 0 AS bad, (p_partkey % 2)::DOUBLE AS cat, (p_size % 2)::DOUBLE AS reg, (p_partkey % 5) / 4.0::DOUBLE AS b, (p_size % 5) / 5.0::DOUBLE AS c, (p_partkey % 3) / 2.0::DOUBLE AS l FROM part)
SELECT p_partkey, round((0.26::DOUBLE * least(greatest((sem - 0.05::DOUBLE) / 0.45::DOUBLE, 0), 1) + 0.22::DOUBLE * least(hits / 2, 1) + 0.12::DOUBLE * cat + 0.08::DOUBLE * reg + 0.08::DOUBLE * b + 0.14::DOUBLE * c + 0.1::DOUBLE * l) * CASE WHEN bad THEN 0.2 ELSE 1 END::DOUBLE, 4) AS score FROM x""")
def score_recommendation(spark, d):
    many = lambda n: F.array_repeat(F.lit("w"), n.cast("int"))
    v = scores.recommendation_score(part_size() % 11 / 10, many(part_key() % 4), many((part_key() % 7 == 0).cast("int")), (part_key() % 2).cast("double"), (part_size() % 2).cast("double"), part_key() % 5 / 4, part_size() % 5 / 5, part_key() % 3 / 2)
    return parts(spark, d).select("p_partkey", v.alias("score"))


@query("""WITH x AS (SELECT p_partkey, p_size * 1000.0::DOUBLE AS a, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 20) * 1000.0::DOUBLE END AS lo, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 20 + 10) * 1000.0::DOUBLE END AS hi FROM part)
SELECT p_partkey, round(CASE WHEN lo IS NULL AND hi IS NULL THEN 0.5 WHEN (lo IS NULL OR a >= lo) AND (hi IS NULL OR a <= hi) THEN 1 ELSE greatest(0, 1 - abs(ln(a / CASE WHEN a < lo THEN lo ELSE hi END)) / ln(4)) END, 6) AS fit FROM x""")
def score_budget_range(spark, d):
    lo, hi = F.when(part_key() % 5 > 0, part_key() % 20 * 1000.0), F.when(part_key() % 3 > 0, (part_key() % 20 + 10) * 1000.0)
    return parts(spark, d).select("p_partkey", F.round(scores.budget_fit(part_size() * 1000.0, lo, hi), 6).alias("fit"))


# --- names ------------------------------------------------------------------------------------------------------------
_SIDO, _BODY, _DEPT = ("경기도", "서울특별시", "", "강원특별자치도"), ("수원시", "강남구", "여주군"), ("교통과", "", "도로과 시설팀")


@query(f"""WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', *_SIDO)} AS sido, {sql_pick('p_size', *_BODY)} AS body, {sql_pick('p_partkey', *_DEPT)} AS dept, p_size % 2 = 0 AS council FROM part)
SELECT p_partkey, nullif(sido, '') AS sido, body AS sigungu, council, nullif(dept, '') AS department FROM x""")
def name_parser(spark, d):
    raw = F.concat_ws(" ", F.nullif(pick(part_key(), *_SIDO), F.lit("")), F.concat(pick(part_size(), *_BODY), F.when(part_size() % 2 == 0, "의회").otherwise("청")), F.nullif(pick(part_key(), *_DEPT), F.lit("")))
    return parts(spark, d).select("p_partkey", resolve.parsed(raw).alias("p")).select("p_partkey", "p.*")


_BODIES = {"수원시": (False, True), "강남구의회": (False, True), "한국도로공사": (True, False), "서울특별시": (False, True), "여주군 초등학교": (True, False), "강원특별자치도 보건의료원": (False, True), "각 수요기관": (False, False), "(주)별빛": (False, False)}


def _flags(i: int) -> str:
    return "[" + ", ".join(str(v[i]).lower() for v in _BODIES.values()) + f"][CAST(p_partkey % {len(_BODIES)} AS INTEGER) + 1]"


@query(f"SELECT p_partkey, {_flags(0)} AS own_body, {_flags(1)} AS local_government, p_partkey % {len(_BODIES)} = 6 AS no_body FROM part")
def name_shapes(spark, d):
    n = pick(part_key(), *_BODIES)
    return parts(spark, d).select("p_partkey", resolve.is_own_body(n).alias("own_body"), resolve.looks_local(n).alias("local_government"), resolve.names_nobody(n).alias("no_body"))


_ROLES, _WHO = ("도로과장", "도시건설위원장", "의원", "부의장"), ("송태아", "조우현", "김한솔")


@query(f"SELECT p_partkey, {sql_pick('p_partkey', '도로과장', '위원장', '의원', '부의장')} AS role, {sql_pick('p_size', *_WHO)} AS name FROM part")
def name_caption(spark, d):
    who = F.when(part_size() % 2 == 0, F.regexp_replace(pick(part_size(), *_WHO), "(.)(.)(.)", "$1 $2 $3")).otherwise(pick(part_size(), *_WHO))
    shown = F.when(part_key() % 4 == 2, F.concat_ws(" ", pick(part_size(), *_WHO), F.lit("의원"))).otherwise(F.concat_ws(" ", part_name(), pick(part_key(), *_ROLES), who))
    return parts(spark, d).select("p_partkey", parse.parse_caption(shown).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, replace(p_name, ' ', '|') AS tokens FROM part")
def name_title_tokens(spark, d):
    t = F.concat(F.lit("2026년도 "), part_name(), F.lit(" 노후 시설 "), s(part_size()), F.lit(" 설치 "), part_name())
    return parts(spark, d).select("p_partkey", F.array_join(retrospective.name_tokens(t), "|").alias("tokens"))


_AFFIX = """list_max(list_transform(list_filter(range(3, length({w}) + 1), lambda n: contains(t, left({w}, n)) OR contains(t, right({w}, n))), lambda n: n))"""


@query(f"""WITH x AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, left(string_split(p_name, ' ')[1], CAST(p_size % 3 + 2 AS INTEGER)) || '-' || right(string_split(p_name, ' ')[2], CAST(p_partkey % 3 + 2 AS INTEGER)) || '.' AS t FROM part),
y AS (SELECT *, coalesce({_AFFIX.format(w='a')}, 0) AS na, coalesce({_AFFIX.format(w='b')}, 0) AS nb FROM x)
SELECT p_partkey, round((na + nb) / (length(a) + length(b)), 6) AS score FROM y""")
def name_affix_overlap(spark, d):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    t = F.concat(F.substring(a, F.lit(1), (part_size() % 3 + 2).cast("int")), F.lit("-"), F.right(b, (part_key() % 3 + 2).cast("int")), F.lit("."))
    return parts(spark, d).select("p_partkey", F.round(retrospective.overlap(F.split("p_name", " "), t)["score"], 6).alias("score"))


_HOLDS = {("경기도 건설본부", "경기도"): True, ("경기도 수원시", "경기도"): False, ("경기도교육청", "경기도"): False, ("수원시 도로과", "수원시"): True, ("용인시", "수원시"): False, ("경기도 여주시 상하수도사업소", "여주시"): True}


@query(f"""SELECT p_partkey, {'[' + ', '.join(str(v).lower() for v in _HOLDS.values()) + f'][CAST(p_partkey % {len(_HOLDS)} AS INTEGER) + 1]'} AS belongs, trim(p_name) AS rest FROM part""")
def name_places(spark, d):
    demand, body = (pick(part_key(), *[k[i] for k in _HOLDS]) for i in (0, 1))
    rest = F.trim(retrospective.without_place(F.concat(body, F.lit(" "), part_name()), body))
    return parts(spark, d).select("p_partkey", retrospective.belongs_to(demand, body).alias("belongs"), rest.alias("rest"))


@query("""SELECT p_partkey, p_partkey % 4 < 3 OR reverse(p_name) = p_name AS grows FROM part""")
def name_only_grows(spark, d):
    @F.pandas_udf("boolean")
    def grows(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.only_grows(x, y) for x, y in zip(a, b, strict=True)])

    other = F.when(part_key() % 4 == 0, F.concat(part_name(), F.lit(" 2"))).when(part_key() % 4 == 1, F.concat(F.lit("new "), part_name())).when(part_key() % 4 == 2, F.substring(part_name(), F.lit(2), F.length(part_name()))).otherwise(F.reverse("p_name"))
    return parts(spark, d).select("p_partkey", grows(part_name(), other).alias("grows"))


# --- evidence -----------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, true AS found, 'exact' AS method, CAST(length(p_name) + 3 AS INTEGER) AS "start", CAST(length(p_name) + 3 + length(p_type) + 3 + length(p_brand) AS INTEGER) AS "end" FROM part""")
def evidence_offsets(spark, d):
    source = F.concat(part_name(), F.lit("\n: "), F.col("p_type"), F.lit(" \t "), F.col("p_brand"), F.lit(" end"))
    quote = F.concat(F.lit(" “"), F.col("p_type"), F.lit("  "), F.col("p_brand"), F.lit("” "))
    q = grounding.locate_quote(source, quote)
    return parts(spark, d).select("p_partkey", q.alias("q")).select("p_partkey", "q.found", "q.method", "q.start", "q.end")


_SPEECH = {
    ("○교통과장 박세찌  하반기에 버스 정류장을 발주할 예정입니다.", "planned"): None,
    ("○교통과장 박세찌  버스 정류장을 추진할 계획이 전혀 없습니다.", "planned"): "commitment_denied",
    ("○교통과장 박세찌  예산이 확보되면 버스 정류장을 추진하겠습니다.", "committed"): "commitment_conditional",
    ("○이두리 의원  하반기에 버스 정류장을 발주할 예정입니다.", "planned"): "official_evidence_missing",
    ("○교통과장 박세찌  버스 정류장을 하반기에 발주할 예정입니까?", "planned"): "official_evidence_missing",
}


@query(f"SELECT p_partkey, nullif({sql_pick('p_partkey', *[v or '' for v in _SPEECH.values()])}, '') AS issue FROM part")
def evidence_speech_issue(spark, d):
    said, level = (pick(part_key(), *[k[i] for k in _SPEECH]) for i in (0, 1))
    whole = F.concat(said, F.lit("\n"))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.length(said).alias("end")))
    return parts(spark, d).select("p_partkey", grounding.speech_issue(whole, spans, level).alias("issue"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 5 AS k, p_size % 4 AS f FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN f = 0 THEN 'evidence_not_found' WHEN f = 1 THEN 'partial_evidence' END, CASE WHEN k = 1 THEN 'budget_mismatch' WHEN k = 2 THEN 'budget_unsupported' END, CASE WHEN k = 3 THEN 'year_unverified' END, CASE WHEN k = 4 THEN 'low_confidence' END], lambda v: v IS NOT NULL), '|') AS issues,
  CASE WHEN f = 0 THEN 'rejected' WHEN f = 1 OR k > 0 THEN 'needs_review' ELSE 'accepted' END AS verdict FROM x""")
def evidence_verdict(spark, d):
    quote = lambda ok: F.struct(ok.alias("found"))
    evidence = F.array(quote(part_size() % 4 > 0), quote(part_size() % 4 > 1))
    k = part_key() % 5
    v = grounding.verdict(evidence, F.lit(100), F.when(k != 2, 90), ~k.isin(1, 2), F.lit(2026), F.when(k == 3, 2025).otherwise(2026), F.when(k == 4, 0.3).otherwise(0.6))
    return parts(spark, d).select("p_partkey", v.alias("v")).select("p_partkey", F.array_join("v.issues", "|").alias("issues"), "v.verdict")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'keyword: ' || replace(p_name, ' ', ', ') END, CASE WHEN p_partkey % 6 < 2 THEN 'before procurement' END,
  CASE WHEN p_size > 10 THEN 'about ' || CAST(ceil((p_size - 10) / 30) AS BIGINT) || ' months ahead' END, CASE WHEN p_size % 3 > 0 THEN 'budget known' END], lambda v: v IS NOT NULL), '|') AS reasons FROM part""")
def card_reasons(spark, d):
    hits = F.when(part_key() % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return parts(spark, d).select("p_partkey", F.array_join(market.reasons(hits, pick(part_key(), *K.STAGES), part_size() - 10, part_size() % 3), "|").alias("reasons"))
