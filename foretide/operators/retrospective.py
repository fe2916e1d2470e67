"""Matching forecasts with later notices by what their titles name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.functions.text import char_ngrams
from foretide.operators.ranking import first_per_key, top_k

# Fixed list: words that say what is done, not to what.
GENERIC = (
    "사업 사업비 용역 공사 구매 설치 제작 및 등 위한 추진 운영 관리 지원 조성 정비 개선 보수 확충 "
    "구축 도입 건립 신축 증축 개축 교체 설계 실시설계 기본설계 감리 건설사업관리 유지 유지관리 시설 "
    "시설물 개보수 리모델링 보강 재정비 확장 이전 신설 계획 기본계획 수립 연구 조사 점검 진단 "
    "정밀안전진단 안전점검 물품 장비 시스템 노후 긴급 일반 기타 추가 신규 내 의 연간 단가 "
    "전면 부분 소규모 년 년도 년도분 차 1차 2차 3차 일원 일대 외 개소 식 대 회 건 종합 기반 "
    "시 구 동 공공 지역 시민 행정"
).split()
SUFFIXES = ("사업", "공사", "용역", "설치", "구매", "건립", "조성", "정비")
# Fixed table: how tenders shorten a province.
SHORT = {
    "충청북도": "충북", "충청남도": "충남", "전라북도": "전북", "전북특별자치도": "전북", "전라남도": "전남", "경상북도": "경북",
    "경상남도": "경남", "강원특별자치도": "강원", "강원도": "강원", "경기도": "경기", "제주특별자치도": "제주",
}


def name_tokens(title: Column) -> Column:
    """What a project name names: words without their usual ending, no generic ones, years or numbers, each once."""
    words = F.regexp_extract_all(title, F.lit("([가-힣A-Za-z0-9]+)"), F.lit(1))
    stem = lambda t: F.regexp_replace(t, rf"^(.{{2,}})(?:{'|'.join(SUFFIXES)})$", "$1")
    generic = F.array(*[F.lit(w) for w in GENERIC])
    keep = lambda t: (F.length(t) >= 2) & ~F.array_contains(generic, t) & ~t.rlike(r"^(?:(?:19|20)\d{2}(?:년|년도)?|\d+)$")
    return F.array_distinct(F.filter(F.transform(words, stem), keep))


def without_place(title: Column, institution: Column) -> Column:
    """A title without its own body's name, stem and short form."""
    stem = F.regexp_replace(institution, r"(특별자치시|특별자치도|특별시|광역시|시|군|구|도)$", "")
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv]), institution), F.lit(""))
    for name in (institution, stem, short):
        title = F.when(F.length(name) >= 2, F.replace(title, name, F.lit(" "))).otherwise(title)
    return title


def belongs_to(demand: Column, institution: Column) -> Column:
    """Whether a demand body is the institution or an office of it: anywhere for a city, but for a province neither a
    city below it nor another body that starts with its name."""
    province = institution.rlike(r"(?:도|특별자치도|특별시|광역시|특별자치시)$") & ~institution.rlike(r"^[가-힣]+(?:시|군|구)$")
    at = F.call_function("instr", demand, institution)
    rest = F.substring(demand, at + F.length(institution), F.length(demand))
    own = (rest == "") | (F.ltrim(rest) != rest)
    first = F.split(F.trim(rest), r"\s+")[0]
    return (at > 0) & (~province | (own & ~first.rlike("^[가-힣]+(?:시|군|구)$")))


def affix(part: Column, text: Column) -> Column:
    """The longest prefix or suffix of three characters or more that the text holds, or the whole of a short part."""
    sizes = F.reverse(F.sequence(F.lit(3), F.greatest(F.length(part), F.lit(3))))
    tried = F.transform(sizes, lambda n: F.when(F.contains(text, F.substring(part, F.lit(1), n)), F.substring(part, F.lit(1), n)).when(F.contains(text, F.substring(part, F.length(part) - n + 1, n)), F.substring(part, F.length(part) - n + 1, n)))
    long_ = F.get(F.array_compact(tried), 0)
    return F.when(F.length(part) >= 3, long_).when(F.contains(text, part), part)


def overlap(parts: Column, title: Column) -> Column:
    """struct(score, shared): the share of the parts' characters that the title holds, and by what."""
    text = F.regexp_replace(title, r"\s+", "")
    shared = F.array_compact(F.transform(parts, lambda p: affix(p, text)))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return F.struct(F.when(F.size(parts) > 0, chars(shared) / chars(parts)).otherwise(0.0).alias("score"), shared.alias("shared"))


def notice_candidates(signals: DataFrame, notices: DataFrame, least: float = 0.5, most: int = 8) -> DataFrame:
    """Notices of the same institution that each signal may have become: half of what it names in their title, three
    characters shared, later than it, the best eight."""
    s = signals.select("signal_id", "institution", "observed_at", name_tokens(without_place(F.col("title"), F.col("institution"))).alias("parts"))
    n = notices.select("notice_id", "institution", "notice_title", "notice_date")
    # What is shared begins or ends a part, so a notice holds the first or last three letters of one (all of a shorter
    # one): only such notices are looked at, not all of the institution.
    ends = F.flatten(F.transform("parts", lambda p: F.when(F.length(p) > 3, F.array(F.substring(p, F.lit(1), F.lit(3)), F.right(p, F.lit(3)))).otherwise(F.array(p))))
    compact = F.regexp_replace("notice_title", r"\s+", "")
    grams = F.array_distinct(F.concat(*[char_ngrams(compact, k) for k in (2, 3)]))
    hit = s.select("signal_id", "institution", "observed_at", F.explode(F.array_distinct(ends)).alias("g")).join(n.select("notice_id", "institution", "notice_date", F.explode(grams).alias("g")), ["institution", "g"])
    hit = hit.filter("notice_date > observed_at").select("signal_id", "notice_id").distinct()
    j = hit.join(s, "signal_id").join(n.drop("institution"), "notice_id")
    j = j.withColumn("o", overlap(F.col("parts"), F.col("notice_title")))
    j = j.filter((F.col("o.score") >= least) & (F.aggregate("o.shared", F.lit(0), lambda a, x: a + F.length(x)) >= 3))
    return top_k(j.select("signal_id", "notice_id", "notice_date", "o.score", "o.shared"), ["signal_id"], [F.desc("score"), F.asc("notice_date"), F.asc("notice_id")], most)


def census(notices: DataFrame) -> DataFrame:
    """Each notice once, the first read of its number and revision."""
    return first_per_key(notices, ["notice_no", "revision"], [F.asc("seq")])


def census_completeness(slices: DataFrame) -> DataFrame:
    """By operation: slices, those read in full, rows read and promised."""
    return slices.groupBy("operation").agg(F.count("*").alias("slices"), F.count_if(F.col("read") >= F.col("total")).alias("complete"), F.sum("read").alias("read"), F.sum("total").alias("total"))


def strata(judged: DataFrame) -> DataFrame:
    """Per stratum: signals, hits, median, least and greatest lead, and hits within the window among those eligible."""
    return judged.groupBy("stratum").agg(
        F.count("*").alias("signals"), F.count_if(F.col("hit")).alias("hits"), F.percentile(F.when(F.col("hit"), F.col("lead_days")), 0.5).alias("median_lead"),
        F.min("lead_days").alias("least_lead"), F.max("lead_days").alias("most_lead"), F.count_if(F.col("eligible")).alias("eligible"), F.count_if(F.col("eligible") & F.col("in_window")).alias("within"),
    )
