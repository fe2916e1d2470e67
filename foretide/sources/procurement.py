"""Procurement records: three kinds of provider items mapped to raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_AMOUNT = 10_000

# Fixed tables: which fields of an item hold what, the first that is filled counts.
FIELDS = {
    "order_plan": {
        "ext": ("orderPlanUntyNo", "orderPlanNo"), "title": ("bizNm", "prdctClsfcNoNm", "cnstwkNm"), "published": ("nticeDt", "rgstDt", "chgDt"),
        "amount": ("sumOrderAmt", "orderAmt", "asignBdgtAmt"), "publisher": ("orderInsttNm", "dminsttNm"), "code": ("orderInsttCd", "dminsttCd"),
        "department": ("deptNm", "orderInsttDeptNm"), "bids": ("bidNtceNoList",),
    },
    "prespec": {
        "ext": ("bfSpecRgstNo",), "title": ("prdctClsfcNoNm", "bfSpecNm", "bizNm"), "published": ("rcptDt", "rgstDt"), "amount": ("asignBdgtAmt",),
        "publisher": ("rlDminsttNm", "orderInsttNm"), "code": ("rlDminsttCd", "orderInsttCd"), "department": ("orderInsttDeptNm",), "bids": ("bidNtceNoList",),
        "plan": ("orderPlanUntyNo",),
    },
    "bid_notice": {
        "ext": ("bidNtceNo",), "title": ("bidNtceNm",), "published": ("bidNtceDt", "rgstDt"), "amount": ("asignBdgtAmt", "bdgtAmt", "presmptPrce"),
        "publisher": ("dminsttNm", "ntceInsttNm"), "code": ("dminsttCd", "ntceInsttCd"), "prespec": ("bfSpecRgstNo",), "plan": ("orderPlanUntyNo",),
        "revision": ("bidNtceOrd",), "kind": ("ntceKindNm",),
    },
}


def filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the fields that is there and not blank."""
    own = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def compact_date(c: Column) -> Column:
    """A date from digits with anything between them; six digits are a month."""
    d = F.regexp_replace(c.cast("string"), r"\D", "")
    text = F.when(F.length(d) >= 8, F.substring(d, 1, 8)).when(F.length(d) == 6, F.concat(d, F.lit("01")))
    return F.try_to_date(text, "yyyyMMdd")


def whole(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.trim(c.cast("string")), ",", ""), ".", 1).try_cast("long")


def amount(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first amount that is no placeholder."""
    own = [F.when(whole(F.col(n)) >= LEAST_AMOUNT, whole(F.col(n))) for n in names if n in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("long")


def bid_numbers(c: Column) -> Column:
    """Tender numbers of a comma list, a trailing revision of the known form cut off, each once."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""), ",")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^(R\d{2}[A-Z]{2}\d{8})\d{3}$", "$1"))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


def map_items(items: DataFrame, doc_type: str) -> DataFrame:
    """Raw records of one kind of item; rows without number, title or date are left out."""
    f = FIELDS[doc_type]
    get = lambda k: filled(items, f.get(k, ()))
    ext = get("ext")
    if doc_type == "bid_notice":
        ext = F.concat(ext, F.lit("-"), F.coalesce(get("revision"), F.lit("000")))
    cancel = get("kind") == "취소공고"
    number = get("ext") if doc_type == "bid_notice" else F.lit(None).cast("string")
    refs = F.struct(
        (get("ext") if doc_type == "order_plan" else get("plan")).alias("order_plan_no"), (get("ext") if doc_type == "prespec" else get("prespec")).alias("prespec_no"),
        F.when(~F.coalesce(cancel, F.lit(False)), number).alias("bid_notice_no"), bid_numbers(get("bids")).alias("bid_notice_nos"),
        F.when(cancel, number).alias("cancels_bid_notice_no"),
    )
    out = items.select(
        ext.alias("external_id"), F.lit(doc_type).alias("doc_type"), get("title").alias("title"), compact_date(get("published")).alias("published_at"),
        amount(items, f["amount"]).alias("amount_krw"), get("publisher").alias("publisher_raw"), get("code").alias("provider_code"), get("department").alias("department"), refs.alias("refs"),
    )
    return out.filter("external_id is not null and title is not null and published_at is not null")


def record_text(stage_label: Column, title: Column, publisher: Column, department: Column, amount_: Column) -> Column:
    """A structured record as one line of text; what is missing is left out."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" | ", F.concat(F.lit("["), stage_label, F.lit("] "), title), part("수요기관", publisher), part("부서", department), part("금액", F.concat(F.format_number(amount_, 0), F.lit("원"))))


def health(items: DataFrame, doc_type: str) -> DataFrame:
    """Share of items that map, and of mapped ones that have each optional field."""
    mapped = map_items(items, doc_type)
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 4).alias(c)
    return items.agg(F.count("*").alias("items")).crossJoin(mapped.agg(F.count("*").alias("mapped"), share("amount_krw"), share("publisher_raw"), share("provider_code"), share("department")))
