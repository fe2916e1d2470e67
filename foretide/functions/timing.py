"""When a tender will come: years and halves in speech, forecast windows, what is left of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretide.constants import BID_LAG_DAYS, RELATIVE_YEARS, STAGES


def stage_order(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)]), c)


def half_of(c: Column) -> Column:
    """H1 or H2 by word, else by the first month named."""
    month = F.regexp_extract(c, r"(\d{1,2})\s*월", 1).try_cast("int")
    return (
        F.when(c.contains("하반기") | c.contains("추경"), "H2")
        .when(c.contains("상반기") | c.contains("연초"), "H1")
        .when((month >= 1) & (month <= 6), "H1")
        .when((month >= 7) & (month <= 12), "H2")
    )


def resolve_timing(c: Column, reference: Column) -> Column:
    """struct(year, half): an absolute year, a short year, a relative word, or a half alone, in this order."""
    long_ = F.regexp_extract(c, r"(?<!\d)(20\d{2})\s*년", 1).try_cast("int")
    marked = F.regexp_extract(c, r"[’'`]\s?(\d{2})\s*년|(?<![\d.])(\d{2})\s*년도", 1).try_cast("int")
    plain = F.regexp_extract(c, r"[’'`]\s?(\d{2})\s*년|(?<![\d.])(\d{2})\s*년도", 2).try_cast("int")
    half, year = half_of(c), F.year(reference)
    relative = F.lit(None).cast("int")
    for word, ahead in reversed(RELATIVE_YEARS):
        relative = F.when(c.contains(word), year + ahead).otherwise(relative)
    alone = F.when(half == "H1", year + (F.month(reference) > 6).cast("int")).when(half == "H2", year)
    found = F.coalesce(long_, 2000 + F.coalesce(marked, plain), relative, alone)
    return F.when(found.isNotNull(), F.struct(found.alias("year"), half.alias("half")))


def forecast_window(stage: Column, observed: Column, year: Column, half: Column) -> Column:
    """struct(start, end) in which the tender is due: the expected half or year from ``observed`` on, else, or where
    that is past, the stage's usual lag."""
    lag = lambda i: F.element_at(F.create_map(*[F.lit(x) for s, v in BID_LAG_DAYS.items() for x in (s, v[i])]), stage)
    day = lambda m1, d1, m2, d2, m0, d0: (
        F.when(half == "H1", F.make_date(year, F.lit(m1), F.lit(d1)))
        .when(half == "H2", F.make_date(year, F.lit(m2), F.lit(d2)))
        .otherwise(F.make_date(year, F.lit(m0), F.lit(d0)))
    )
    start, end = day(1, 1, 7, 1, 1, 15), day(6, 30, 12, 31, 11, 30)
    by_year = year.isNotNull() & (end >= observed)
    return F.struct(
        F.when(by_year, F.greatest(start, observed)).otherwise(F.date_add(observed, lag(0))).alias("start"),
        F.when(by_year, end).otherwise(F.date_add(observed, lag(1))).alias("end"),
    )


def remaining_window(start: Column, end: Column, today: Column, published: Column) -> Column:
    """struct(start, end, passed): the tender's date once it is out; a closed window as it was, flagged; else from
    today on."""
    last = F.coalesce(end, start)
    over = published.isNull() & start.isNotNull() & (last < today)
    return F.struct(
        F.when(published.isNotNull(), published).when(over | start.isNull(), start).otherwise(F.greatest(start, today)).alias("start"),
        F.when(published.isNotNull(), published).when(start.isNotNull(), end).alias("end"),
        F.coalesce(over, F.lit(False)).alias("passed"),
    )


def month_span(start: Column, end: Column) -> Column:
    """A window as people say it."""
    ym = lambda c: F.concat(F.year(c).cast("string"), F.lit("년 "), F.month(c).cast("string"))
    same = end.isNull() | ((F.year(start) == F.year(end)) & (F.month(start) == F.month(end)))
    later = F.when(F.year(start) == F.year(end), F.month(end).cast("string")).otherwise(F.concat(F.lit("월~"), ym(end)))
    return F.when(same, F.concat(ym(start), F.lit("월"))).otherwise(
        F.when(F.year(start) == F.year(end), F.concat(ym(start), F.lit("~"), later, F.lit("월"))).otherwise(F.concat(ym(start), later, F.lit("월")))
    )


def tender_is_out(stage: Column, published: Column) -> Column:
    return published.isNotNull() | (stage_order(stage) >= STAGES.index("bid_notice"))


def plausible_order(stage_a: Column, at_a: Column, stage_b: Column, at_b: Column, slack: int = 60) -> Column:
    """The later stage does not precede the earlier one by more than ``slack`` days."""
    a_first = stage_order(stage_a) <= stage_order(stage_b)
    return F.when(a_first, F.datediff(at_b, at_a) >= -slack).otherwise(F.datediff(at_a, at_b) >= -slack)
