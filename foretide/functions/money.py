"""Amounts of won: spans in running text, table units, agreement, display."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretide.constants import AMOUNT_TOLERANCE, HANGUL_DIGITS, LARGE_UNITS, SMALL_UNITS, TABLE_UNITS

AMOUNTS = "array<struct<value bigint, start int, end int, raw string, won boolean>>"

# Fixed patterns: a number, a Hangul digit, a unit; a span of them; the spoken tail after 억 or 조 without a unit.
_N, _H, _U = r"\d[\d,]*(?:\.\d+)?", "[영공일이삼사오육륙칠팔구]", "[십백천만억조]"
_TAIL = r"(?<=[억조])\s?\d{1,4}(?![\d,.]|\s?[년월일개명건호차회층곳%])"
_SPAN = re.compile(
    rf"(?P<body>(?:{_N}|{_H})\s?{_U}+(?:\s?(?:(?:{_N}|{_H})\s?{_U}+|{_U}+))*(?:\s?{_N}(?=\s?원)|{_TAIL})?)\s?(?P<won>원)?"
    rf"|(?P<plain>{_N})\s?원"
)
_TOKEN = re.compile(rf"{_N}|{_H}|{_U}")
_GROUPED = re.compile(r"(?<![\d,.])\d{1,3}(?:,\d{3})+(?![\d,])")


def evaluate(body: str, spoken: bool) -> int:
    """Positional value of an amount: small units add up to a section, large units close it. In speech what follows
    억 or 조 without its own large unit counts one step of ten thousand below."""
    total, section, number, large = Decimal(0), Decimal(0), None, 0
    for t in _TOKEN.findall(body):
        if t in SMALL_UNITS:
            section += (1 if number is None else number) * SMALL_UNITS[t]
            number = None
        elif t in LARGE_UNITS:
            large = LARGE_UNITS[t]
            total += ((section + (number or 0)) or 1) * large
            section, number = Decimal(0), None
        else:
            section += number or 0
            number = Decimal(HANGUL_DIGITS[t]) if t in HANGUL_DIGITS else Decimal(t.replace(",", ""))
    scale = large // 10**4 if spoken and large >= 10**8 and ((section and number is None) or (not section and number is not None)) else 1
    return int(total + (section + (number or 0)) * scale)


def amounts_in(text: str, unit: int = 1, bare: bool = False) -> list[dict]:
    """Amount spans in order of search: grouped bare numbers (table cells) if ``bare``, then spans with a unit or 원."""
    out = []
    if bare:
        for m in _GROUPED.finditer(text):
            if not text[m.end() : m.end() + 1] or text[m.end()] not in "원천만억백":
                out.append({"value": int(m[0].replace(",", "")) * unit, "start": m.start(), "end": m.end(), "raw": m[0], "won": False})
    for m in _SPAN.finditer(text):
        body, won = m["body"], m["won"] is not None
        if body is None:
            value, won = int(Decimal(m["plain"].replace(",", ""))), True
        else:
            large = any(u in body for u in LARGE_UNITS)
            if body[0] in HANGUL_DIGITS and not (won and large):
                continue
            value = evaluate(body, spoken=not won)
            if not won and not large:
                value *= unit
        out.append({"value": value, "start": m.start(), "end": m.end(), "raw": m[0], "won": won})
    return out


def find_amounts(c: Column, unit: Column | int = 1, bare: bool = False) -> Column:
    """All amounts in a text, as an array of structs."""

    @F.pandas_udf(AMOUNTS)
    def run(t: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else amounts_in(x, int(n), bare) for x, n in zip(t, u, strict=True)])

    return run(c, F.lit(unit) if isinstance(unit, int) else unit)


@F.pandas_udf(T.LongType())
def parse_krw(t: pd.Series) -> pd.Series:
    """The largest amount, or the text's bare digits."""

    def one(x):
        if x is None:
            return None
        found = [a["value"] for a in amounts_in(x)]
        digits = x.strip().replace(",", "")
        return max(found) if found else int(digits) if digits.isdigit() else None

    return pd.Series([one(x) for x in t], dtype="Int64")


def table_unit(c: Column) -> Column:
    """The unit that a table's header names, as a factor; null without one."""
    name = F.regexp_extract(c, r"\(?\s*단위\s*[:：]\s*(천원|백만원|만원|억원|원)\s*\)?", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in TABLE_UNITS.items() for x in kv]), F.nullif(name, F.lit("")))


def amounts_agree(a: Column, b: Column, tolerance: float = AMOUNT_TOLERANCE) -> Column:
    return (a == b) | ((a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= tolerance))


def format_krw(c: Column) -> Column:
    """억 and 만 with thousands separators; the rest below 만 only where there is no 억."""
    eok, man, won = F.floor(c / 10**8), F.floor(c % 10**8 / 10**4), c % 10**4
    part = lambda n, unit: F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(unit)))
    text = F.concat_ws(" ", part(eok, "억"), part(man, "만"), F.when(eok == 0, part(won, "")))
    return F.when(c <= 0, "0원").otherwise(F.concat(text, F.lit("원")))


def parse_int(c: Column) -> Column:
    """Digits before the decimal point, commas dropped."""
    return F.substring_index(F.regexp_replace(F.trim(c), ",", ""), ".", 1).try_cast("long")
