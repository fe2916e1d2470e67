"""Text expressions. All are Catalyst expressions but ``normalize`` and ``normalize_with_map`` (NFKC is not in Spark)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretide.constants import SYNONYMS

_DROP = {0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0xAD: None}
_MARKS = {ord(c): "○" for c in "◯◎●〇"}


def normalize_text(t: str) -> str:
    import unicodedata

    t = unicodedata.normalize("NFKC", t).translate(_DROP).translate(_MARKS)
    return "\n".join(line.strip() for line in re.sub("[ \t 　]+", " ", t).splitlines())


@F.pandas_udf(T.StringType())
def normalize(s: pd.Series) -> pd.Series:
    """NFKC, no zero-width characters, one speaker mark, single blanks, stripped lines."""
    return s.map(normalize_text, na_action="ignore")


def collapse_text(t: str) -> str:
    return " ".join(normalize_text(t).split())


def with_map(t: str) -> tuple[str, list[int]]:
    """White space collapsed, and for each character left the place in ``t`` that it came from."""
    import unicodedata

    out, where = [], []
    for i, c in enumerate(t):
        for x in unicodedata.normalize("NFKC", c).translate(_DROP).translate(_MARKS):
            blank = x.isspace()
            if blank and (not out or out[-1] == " "):
                continue
            out.append(" " if blank else x)
            where.append(i)
    if out and out[-1] == " ":
        out.pop(), where.pop()
    return "".join(out), where


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType()))]))
def normalize_with_map(s: pd.Series) -> pd.DataFrame:
    got = [with_map(t) if t is not None else (None, None) for t in s]
    return pd.DataFrame({"text": [g[0] for g in got], "map": [g[1] for g in got]})


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hangul_tokens(c: Column, least: int = 2) -> Column:
    """Runs of Hangul syllables of at least ``least``."""
    return F.filter(F.regexp_extract_all(c, F.lit("([가-힣]+)"), F.lit(1)), lambda x: F.length(x) >= least)


def char_ngrams(c: Column, n: int) -> Column:
    """n-grams of the text without white space; none where it is shorter than n."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    none = F.array().cast("array<string>")
    return let(F.regexp_replace(c, r"\s+", ""), lambda t: F.when(F.length(t) < n, none).otherwise(grams(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays, 0 where either is empty."""
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), 0.0).otherwise(share(p["a"], p["b"])))


def to_jamo(c: Column) -> Column:
    """Hangul syllables decomposed into compatibility jamo, by arithmetic on code points."""
    lead, vowel = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
    tail = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

    def one(x: Column) -> Column:
        code = F.ascii(x) - 0xAC00
        pick = lambda table, i: F.substring(F.lit(table), i + 1, F.lit(1))
        last = F.when(code % 28 > 0, pick(tail, (code % 28 - 1).cast("int"))).otherwise("")
        parts = F.concat(pick(lead, F.floor(code / 588).cast("int")), pick(vowel, F.floor(code % 588 / 28).cast("int")), last)
        return F.when((code >= 0) & (code < 11172), parts).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def canonicalize(c: Column) -> Column:
    """Synonyms replaced by their group's first form, longest variant first, in any letter case. One search tells the texts
    without any variant, which stay as they are."""
    pairs = sorted([(v, g[0]) for g in SYNONYMS for v in g[1:]], key=lambda p: -len(re.escape(p[0])))
    replaced = lambda t: reduce(lambda x, p: F.regexp_replace(x, "(?iu)" + re.escape(p[0]), p[1]), pairs, t)
    some = "(?iu)" + "|".join(re.escape(v) for v, _ in pairs)
    return let(c, lambda t: F.when(t.rlike(some), replaced(t)).otherwise(t))


def canonical_terms(c: Column) -> Column:
    """Canonical forms present in the text."""
    present = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g[0].lower())), g[0]) for g in SYNONYMS]))
    return let(F.lower(canonicalize(c)), present)


def canonical_title(c: Column) -> Column:
    """A title without leading [tags], trailing contract notes in brackets, and leading year."""
    noise = r"^\s*(?:\[[^\]]{1,10}\]\s*)*|\s*\((?:협상에\s*의한\s*계약|긴급|재공고|수정공고)[^)]*\)\s*$"
    t = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), noise, "")
    t = F.regexp_replace(t, r"^\s*'?(?:20)?\d{2}\s*년(?:도)?\s*", "")
    return F.trim(F.regexp_replace(t, noise, ""))


def title_similarity(a: Column, b: Column) -> Column:
    """The larger of bigram and trigram overlap of canonical titles, or 0.8 of the share of common terms."""
    parts = lambda c: F.struct(canonicalize(canonical_title(c)).alias("name"), canonical_terms(c).alias("terms"))

    def compared(p):
        x, y, ta, tb = p["a"]["name"], p["b"]["name"], p["a"]["terms"], p["b"]["terms"]
        grams = [jaccard(F.array_distinct(char_ngrams(x, n)), F.array_distinct(char_ngrams(y, n))) for n in (2, 3)]
        share = F.when(
            (F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb))
        ).otherwise(0.0)
        return F.greatest(*grams, 0.8 * share)

    return let(F.struct(parts(a).alias("a"), parts(b).alias("b")), compared)


def terms_conflict(a: Column, b: Column) -> Column:
    """Both titles name canonical terms, and none in common."""
    apart = lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0) & (F.size(F.array_intersect(p["a"], p["b"])) == 0)
    return let(F.struct(canonical_terms(a).alias("a"), canonical_terms(b).alias("b")), apart)


def jurisdiction_conflict(a: Column, b: Column) -> Column:
    """Different leading districts in two department names; unknown ones never conflict."""
    first = lambda c: F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^([가-힣]{1,5}구)(?=\s|보건소|청|$)", 1)
    return (first(a) != "") & (first(b) != "") & (first(a) != first(b))


def count_words(c: Column, words: tuple[str, ...], cap: int | None = None) -> Column:
    """How many of ``words`` the text contains, at most ``cap``."""
    n = reduce(lambda x, y: x + y, [F.contains(c, F.lit(w)).cast("int") for w in words])
    return F.least(n, F.lit(cap)) if cap is not None else n


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def region_matches(own: Column, wanted: Column, successors: dict[str, str] | None = None) -> Column:
    """A two-digit wanted code matches by prefix (renamed provinces by their successor), longer codes in full."""
    prefix = F.substring(own, 1, 2)
    for old, new in (successors or {}).items():
        prefix = F.when(prefix == old, new).otherwise(prefix)
    return F.when(F.length(wanted) == 2, prefix == wanted).otherwise(own == wanted)


def sniff_mime(content: Column) -> Column:
    """File kind by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head == "D0CF11E0A1B11AE1", "application/x-hwp")
        .when(head.startswith("504B0304"), "application/hwp+zip")
        .otherwise("application/octet-stream")
    )
