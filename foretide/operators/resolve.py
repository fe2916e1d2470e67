"""Resolving the name of a public body: code, exact alias, district pool, province, spelling, or nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretide.constants import FUZZY_LEAD, FUZZY_SCORE
from foretide.functions import text as X
from foretide.operators.fuzzy import ratio
from foretide.sources.shared import stored


def compact(c):
    return F.regexp_replace(c, r"\s+", "")


def parsed(c):
    """struct(sido, sigungu, council, department) read off a name: province, city or district, whether it is a council,
    and what follows the body's own name."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    sido = F.regexp_extract(t, r"^([가-힣]{2,5}(?:특별시|광역시|특별자치시|특별자치도|도))(?=\s|$|[가-힣]+[시군구])", 1)
    rest = F.trim(F.regexp_replace(t, r"^[가-힣]{2,5}(?:특별시|광역시|특별자치시|특별자치도|도)(?=\s|$|[가-힣]+[시군구])\s*", ""))
    sigungu = F.regexp_extract(rest, r"^([가-힣]{1,4}[시군구])", 1)
    after = F.trim(F.regexp_replace(rest, r"^[가-힣]{1,4}[시군구]", ""))
    council = after.startswith("의회") | ((sigungu == "") & rest.startswith("의회"))
    department = F.trim(F.regexp_replace(after, r"^(?:의회|청)\s*", ""))
    blank = lambda x: F.nullif(x, F.lit(""))
    return F.struct(blank(sido).alias("sido"), blank(sigungu).alias("sigungu"), council.alias("council"), blank(department).alias("department"))


#: Words of bodies that stand on their own, whatever place their name begins with; who is nobody.
OWN_BODIES = ("학교", "공사", "공단", "조합", "재단", "의료원", "협의회", "기구")
NOBODY = ("각수요기관",)


def is_own_body(name):
    """A school, corporation, foundation ...; a district's health centre is none."""
    return F.replace(name, F.lit("보건의료원"), F.lit("")).rlike("|".join(OWN_BODIES))


def looks_local(name):
    """A province, city, district or council by the shape of its name."""
    return X.let(parsed(name), lambda p: p["sigungu"].isNotNull() | p["sido"].isNotNull() | p["council"]) & ~is_own_body(name)


def names_nobody(name):
    return compact(name).isin(*NOBODY)


def resolve(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``records`` (id, raw, code_hint, sido_hint) with code, department, confidence and method.

    The cascade takes the first that holds: known code; exact name or alias; the district's only body, within the
    province named; the same narrowed by the hint; the province's own body; spelling within a lead. Several bodies
    left are ``ambiguous``, never guessed. ``registry`` (code, name, kind, sido, sigungu, aliases) is a dimension:
    Spark broadcasts it below its threshold, and distinct names are resolved once each.
    """
    names = records.select("raw", "code_hint", "sido_hint").distinct()
    names = names.withColumn("nid", F.xxhash64(F.coalesce("raw", F.lit("")), F.coalesce("code_hint", F.lit("")), F.coalesce("sido_hint", F.lit(""))))
    names = names.withColumn("p", parsed(F.coalesce("raw", F.lit("")))).withColumn("c", compact(F.coalesce("raw", F.lit(""))))
    reg = registry.select("code", "kind", "sido", "sigungu", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    alias = reg.select(compact(F.col("alias")).alias("c"), "code").groupBy("c").agg(F.min("code").alias("exact_code"))
    known = registry.select(F.col("code").alias("code_hint"), F.col("code").alias("hint_code"))
    out = names.join(known, "code_hint", "left").join(alias, "c", "left")
    kind = F.when(F.col("p.council"), "council").otherwise("local_gov")
    pool = registry.filter("sigungu is not null").select(F.col("sigungu").alias("ps"), F.col("kind").alias("pk"), F.col("sido").alias("psido"), F.col("code").alias("pcode"))
    of = out.select("nid", "p", "sido_hint", kind.alias("kind")).join(pool, (F.col("p.sigungu") == F.col("ps")) & (F.col("kind") == F.col("pk")) & (F.col("p.sido").isNull() | (F.col("p.sido") == F.col("psido"))))
    of = of.groupBy("nid").agg(
        F.collect_set("pcode").alias("pool"), F.collect_set(F.when(F.col("sido_hint") == F.col("psido"), F.col("pcode"))).alias("near")
    )
    top = registry.filter("sigungu is null").groupBy(F.col("sido").alias("tsido"), F.col("kind").alias("tkind")).agg(F.collect_set("code").alias("tops"))
    out = out.withColumn("kind", kind).join(of, "nid", "left")
    out = out.join(top, (F.col("p.sido") == F.col("tsido")) & F.col("p.sigungu").isNull() & (F.col("kind") == F.col("tkind")), "left")
    one = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    choice = F.coalesce(
        F.when(F.col("hint_code").isNotNull(), F.struct(F.col("hint_code").alias("code"), F.lit(1.0).alias("confidence"), F.lit("code").alias("method"))),
        F.when(F.col("c") == "", F.struct(F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method"))),
        F.when(F.col("exact_code").isNotNull(), F.struct(F.col("exact_code").alias("code"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))),
        F.when(F.size("pool") == 1, F.struct(one(F.col("pool")).alias("code"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))),
        F.when(F.size("near") == 1, F.struct(one(F.col("near")).alias("code"), F.lit(0.9).alias("confidence"), F.lit("context").alias("method"))),
        F.when(F.size("pool") > 1, F.struct(F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"), F.lit("ambiguous").alias("method"))),
        F.when(F.size("tops") == 1, F.struct(one(F.col("tops")).alias("code"), F.lit(0.95).alias("confidence"), F.lit("exact").alias("method"))),
    )
    out = out.select("nid", "raw", "code_hint", "sido_hint", "c", "p", choice.alias("x"))
    left = out.filter("x is null").select("nid", X.to_jamo(F.col("c")).alias("jamo"))
    spelled = spelled_like(left, reg.select("code", X.to_jamo(compact(F.col("alias"))).alias("alias_jamo")))
    out = out.join(spelled, "nid", "left").select(
        "raw", "code_hint", "sido_hint", F.col("p.department").alias("department"),
        F.coalesce("x.code", "fuzzy_code").alias("code"),
        F.coalesce("x.confidence", F.col("fuzzy_score") / 100, F.lit(0.0)).alias("confidence"),
        F.coalesce("x.method", F.when(F.col("fuzzy_code").isNotNull(), "fuzzy"), F.lit("none")).alias("method"),
    )
    same = lambda c: records[c].eqNullSafe(out[c])
    return records.join(out, same("raw") & same("code_hint") & same("sido_hint"), "left").select(records["*"], "code", "department", "confidence", "method")


def _pairs_of_letters(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and one row for each letter pair of ``text``: the pair with its number among equal ones; a single letter is
    its own."""
    t, n = F.col(text), F.length(text)
    pairs = F.when(n == 1, F.array(t)).when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    seen = df.select(*keep, F.posexplode(pairs).alias("at", "pair"))
    nth = F.row_number().over(Window.partitionBy(*keep, "pair").orderBy("at"))
    return seen.select(*keep, F.concat("pair", F.lit(":"), nth.cast("string")).alias("g"))


def near_spellings(names: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """(nid, jamo, code, alias_jamo) of every pair whose ratio may be ``least``, and few others.

    A ratio of s over lengths a and b leaves s (a + b) / 2 letters in common. A letter left out ends two letter pairs of its
    word, one put in ends one, so (1.5 s - 1) (a + b) - 1 pairs stay the same. Two words with that many in common share one
    of the rarest pairs of each, as many as the rest is too few: only those are keys, in the order of rarity among aliases,
    and what most names end in is none."""
    s = least / 100
    shortest = s / (2 - s)  # of the other word, as a part of this one's length
    need = lambda n: F.greatest(F.ceil((1.5 * s - 1) * (1 + shortest) * n - 1 - 1e-9), F.lit(1))
    name, alias = _pairs_of_letters(names, ["nid", "jamo"], "jamo"), _pairs_of_letters(aliases, ["code", "alias_jamo"], "alias_jamo")
    common = stored(alias.groupBy("g").agg(F.count("*").alias("c")), "letter-pairs")

    def rare(df: DataFrame, keep: list[str], text: str) -> DataFrame:
        w = Window.partitionBy(*keep)
        ranked = df.join(common, "g", "left").withColumns({"place": F.row_number().over(w.orderBy(F.coalesce("c", F.lit(0)), "g")), "all": F.count("*").over(w)})
        return ranked.filter(F.col("place") <= F.col("all") - need(F.length(text)) + 1).select(*keep, "g")

    a, b = F.length("jamo"), F.length("alias_jamo")
    met = rare(name, ["nid", "jamo"], "jamo").join(rare(alias, ["code", "alias_jamo"], "alias_jamo"), "g")
    met = met.filter((F.least(a, b) >= F.floor(shortest * F.greatest(a, b)))).select("nid", "jamo", "code", "alias_jamo").distinct()
    return met


def spelled_like(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(nid, fuzzy_code, fuzzy_score): the body whose alias is closest letter by letter, if close enough and clear of
    the next. Who may be either is looked up by rare letter pairs (``near_spellings``); no pair that counts is left out."""
    near = near_spellings(names.select("nid", "jamo"), aliases.select("code", "alias_jamo").distinct(), FUZZY_SCORE - FUZZY_LEAD)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    best = near.withColumn("s", score("jamo", "alias_jamo")).groupBy("nid", "code").agg(F.max("s").alias("s"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("nid").orderBy(F.desc("s"), F.desc("code")))).filter("place <= 2")
    two = ranked.groupBy("nid").agg(F.max(F.when(F.col("place") == 1, F.struct("code", "s"))).alias("first"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("s"))), F.lit(0.0)).alias("second"))
    good = (F.col("first.s") >= FUZZY_SCORE) & (F.col("first.s") - F.col("second") >= FUZZY_LEAD)
    return two.filter(good).select("nid", F.col("first.code").alias("fuzzy_code"), F.col("first.s").alias("fuzzy_score"))


def learn_providers(records: DataFrame, registry: DataFrame, prefix: str = "G2B-") -> DataFrame:
    """Bodies that a provider names by its own code and the registry lacks: the first name seen for each code."""
    coded = records.filter("provider_code is not null and raw is not null").groupBy("provider_code").agg(F.min_by("raw", F.struct("published_at", "id")).alias("name"))
    new = coded.select(F.concat(F.lit(prefix), "provider_code").alias("code"), "name")
    kind = F.when(F.col("name").contains("의회"), "council").when(F.col("name").rlike("교육(?:청|지원청)"), "education").otherwise("public_body")
    return new.join(registry.select("code"), "code", "left_anti").withColumn("kind", kind).withColumn("sido", parsed(F.col("name"))["sido"])


def reresolve(records: DataFrame, registry: DataFrame, prefix: str = "G2B-") -> DataFrame:
    """Records without an institution resolved against today's registry, which the bodies that providers name by code
    are added to first. A coded record takes its provider's body, any other its name's; equal names are resolved once
    (see ``resolve``). ``records``: id, raw, provider_code, sido_hint, published_at, institution."""
    left = records.filter("institution is null").drop("institution")
    known = registry.select("code").union(learn_providers(left, registry, prefix).select("code")).distinct()
    own = left.withColumn("code_hint", F.concat(F.lit(prefix), "provider_code"))
    coded = own.join(known.select(F.col("code").alias("code_hint")), "code_hint", "left_semi")
    named = resolve(own.join(coded.select("id"), "id", "left_anti"), registry)
    fixed = coded.select(*left.columns, F.col("code_hint").alias("code"), F.lit(None).cast("string").alias("department"), F.lit(1.0).alias("confidence"), F.lit("provider").alias("method"))
    return fixed.unionByName(named.select(*fixed.columns))
