"""Scores: categories, commitment, triage, link candidates, recommendations, vectors."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretide import constants as K
from foretide.functions import text as X
from foretide.functions.timing import remaining_window, stage_order, tender_is_out


def lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def vote(c: Column, categories: dict[str, tuple[str, ...]] = K.CATEGORIES, generic: tuple[str, ...] = K.GENERIC_KEYWORDS) -> Column:
    """struct(category, confidence): each keyword in the text votes by its length, generic ones at 0.3; the first of
    the best wins, confidence is its share."""
    names = [n for n, words in categories.items() if words]
    rows = [{"c": i, "w": w.lower(), "x": (0.3 if w in generic else 1.0) * (1 + len(w.replace(" ", "")) / 4)} for i, n in enumerate(names) for w in categories[n]]
    # One literal, folded to a constant: the expression stays small however long the word lists are.
    words = F.from_json(F.lit(json.dumps(rows)), "array<struct<c: int, w: string, x: double>>")

    def result(scores: Column) -> Column:
        best, total = F.array_max(scores), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        name = F.get(F.split(F.lit(",".join(names)), ","), (F.array_position(scores, best) - 1).cast("int"))
        return F.when(best > 0, F.struct(name.alias("category"), F.round(best / total, 3).alias("confidence"))).otherwise(
            F.struct(F.lit("other").alias("category"), F.lit(0.0).alias("confidence"))
        )

    hits = X.let(F.lower(c), lambda low: F.filter(words, lambda w: F.contains(low, w["w"])))
    own = lambda found, i: F.aggregate(F.filter(found, lambda h: h["c"] == i), F.lit(0.0), lambda a, h: a + h["x"])
    scores = lambda found: F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: own(found, i))
    return X.let(X.let(hits, scores), result)


def commitment(c: Column, ladder: dict[str, tuple[str, ...]] = K.COMMITMENTS) -> Column:
    """The first level of which a phrase stands in the text."""
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in ps]), level) for level, ps in ladder.items()])


def triage(c: Column, kind: Column, amount: Column) -> Column:
    """Logistic relevance of a chunk in [0, 1]; records are always relevant, procedure never. ``amount``: whether the
    chunk names one."""
    every = lambda groups: tuple(dict.fromkeys(w for g in groups for w in g))
    n = {
        "procurement_verbs": K.PROCUREMENT_VERBS, "category_keywords": every(K.CATEGORIES.values()),
        "commitment": every(K.COMMITMENTS.values()), "future": K.FUTURE_MARKERS, "noise": K.NOISE_MARKERS,
    }
    z = F.lit(K.TRIAGE["bias"]) + reduce(
        lambda a, b: a + b, [K.TRIAGE[k] * X.count_words(c, words, K.TRIAGE_CAPS[k]) for k, words in n.items()]
    )
    z += K.TRIAGE["amount"] * amount.cast("int") + K.TRIAGE["budget_line"] * (kind == "budget_line").cast("int")
    return F.when(kind == "record", 1.0).when(kind == "procedure", 0.0).otherwise(F.round(1 / (1 + F.exp(-z)), 4))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def budget_similarity(a: Column, b: Column) -> Column:
    unknown = a.isNull() | b.isNull() | (a == 0) | (b == 0)
    return F.when(unknown, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.ln(a / b)) / math.log(3)))


def timeline_plausibility(stage, observed, other_stage, first_seen, last_signal, published) -> Column:
    """1, less 0.6 past a silence of 540 days, less 0.7 for an earlier stage 60 days after the tender."""
    gap = F.greatest(F.datediff(observed, last_signal), F.datediff(first_seen, observed), F.lit(0))
    after = (stage_order(stage) < stage_order(other_stage)) & (F.datediff(observed, published) > 60)
    return F.greatest(
        F.lit(0.0), 1.0 - F.when(gap > K.DORMANT_DAYS, 0.6).otherwise(0.0) - F.when(F.coalesce(after, F.lit(False)), 0.7).otherwise(0.0)
    )


def candidate_score(semantic: Column, title: Column, same_category: Column, budget: Column, timeline: Column, conflict: Column) -> Column:
    w = K.LINK_WEIGHTS
    total = (
        w["semantic"] * F.greatest(semantic, F.lit(0.0)) + w["title"] * title + w["category"] * same_category
        + w["budget"] * budget + w["timeline"] * timeline
    )
    return F.round(total - F.when(conflict, K.LINK_CONFLICT).otherwise(0.0), 4)


def category_agreement(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "other") | (b == "other"), 0.5).otherwise(0.0)


def conversion_probability(stage: Column, level: Column, documents: Column, calibrated: Column) -> Column:
    """The calibrated rate or the stage's prior, 0.05 more for each further document up to three, 0.98 at most."""
    prior = lookup(stage, K.STAGE_PRIOR) * F.when(
        stage == "council_mention", F.coalesce(lookup(level, K.COMMITMENT_MULTIPLIER), F.lit(1.0))
    ).otherwise(1.0)
    base = F.coalesce(calibrated, prior)
    more = 0.05 * F.least(F.greatest(documents - 1, F.lit(0)), F.lit(3))
    return F.when(tender_is_out(stage, F.lit(None).cast("date")), 1.0).otherwise(F.round(F.least(F.lit(0.98), base + more), 3))


def lead_time_value(status: Column, start: Column, end: Column, today: Column) -> Column:
    left = remaining_window(start, end, today, F.lit(None).cast("date"))
    days = F.datediff(left["start"], today)
    return (
        F.when(status == "bid_open", 0.6)
        .when(status.isin("closed", "dormant") | start.isNull(), 0.0)
        .when(left["passed"], 0.35)
        .when(days == 0, 0.75)
        .when(days <= 60, 0.7 + 0.3 * days / 60)
        .when(days <= 270, 1.0)
        .otherwise(F.greatest(F.lit(0.35), 1 - (days - 270) / 400))
    )


def budget_fit(amount: Column, low: Column, high: Column) -> Column:
    edge = F.when(amount < low, low).otherwise(high)
    inside = (low.isNull() | (amount >= low)) & (high.isNull() | (amount <= high))
    return (
        F.when(amount.isNull() | (low.isNull() & high.isNull()), 0.5)
        .when(inside, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.ln(amount / edge)) / math.log(4)))
    )


def keyword_hits(keywords: Column, haystack: Column) -> Column:
    """Keywords that the text holds, blanks left out, as written or by their jamo."""
    compact = F.replace(haystack, F.lit(" "), F.lit(""))
    jamo = X.to_jamo(compact)
    bare = lambda k: F.replace(k, F.lit(" "), F.lit(""))
    return F.filter(keywords, lambda k: (bare(k) != "") & (F.contains(compact, bare(k)) | F.contains(jamo, X.to_jamo(bare(k)))))


def recommendation_score(semantic, hits, excluded, category, region, budget, conversion, lead) -> Column:
    w = K.RECOMMEND_WEIGHTS
    semantic = F.least(F.greatest((semantic - 0.05) / 0.45, F.lit(0.0)), F.lit(1.0))
    total = (
        w["semantic"] * semantic + w["keyword"] * F.least(F.size(hits) / 2, F.lit(1.0)) + w["category"] * category
        + w["region"] * region + w["budget"] * budget + w["conversion"] * conversion + w["lead_time"] * lead
    )
    return F.round(total * F.when(F.size(excluded) > 0, K.EXCLUDED_FACTOR).otherwise(1.0), 4)


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array by the exclusive method: place q(n + 1), linear between neighbours, ends held."""
    n = F.size(values)
    place = F.lit(q) * (n + 1)
    low = F.least(F.greatest(F.floor(place).cast("int"), F.lit(1)), n - 1)
    return F.when(n >= 2, F.element_at(values, low) + (F.element_at(values, low + 1) - F.element_at(values, low)) * (place - low))
