"""Recommendations, the customer feed, alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.constants import PER_ORG, PER_SOURCE, STAGES
from foretide.functions import scores as S
from foretide.functions.text import region_matches
from foretide.functions.timing import stage_order
from foretide.operators import vectors as V
from foretide.operators.ranking import keyset_page, top_k


def open_and_settled(opportunities: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Open opportunities whose owner has no pending changes."""
    out = opportunities.filter(F.col("status").isin("open", "bid_open"))
    if states is not None:
        dirty = states.filter("generation > reconciled").select("institution")
        out = out.join(dirty, "institution", "left_anti")
    return out


def nearest(open_: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(org_id, opportunity_id): the ``most`` of all opportunities nearest to each profile vector ``pv``, ties to the
    smaller id."""
    found = V.nearest(open_.select(F.col("opportunity_id").alias("id"), F.col("embedding").alias("vector")), vectors.select(F.col("org_id").alias("query_id"), F.col("pv").alias("vector")), most, None)
    return found.select(F.col("query_id").alias("org_id"), F.col("id").alias("opportunity_id"))


#: Most patterns without three plain letters in a row that are tested against every title at once.
SHORT_WORDS = 10_000
#: Most rows of customers' wishes that are broadcast.
FEW = 100_000


def wished(wishes: DataFrame) -> DataFrame:
    """What customers ask for, to be joined with opportunities: broadcast where it is little, else merged. A plan knows
    neither how little that is nor how many words a file of opportunities holds, and would broadcast the latter."""
    return F.broadcast(wishes) if wishes.limit(FEW + 1).count() <= FEW else wishes.hint("merge")


def title_holds(titles: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs where ``title`` ILIKE %k%, wildcards in ``k`` and all. Titles are looked up by three letters in a row of the
    word, an equi-join whose pairs are then tested. Words without such letters match most titles whatever is done: they are
    tested against each title in a broadcast pass, in blocks of SHORT_WORDS."""
    holds = F.ilike("title", F.concat(F.lit("%"), F.col("k"), F.lit("%")))
    low, plain = F.lower("title"), F.regexp_extract(F.lower("k"), r"[^%_\\]{3}", 0)
    grams = F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    t, w = titles.withColumn("__g", F.explode(F.array_distinct(grams))), words.withColumn("__g", plain)
    out = t.join(wished(w.filter("__g <> ''")), "__g").filter(holds).drop("__g")
    short = w.filter("__g = ''").drop("__g")
    blocks = -(-short.count() // SHORT_WORDS)
    for b in range(blocks):
        own = short if blocks == 1 else short.filter(F.pmod(F.xxhash64(*short.columns), F.lit(blocks)) == b)
        out = out.unionByName(titles.join(F.broadcast(own), holds))
    return out


def candidates(open_: DataFrame, profiles: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """(org_id, opportunity_id): for each profile the nearest by vector, those with a keyword, those of its categories,
    ``per_source`` of each, ties to the smaller id. Keyword and category candidates are equi-joins on exploded words."""
    near = nearest(open_, profiles.filter("embedding is not null").select("org_id", F.col("embedding").alias("pv")), per_source)
    words = profiles.select("org_id", F.explode("keywords").alias("k")).filter(F.trim("k") != "")
    tagged = open_.select("opportunity_id", F.explode("keywords").alias("k")).join(wished(words), "k").select("org_id", "opportunity_id")
    titled = title_holds(open_.select("opportunity_id", "title"), words).select("org_id", "opportunity_id")
    word = top_k(tagged.union(titled).distinct(), ["org_id"], [F.asc("opportunity_id")], per_source)
    of = profiles.select("org_id", F.explode("categories").alias("category"))
    category = top_k(open_.select("opportunity_id", "category").join(wished(of), "category"), ["org_id"], [F.asc("opportunity_id")], per_source)
    keys = ["org_id", "opportunity_id"]
    return near.select(*keys).union(word.select(*keys)).union(category.select(*keys)).distinct()


def recommend(opportunities: DataFrame, profiles: DataFrame, regions: DataFrame, today: date, states: DataFrame | None = None, per_org: int = PER_ORG) -> DataFrame:
    """(org_id, opportunity_id, score, hits, excluded, rank): the best of each profile's candidates. ``regions``
    (institution, region_code) is a dimension."""
    open_ = open_and_settled(opportunities, states)
    own = ("keywords", "exclude_keywords", "categories", "region_codes", "budget_min", "budget_max", "embedding")
    p = profiles.select("org_id", *[F.col(c).alias(f"p_{c}") for c in own])
    pairs = candidates(open_, profiles).join(open_, "opportunity_id").join(p, "org_id").join(regions, "institution", "left")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    text = F.concat_ws(" ", "title", F.array_join(listed("keywords"), " "))
    codes, categories = listed("p_region_codes"), listed("p_categories")
    region = F.when((F.size(codes) > 0) & F.col("region_code").isNotNull(), F.exists(codes, lambda r: region_matches(F.col("region_code"), r)).cast("double")).otherwise(0.5)
    category = F.when(F.size(categories) > 0, F.array_contains(categories, F.col("category")).cast("double")).otherwise(0.5)
    both = F.col("embedding").isNotNull() & F.col("p_embedding").isNotNull()
    semantic = F.when(both, S.cosine(F.col("p_embedding"), F.col("embedding"))).otherwise(0.0)
    scored = pairs.withColumn("hits", S.keyword_hits(listed("p_keywords"), text)).withColumn("excluded", S.keyword_hits(listed("p_exclude_keywords"), text))
    scored = scored.withColumn(
        "score",
        S.recommendation_score(
            semantic, F.col("hits"), F.col("excluded"), category, region, S.budget_fit(F.col("est_budget_krw"), F.col("p_budget_min"), F.col("p_budget_max")),
            F.col("conversion_prob"), S.lead_time_value(F.col("status"), F.col("bid_window_start"), F.col("bid_window_end"), F.lit(today).cast("date")),
        ),
    )
    return top_k(scored.select("org_id", "opportunity_id", "score", "hits", "excluded"), ["org_id"], [F.desc("score"), F.asc("opportunity_id")], per_org)


def visible(feedback: Column) -> Column:
    return feedback.isNull() | ~feedback.isin("dismissed", "irrelevant")


def feed(recommendations: DataFrame, opportunities: DataFrame, org_id: int, today: date, sort: str = "score", stages=None, categories=None, status=("open", "bid_open"), q: str | None = None, include_dismissed: bool = False) -> DataFrame:
    """The filtered feed of one customer with its sort key: score, or the day the tender is due (an open window counts
    as today, none comes last), or the last signal."""
    joined = recommendations.filter(F.col("org_id") == org_id).join(opportunities, "opportunity_id").filter(F.col("status").isin(*status))
    if categories:
        joined = joined.filter(F.col("category").isin(*categories))
    if stages:
        joined = joined.filter(F.col("stage").isin(*stages))
    if q:
        joined = joined.filter(F.col("title").ilike(f"%{q}%") | F.array_contains("keywords", q))
    if not include_dismissed:
        joined = joined.filter(visible(F.col("feedback")))
    soon = F.greatest(F.coalesce("bid_window_start", F.lit("9999-12-31").cast("date")), F.lit(today).cast("date"))
    key = {"soon": F.datediff(soon, F.lit("1970-01-01").cast("date")).cast("double"), "recent": -F.datediff("last_signal_at", F.lit("1970-01-01").cast("date")).cast("double"), "score": -F.col("score")}[sort]
    return joined.withColumn("sort_key", key)


def feed_page(rows: DataFrame, after: tuple | None = None, limit: int = 20) -> DataFrame:
    """A page by (sort key, score descending, id descending); ``after`` is those three of the last row seen."""
    return keyset_page(rows, [("sort_key", False), ("score", True), ("opportunity_id", True)], after, limit)


def stage_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stage").agg(F.count("*").alias("n"))


def fresh_alerts(recommendations: DataFrame, opportunities: DataFrame, rules: DataFrame) -> DataFrame:
    """What each customer is to be told: good enough, not turned down, open, and new or advanced in stage since the last
    alert. Ranked; instant rules take 20, digests 15 and count the rest."""
    j = recommendations.join(rules, "org_id").join(opportunities, "opportunity_id")
    j = j.filter((F.col("score") >= F.col("min_score")) & F.col("status").isin("open", "bid_open") & (F.col("feedback").isNull() | (F.col("feedback") == "relevant")))
    j = j.filter(F.col("stages").isNull() | (F.size("stages") == 0) | F.array_contains("stages", F.col("stage")))
    j = j.filter(F.col("notified_stage").isNull() | (stage_order(F.col("stage")) > stage_order(F.col("notified_stage"))))
    out = j.withColumn("rank", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc("score"), F.asc("opportunity_id"))))
    most = F.when(F.col("mode") == "instant", 20).otherwise(15)
    return out.select("org_id", "opportunity_id", "stage", "score", "mode", "rank", (F.col("rank") <= most).alias("shown"))


def delivery(status: Column, attempts: Column, outcome: Column) -> Column:
    """Next state of a notification: struct(status, attempts, wait_minutes, disable). A passing failure is tried again
    after 5, 10, 20 ... minutes, five times; a lasting one disables its channel."""
    n = attempts + 1
    retry = (outcome == "transient") & (n < 5)
    return F.when(status != "pending", F.struct(status.alias("status"), attempts.alias("attempts"), F.lit(None).cast("double").alias("wait_minutes"), F.lit(False).alias("disable"))).otherwise(
        F.struct(
            F.when(outcome == "sent", "sent").when(retry, "pending").otherwise("failed").alias("status"), n.alias("attempts"),
            F.when(retry, 5 * F.pow(F.lit(2.0), n - 1)).alias("wait_minutes"), (outcome == "permanent").alias("disable"),
        )
    )


def quiet(hour: Column, start: int = 22, end: int = 8) -> Column:
    """Whether a local hour is in the quiet hours, which may span midnight."""
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def reasons(hits: Column, stage: Column, days: Column, budget: Column) -> Column:
    """Why a card is shown, as labels; only those that apply."""
    return F.array_compact(
        F.array(
            F.when(F.size(hits) > 0, F.concat(F.lit("keyword: "), F.array_join(F.slice(hits, 1, 3), ", "))),
            F.when(stage.isin(*STAGES[:2]), F.lit("before procurement")),
            F.when(days > 0, F.concat(F.lit("about "), F.ceil(days / 30).cast("string"), F.lit(" months ahead"))),
            F.when(budget > 0, F.lit("budget known")),
        )
    )


def brief_facts(signals: DataFrame, most: int = 8) -> DataFrame:
    """Facts of a brief for each opportunity: its latest signals, and the best located quote."""
    history = F.slice(F.sort_array(F.collect_list(F.struct("observed_at", "id", "stage", "title")), asc=False), 1, most)
    return signals.groupBy("opportunity_id").agg(history.alias("history"), F.max_by("quote", F.struct("quote_score", "id")).alias("best_quote"))
