"""Retrospective back-test: cohorts of first public signals, censoring, lead times, calibration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.constants import HORIZON_DAYS, LEAST_SAMPLES, PRE_PROCUREMENT, UNCERTAIN_DATES
from foretide.functions.scores import exclusive_quantile


def publicly_dated(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals with ``available``, number left out): dates of meetings, adoption or crawling prove no publication, nor
    do council records that do not say where their date is from."""
    uncertain = F.coalesce(F.col("published_from").isin(*UNCERTAIN_DATES), F.lit(False)) | (F.col("council_id").isNotNull() & F.col("published_from").isNull())
    left = signals.agg(F.count_if(uncertain).alias("excluded_uncertain_dates"))
    return signals.filter(~uncertain).withColumn("available", F.greatest("published_at", "observed_at")), left


def per_opportunity(signals: DataFrame, today: date) -> DataFrame:
    """First public signal, first tender that is no cancellation and first early signal of each opportunity, as of
    ``today``, in one aggregation."""
    early = F.col("stage").isin(*PRE_PROCUREMENT)
    bid = (F.col("stage") == "bid_notice") & F.col("cancels").isNull()
    known = signals.filter(F.col("available") <= F.lit(today))
    row = F.struct("available", "id", "stage", "commitment")
    g = known.groupBy("opportunity_id").agg(F.min(row).alias("first"), F.min(F.when(bid, F.col("available"))).alias("bid_at"), F.min(F.when(early, row)).alias("early"))
    return g.withColumn("early", F.when(F.col("early.available") < F.col("bid_at"), F.col("early")))


def cohorts(per: DataFrame, today: date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(cohort, n, converted, rate): openings whose whole horizon is past, successes and failures alike, under
    ``stage:commitment`` and ``stage:*``."""
    mature = per.filter(F.col("first.stage").isin(*PRE_PROCUREMENT) & (F.date_add(F.col("first.available"), horizon) <= F.lit(today)))
    hit = (F.col("bid_at") > F.col("first.available")) & (F.col("bid_at") <= F.date_add(F.col("first.available"), horizon))
    level = F.when(F.col("first.stage") == "council_mention", F.coalesce("first.commitment", F.lit("none"))).otherwise("committed")
    keys = F.array(F.concat_ws(":", "first.stage", level), F.concat(F.col("first.stage"), F.lit(":*")))
    keyed = mature.select(F.explode(keys).alias("cohort"), F.coalesce(hit, F.lit(False)).cast("int").alias("hit"))
    return keyed.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("hit").alias("converted"), F.round(F.avg("hit"), 3).alias("rate"))


def calibration(found: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    """The rates that forecasts may use: enough samples, one commitment."""
    return found.filter((F.col("n") >= least) & ~F.col("cohort").endswith(":*")).select("cohort", "rate")


def lead_times(per: DataFrame) -> DataFrame:
    """n, median and exclusive quartiles (of four or more) of days from the first early signal to the tender, overall
    (stage null) and by the stage of that signal."""
    led = per.filter("early is not null").select(F.col("early.stage").alias("stage"), F.datediff("bid_at", F.col("early.available")).alias("d"))
    both = led.select(F.explode(F.array(F.col("stage"), F.lit(None).cast("string"))).alias("stage"), "d")
    g = both.groupBy("stage").agg(F.array_sort(F.collect_list(F.col("d").cast("double"))).alias("v"), F.percentile("d", 0.5).alias("median"))
    enough = lambda q: F.when(F.size("v") >= 4, exclusive_quantile(F.col("v"), q))
    return g.select("stage", F.size("v").alias("n"), "median", enough(0.25).alias("p25"), enough(0.75).alias("p75"))


def early_coverage(per: DataFrame) -> DataFrame:
    g = per.agg(F.count("bid_at").alias("tenders"), F.count("early").alias("with_early_signal"))
    return g.withColumn("rate", F.when(F.col("tenders") > 0, F.round(F.col("with_early_signal") / F.col("tenders"), 3)))


def censored(per: DataFrame, today: date, horizon: int = HORIZON_DAYS) -> DataFrame:
    young = F.col("first.stage").isin(*PRE_PROCUREMENT) & (F.date_add(F.col("first.available"), horizon) > F.lit(today))
    return per.agg(F.count_if(young).alias("censored"))


def follow_up(predictions: DataFrame, outcomes: DataFrame, coverage: DataFrame, captured: date, as_of: date, through: date | None, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Status of every frozen forecast: already_published, outcome_predates_freeze, right_censored, coverage_incomplete
    or evaluated, with converted, lead_days and window_hit (null where the window cannot be judged).

    ``coverage`` (opportunity_id, start, end) are the spans that were watched; a span of days is covered when watched
    spans, merged where they touch, hold it whole.
    """
    first = outcomes.groupBy("opportunity_id").agg(F.min("published_at").alias("first_bid"))
    from pyspark.sql import Window

    w = Window.partitionBy("opportunity_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = coverage.withColumn("new", (F.datediff("start", F.max("end").over(w)) > 1) | F.max("end").over(w).isNull())
    island = F.sum(F.col("new").cast("int")).over(Window.partitionBy("opportunity_id").orderBy("start", "end"))
    spans = spans.withColumn("i", island).groupBy("opportunity_id", "i").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    spans = spans.groupBy("opportunity_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    p = predictions.join(first, "opportunity_id", "left").join(spans, "opportunity_id", "left")
    day = lambda d: F.lit(d).cast("date")
    start, end = F.date_add(day(captured), 1), F.date_add(day(captured), horizon)
    covers = lambda a, b: F.coalesce(F.exists("spans", lambda s: (s["a"] <= a) & (s["b"] >= b)), F.lit(False))
    late = lambda d: (d > day(as_of)) | ((d > day(through)) if through else F.lit(False))
    converted = F.coalesce(F.col("first_bid") <= end, F.lit(False))
    status = (
        F.when(F.col("stage").isin("bid_notice", "award") | F.col("bid_published_at").isNotNull(), "already_published")
        .when(F.col("first_bid") <= day(captured), "outcome_predates_freeze")
        .when(late(end), "right_censored").when(~covers(start, end), "coverage_incomplete").otherwise("evaluated")
    )
    lo, hi = F.col("bid_window_start"), F.col("bid_window_end")
    judged = lo.isNotNull() & hi.isNotNull() & (lo > day(captured)) & ~late(hi) & covers(start, hi)
    eligible = ~F.col("status").isin("already_published", "outcome_predates_freeze")
    return p.withColumn("status", status).select(
        "opportunity_id", "status", converted.alias("converted"),
        F.when((F.col("status") == "evaluated") & converted, F.datediff("first_bid", day(captured))).alias("lead_days"),
        F.when(eligible & judged, F.coalesce(F.col("first_bid").between(lo, hi), F.lit(False))).alias("window_hit"),
    )


def follow_up_rates(rows: DataFrame) -> DataFrame:
    done = F.col("status") == "evaluated"
    return rows.agg(
        F.count_if(done).alias("n"), F.count_if(done & F.col("converted")).alias("events"), F.count("window_hit").alias("windows"),
        F.count_if(F.col("window_hit")).alias("window_hits"), F.percentile("lead_days", 0.5).alias("median_lead"),
    )
