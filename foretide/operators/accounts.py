"""Ledgers, usage, subscriptions, jobs, model costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.scores import lookup
from foretide.operators.ranking import nearest_rank, running_balance

#: Fixed plans: won a month, credits a month.
PLANS = {"free": (0, 3), "pro": (99_000, 40), "team": (290_000, 150)}
DUNNING_DAYS = (1, 3, 7)


def ledger_audit(entries: DataFrame) -> DataFrame:
    """Entries whose stored balance differs from the running sum of their organisation, or is below zero, or whose
    idempotency key occurs before."""
    w = Window.partitionBy("org_id", "idempotency_key").orderBy("id")
    out = running_balance(entries.withColumnRenamed("balance_after", "stored"), ["org_id"], "id", "delta")
    out = out.withColumn("again", F.col("idempotency_key").isNotNull() & (F.row_number().over(w) > 1))
    return out.filter((F.col("stored") != F.col("balance_after")) | F.col("overdrawn") | F.col("again"))


def month_of(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.date_trunc("month", F.from_utc_timestamp(ts, zone))


def usage_by_month(events: DataFrame) -> DataFrame:
    """Quantity, cost and number by organisation, local month and meter; an event key counts once."""
    once = events.dropDuplicates(["job_id", "meter"])
    return once.groupBy("org_id", month_of(F.col("at")).alias("month"), "meter").agg(F.sum("quantity").alias("quantity"), F.coalesce(F.sum("usd"), F.lit(0)).alias("usd"), F.count("*").alias("n"))


def credit_totals(entries: DataFrame) -> DataFrame:
    of = lambda s: F.coalesce(F.sum(F.when(F.col("delta") > 0 if s else F.col("delta") < 0, F.abs("delta"))), F.lit(0))
    return entries.groupBy("org_id").agg(of(True).alias("granted"), of(False).alias("spent"))


def call_cost(tokens: dict[str, Column], prices: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with their cost: tokens of each class times its price for a million, exact decimals. ``prices`` (model,
    one column a class) is a dimension."""
    cost = sum((c.cast("decimal(20,0)") * F.col(f"price_{k}").cast("decimal(12,4)") / F.lit(1_000_000).cast("decimal(10,0)") for k, c in tokens.items()), F.lit(0).cast("decimal(18,6)"))
    return calls.join(prices, "model", "left").withColumn("usd", cost.cast("decimal(18,6)"))


def calls_by_day(calls: DataFrame) -> DataFrame:
    g = calls.groupBy(F.to_date(F.from_utc_timestamp("at", "Asia/Seoul")).alias("day"), "task", "model", "status")
    return g.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("usd").alias("usd"))


def backoff_seconds(attempt: Column, base: int = 30, cap: int = 3600) -> Column:
    """30, 60, 120 ... seconds, an hour at most; the jitter of a retry is added by who runs it."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt - 1))


def renewal(status: Column, attempts: Column, outcome: Column) -> Column:
    """Next state of a subscription that is due: struct(status, attempts, wait_days). A failed charge is tried again
    after 1, 3 and 7 days, then the plan ends."""
    wait = F.element_at(F.array(*[F.lit(d) for d in DUNNING_DAYS]), F.least(attempts + 1, F.lit(len(DUNNING_DAYS))))
    return F.when(outcome == "paid", F.struct(F.lit("active").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("wait_days"))).otherwise(
        F.struct(
            F.when(attempts >= len(DUNNING_DAYS), "ended").otherwise("past_due").alias("status"), (attempts + 1).alias("attempts"),
            F.when(attempts < len(DUNNING_DAYS), wait).alias("wait_days"),
        )
    )


def plan_credits(plan: Column) -> Column:
    return lookup(plan, {k: v[1] for k, v in PLANS.items()})


def within_limits(changes: DataFrame, usage: DataFrame) -> DataFrame:
    """(org_id, id, plan, credits, nth, allowed) of each use (org_id, id, at): the plan in force, which is the last that
    ``changes`` (org_id, id, at, plan) set until then, of equal times too, else free; how many uses the month has had with
    it; whether the plan's credits cover it. One pass over both in the order of time."""
    rows = changes.select("org_id", "id", "at", "plan", F.lit(0).alias("use")).unionByName(usage.select("org_id", "id", "at", F.lit(None).cast("string").alias("plan"), F.lit(1).alias("use")))
    so_far = Window.partitionBy("org_id").orderBy("at", "use", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    month = Window.partitionBy("org_id", "month").orderBy("at", "id")
    out = rows.withColumn("plan", F.coalesce(F.last("plan", ignorenulls=True).over(so_far), F.lit("free"))).filter("use = 1")
    out = out.withColumn("month", F.date_trunc("month", "at")).withColumn("nth", F.row_number().over(month))
    credits = plan_credits(F.col("plan")).cast("int")
    return out.select("org_id", "id", "plan", credits.alias("credits"), "nth", (F.col("nth") <= credits).alias("allowed"))


def job_tree(jobs: DataFrame, root: int) -> DataFrame:
    """A job and all below it, with their depth: one join of the children for each level, however many there are; a job
    that is below itself is an error."""
    from foretide.sources.shared import stored

    children = jobs.select(F.col("id").alias("child"), "parent_id").filter("parent_id is not null")
    level = stored(jobs.filter(F.col("id") == root).select("id", F.lit(0).alias("depth")), "job-level")
    out = level
    while not level.isEmpty():
        level = stored(level.join(children, F.col("id") == F.col("parent_id")).select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth")), "job-level")
        if not level.filter(F.col("id") == root).isEmpty():
            raise ValueError(f"job {root} is below itself")
        out = out.union(level)
    return out


def cancelled(jobs: DataFrame, root: int) -> DataFrame:
    """The tree of a job after it was cancelled: what is not finished is cancelled with it."""
    over = F.col("state").isin("done", "failed", "cancelled")
    return job_tree(jobs, root).join(jobs, "id").withColumn("state", F.when(over, F.col("state")).otherwise("cancelled"))


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Numbers by state, retry share and nearest-rank 95th percentile of run time by queue."""
    g = jobs.groupBy("queue").agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.avg((F.col("attempts") > 1).cast("double")).alias("retried"))
    return g.join(nearest_rank(jobs.filter("state = 'done'"), ["queue"], "seconds", 0.95, "p95"), "queue", "left")
