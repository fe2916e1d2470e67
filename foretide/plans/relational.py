"""Joins, aggregates, windows, sorts, sets and arrays over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions.scores import exclusive_quantile
from foretide.operators import joins, ranking
from foretide.plans.registry import registry
from foretide.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


DEC = "decimal(15,2)"


def total(c, alias):
    """An exact sum of money, as a double."""
    return F.sum(F.col(c).cast(DEC)).cast("double").alias(alias)


# --- joins ------------------------------------------------------------------------------------------------------
@query("""
SELECT r_name, n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""")
def join_inner_chain(spark, d):
    # Orders are aggregated by customer before the dimensions are joined: the join moves customers, not orders.
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(DEC)).alias("t"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.sum("t").cast("double").alias("total"))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_urgent, max(o_orderdate) AS last_urgent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def join_left_outer(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_urgent"))
    out = table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_urgent"), "last_urgent")


@query("SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL")
def join_anti_outer_null(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 100000").select("o_custkey")
    return table(spark, d, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY)")
def join_semi_exists(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    cond = (F.col("l_orderkey") == F.col("o_orderkey")) & F.expr("l_shipdate > o_orderdate + interval 90 days")
    return table(spark, d, "orders").join(li, cond, "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def join_anti_not_exists(spark, d):
    bad = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select("l_suppkey")
    return table(spark, d, "supplier").join(bad, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@query("""
SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09
  UNION SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)""")
def join_in_union_scope(spark, d):
    li = table(spark, d, "lineitem")
    scope = li.filter("l_discount > 0.09").select("l_partkey").union(li.filter("l_tax > 0.07").select("l_partkey"))
    return table(spark, d, "part").join(scope, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""
SELECT c_custkey FROM customer c WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') > 0
  OR (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity = 50) > 0""")
def join_correlated_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_quantity = 50").select("l_orderkey")
    mine = o.filter("o_orderstatus = 'P'").select("o_custkey").union(o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_custkey"))
    return table(spark, d, "customer").join(mine, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT DISTINCT u.user_id FROM (SELECT user_id FROM events GROUP BY user_id) u
WHERE EXISTS (SELECT 1 FROM events e WHERE CAST(json_extract_string(e.props, '$.k') AS BIGINT) = u.user_id)""")
def join_json_containment(spark, d):
    ev = table(spark, d, "events")
    ids = ev.select(F.get_json_object("props", "$.k").cast("long").alias("user_id")).distinct()
    return ev.select("user_id").distinct().join(ids, "user_id", "left_semi")


@query("""
WITH held AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1)
SELECT s_suppkey, count(*) AS n FROM supplier JOIN held ON list_contains(supps, s_suppkey) GROUP BY 1""")
def join_array_membership(spark, d):
    # The arrays are never built: what they hold is the distinct pairs.
    held = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    flat = held.groupBy("s_suppkey").agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").select("s_suppkey").join(flat, "s_suppkey")


@query("""
WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(p, ',') AS priorities FROM a WHERE list_has_any(p, ['1-URGENT', '2-HIGH']) AND NOT list_has_all(p, ['1-URGENT', '2-HIGH'])""")
def array_overlap_and_containment(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    wanted = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    a = a.filter(F.arrays_overlap("p", wanted) & (F.size(F.array_intersect("p", wanted)) < 2))
    return a.select("o_custkey", F.array_join("p", ",").alias("priorities"))


@query("""
SELECT o_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 20""")
def join_equi_and_range(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    out = joins.within_days(o, li, "k", "o_orderdate", "l_shipdate", 20)
    return out.select("o_orderkey", "l_linenumber", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query("""
SELECT p.event_id, p.user_id, s.ts AS signup_ts, s.value AS signup_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s
ON p.user_id = s.user_id AND p.ts >= s.ts""")
def join_asof(spark, d):
    ev = table(spark, d, "events")
    buys = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    ups = ev.filter("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signup_ts"), F.col("value").alias("signup_value"))
    out = joins.asof(buys, ups, "user_id", "ts", "ts", ["signup_ts", "signup_value"], bucket="week")
    return out.filter("signup_ts is not null").select("event_id", "user_id", "signup_ts", "signup_value")


_SPANS = """WITH s AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS b FROM events)"""


@query(_SPANS + """
SELECT x.event_id AS click_id, y.event_id AS view_id, least(x.b, y.b) - greatest(x.a, y.a) AS overlap_s
FROM s x JOIN s y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b WHERE x.event_type = 'click' AND y.event_type = 'view'""")
def join_interval_overlap(spark, d):
    ev = table(spark, d, "events").withColumn("a", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("b", F.col("a") + 7200)
    pick = lambda kind: ev.filter(F.col("event_type") == kind).select("user_id", "event_id", "a", "b")
    out = joins.interval_overlap(pick("click"), pick("view"), "user_id", 14400, ("a", "b"), ("a", "b"))
    over = F.least("a.b", "b.b") - F.greatest("a.a", "b.a")
    return out.select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("view_id"), over.alias("overlap_s"))


@query("SELECT label, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM embeddings GROUP BY label")
def self_pairs_closed_form(spark, d):
    n = F.count("*")
    return table(spark, d, "embeddings").groupBy("label").agg((n * (n - 1) / 2).cast("long").alias("pairs"))


@query("""
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_mktsegment IS DISTINCT FROM 'BUILDING') AND (NULLIF(n_name, 'CHINA') IS DISTINCT FROM NULL)""")
def filter_is_distinct_from(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    other = joins.is_distinct(F.nullif(F.col("n_name"), F.lit("CHINA")), F.lit(None).cast("string"))
    return out.filter(joins.is_distinct(F.col("c_mktsegment"), F.lit("BUILDING")) & other).select("c_custkey", "n_name")


# --- aggregates -------------------------------------------------------------------------------------------------
@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_grouped_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS n_high, count(DISTINCT user_id) FILTER (WHERE value < 10) AS n_low_users
FROM events GROUP BY 1""")
def agg_filtered(spark, d):
    low = F.when(F.col("value") < 10, F.col("user_id"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("n_high"), F.countDistinct(low).alias("n_low_users"))


@query("""
SELECT user_id, count(*) AS n FROM events WHERE user_id > 10 GROUP BY user_id
HAVING count(*) FILTER (WHERE event_type = 'purchase') > 2 AND count(*) FILTER (WHERE event_type = 'error') > 2 ORDER BY user_id LIMIT 51""")
def agg_having_mixed_groups(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    g = table(spark, d, "events").filter("user_id > 10").groupBy("user_id").agg(F.count("*").alias("n"), kind("purchase").alias("p"), kind("error").alias("e"))
    return g.filter("p > 2 and e > 2").select("user_id", "n").orderBy("user_id").limit(51)


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS spent,
  round(count(*) FILTER (WHERE value > 50) / count(*), 4) AS high_rate FROM events GROUP BY 1, 2""")
def agg_daily_usage(spark, d):
    g = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type")
    return g.agg(F.count("*").alias("calls"), total("value", "spent"), F.round(F.count_if(F.col("value") > 50) / F.count("*"), 4).alias("high_rate"))


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS quantity FROM events
WHERE ts + INTERVAL 9 HOUR >= TIMESTAMP '2024-01-01' AND ts + INTERVAL 9 HOUR < TIMESTAMP '2024-02-01' GROUP BY 1""")
def agg_month_in_local_time(spark, d):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    month = table(spark, d, "events").filter(F.date_trunc("month", local) == F.lit("2024-01-01").cast("timestamp"))
    return month.groupBy("event_type").agg(F.count("*").alias("n"), total("value", "quantity"))


@query("""
SELECT coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 0) AS granted,
  coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (WHERE o_orderstatus = 'none') AS DOUBLE), 0) AS spent FROM orders""")
def agg_coalesced_sums(spark, d):
    of = lambda s, a: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast(DEC))).cast("double"), F.lit(0.0)).alias(a)
    return table(spark, d, "orders").agg(of("F", "granted"), of("none", "spent"))


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min((o_orderdate, o_orderkey)) AS f FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1""")
def agg_mode_first_seen(spark, d):
    return ranking.mode_first_seen(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min((-epoch_us(o_orderdate), o_orderkey)) AS k FROM orders GROUP BY 1, 2)
SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY k)[1:3], ',') AS latest FROM f GROUP BY 1""")
def agg_ordered_distinct(spark, d):
    o = table(spark, d, "orders").withColumn("back", -F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    own = ranking.ordered_distinct("o_orderpriority", ["back", "o_orderkey"], 3)
    return o.groupBy("o_custkey").agg(F.array_join(own, ",").alias("latest"))


@query("""
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT label, CAST(i AS BIGINT) AS i, round(x / n, 6) AS x FROM m JOIN n USING (label)""")
def agg_mean_unit_vector(spark, d):
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    m = v.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return m.join(n, "label").select("label", (F.col("p") + 1).cast("long").alias("i"), F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query(ORACLE_SQL["agg_mean_unit_vector"])
def sql_mean_unit_vector(spark, d):
    """The same by the aggregate function that SQL calls."""
    from foretide.functions import udfs

    udfs.register(spark)
    found = spark.sql("SELECT label, mean_unit_vector(embedding) AS v FROM {e} GROUP BY label", e=table(spark, d, "embeddings").selectExpr("label", "cast(embedding as array<double>) as embedding"))
    return found.select("label", F.posexplode("v").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""
WITH g AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1), q AS (SELECT user_id, v, len(v) AS n FROM g WHERE len(v) >= 4),
p AS (SELECT *, 0.25 * (n + 1) AS a, 0.75 * (n + 1) AS b FROM q)
SELECT user_id, round(v[CAST(least(greatest(floor(a), 1), n - 1) AS BIGINT)] + (v[CAST(least(greatest(floor(a), 1), n - 1) AS BIGINT) + 1] - v[CAST(least(greatest(floor(a), 1), n - 1) AS BIGINT)]) * (a - least(greatest(floor(a), 1), n - 1)), 6) AS q25,
  round(v[CAST(least(greatest(floor(b), 1), n - 1) AS BIGINT)] + (v[CAST(least(greatest(floor(b), 1), n - 1) AS BIGINT) + 1] - v[CAST(least(greatest(floor(b), 1), n - 1) AS BIGINT)]) * (b - least(greatest(floor(b), 1), n - 1)), 6) AS q75,
  round(quantile_cont(x, 0.5), 6) AS median FROM p, unnest(v) AS t(x) GROUP BY ALL""")
def agg_exclusive_quartiles(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"), F.percentile("value", 0.5).alias("m"))
    g = g.filter(F.size("v") >= 4)
    q = lambda p: F.round(exclusive_quantile(F.col("v"), p), 6)
    return g.select("user_id", q(0.25).alias("q25"), q(0.75).alias("q75"), F.round("m", 6).alias("median"))


@query("""
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def agg_coverage_grouping_sets(spark, d):
    table(spark, d, "documents").select("lang", "source", "n_chars").createOrReplaceTempView("coverage_documents")
    return spark.sql("""SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, sum(n_chars) AS chars,
      min(n_chars) AS shortest, max(n_chars) AS longest FROM coverage_documents GROUP BY GROUPING SETS ((lang), (source), ())""")


@query("""
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM labels) AS labelled, (SELECT count(*) FROM labels WHERE quality = 1) AS good,
  (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS events_24h""")
def agg_funnel(spark, d):
    one = lambda name, *a: table(spark, d, name).agg(*a)
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))
    day = table(spark, d, "events").select("ts").crossJoin(F.broadcast(last)).filter(F.expr("ts >= last - interval 1 day")).agg(F.count("*").alias("events_24h"))
    labels = one("labels", F.countDistinct("doc_id").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    # One row each.
    return one("documents", F.count("*").alias("documents")).crossJoin(labels).crossJoin(one("pages", F.count("*").alias("pages"))).crossJoin(day)


@query("""
WITH c AS (SELECT label, floor(embedding[1] * 4) AS g, count(*) AS n FROM embeddings GROUP BY 1, 2),
t AS (SELECT sum(n * (n - 1) / 2) AS both_ FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS truth FROM (SELECT sum(n) AS n FROM c GROUP BY label)),
b AS (SELECT sum(n * (n - 1) / 2) AS found FROM (SELECT sum(n) AS n FROM c GROUP BY g)), p AS (SELECT sum(m) / (SELECT sum(n) FROM c) AS purity FROM (SELECT max(n) AS m FROM c GROUP BY g))
SELECT round(both_ / found, 6) AS precision, round(both_ / truth, 6) AS recall, round(2 * both_ / (found + truth), 6) AS f1, round(purity, 6) AS purity FROM t, a, b, p""")
def agg_pairwise_linking_scores(spark, d):
    from foretide.operators.evaluation import pairwise_scores

    e = table(spark, d, "embeddings").select("label", F.floor(F.element_at("embedding", 1) * 4).alias("g"))
    return pairwise_scores(e, "label", "g")


@query("""
SELECT role, count(*) AS n, CAST(sum(levenshtein(text, lower(text))) AS BIGINT) AS edits, round(sum(levenshtein(text, lower(text))) / sum(length(text)), 6) AS cer FROM conversations GROUP BY role""")
def agg_character_error_rate(spark, d):
    e, n = F.levenshtein("text", F.lower("text")), F.length("text")
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(e).alias("edits"), F.round(F.sum(e) / F.sum(n), 6).alias("cer"))


@query("""
WITH g AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[CAST(ceil(0.95 * len(v)) AS BIGINT)] AS p95, v[CAST(ceil(0.5 * len(v)) AS BIGINT)] AS p50, len(v) AS n FROM g""")
def agg_nearest_rank(spark, d):
    ev, k = table(spark, d, "events").select("event_type", "value"), ["event_type"]
    n = ev.groupBy(*k).agg(F.count("value").alias("n"))
    return ranking.nearest_rank(ev, k, "value", 0.95, "p95").join(ranking.nearest_rank(ev, k, "value", 0.5, "p50"), "event_type").join(n, "event_type")


@query("""
SELECT 'lang' AS field, round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents
UNION ALL SELECT 'long', round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) FROM documents""")
def agg_field_shares(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    one = table(spark, d, "documents").agg(share(F.col("lang") != "en").alias("lang"), share(F.col("n_chars") > 2000).alias("long"))
    return one.unpivot([], ["lang", "long"], "field", "share")


# --- windows ----------------------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def window_latest_per_key(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    last = ev.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", "m.event_id", "m.event_type")


@query("SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_type = 'error', event_id)) = 'error'")
def filter_withdrawn(spark, d):
    """Keys whose latest revision is a cancellation; on the same day the cancellation wins."""
    last = F.max_by(F.col("event_type"), F.struct("ts", F.col("event_type") == "error", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("t")).filter("t = 'error'").select("user_id")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER w AS rank FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 3""")
def window_top_k(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = ranking.top_k(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT o_custkey, min(o_orderdate) AS first_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key,
  min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS first_f FROM orders GROUP BY 1""")
def window_first_and_first_match(spark, d):
    first = F.min(F.struct("o_orderdate", "o_orderkey"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("f"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("first_f"))
    return g.select("o_custkey", F.col("f.o_orderdate").alias("first_at"), F.col("f.o_orderkey").alias("first_key"), "first_f")


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(15,2)) AS delta FROM orders)
SELECT o_custkey, o_orderkey, CAST(sum(delta) OVER w AS DOUBLE) AS balance_after, sum(delta) OVER w < 0 AS overdrawn FROM l
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def window_ledger_balance(spark, d):
    delta = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast(DEC)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", delta.alias("delta"))
    out = ranking.running_balance(o, ["o_custkey"], "o_orderkey", "delta")
    return out.select("o_custkey", "o_orderkey", F.col("balance_after").cast("double").alias("balance_after"), "overdrawn")


@query("""
WITH f AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def window_runs(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ranking.runs(ev, ["user_id"], "event_id", "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, role, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end FROM conversations""")
def window_turn_offsets(spark, d):
    from foretide.operators.media import turn_offsets

    return turn_offsets(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "char_start", "char_end")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events""")
def window_carry_forward(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("s"))
    return ranking.carry_forward(ev, ["user_id"], "event_id", "s", "signup_id").select("event_id", "signup_id")


@query("""
WITH b AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, price, coalesce(lead(price) OVER w, 0) AS runner_up, round(price - coalesce(lead(price) OVER w, 0), 2) AS lead FROM b
WINDOW w AS (PARTITION BY l_partkey ORDER BY price DESC, l_suppkey) QUALIFY row_number() OVER w = 1""")
def window_best_and_runner_up(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    return ranking.best_and_runner_up(b, ["l_partkey"], "price", "l_suppkey").withColumn("lead", F.round("lead", 2))


@query("SELECT lang, text_md5, doc_id FROM (SELECT lang, md5(text) AS text_md5, doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY text_md5 ORDER BY doc_id) = 1")
def window_first_per_key(spark, d):
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("text_md5"), "doc_id")
    return docs.groupBy("text_md5").agg(F.min(F.struct("doc_id", "lang")).alias("m")).select("m.lang", "text_md5", "m.doc_id")


# --- sorts, pages, sets, JSON -----------------------------------------------------------------------------------
@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000 OR (o_totalprice = 100000 AND o_orderkey < 5000)
ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 21""")
def sort_keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ranking.keyset_page(o, [("o_totalprice", True), ("o_orderkey", True)], (100000.0, 5000), 20)


@query("""
SELECT o_orderkey, greatest(coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END, DATE '2100-01-01'), DATE '1996-01-01') AS soon
FROM orders ORDER BY soon, o_orderkey LIMIT 50""")
def sort_soon_key(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    soon = F.greatest(F.coalesce(day, F.lit("2100-01-01").cast("date")), F.lit("1996-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", soon.alias("soon")).orderBy("soon", "o_orderkey").limit(50)


@query("SELECT p_partkey FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 101")
def sort_id_cursor(spark, d):
    return ranking.keyset_page(table(spark, d, "part").select("p_partkey"), [("p_partkey", False)], (100,), 100)


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_union_distinct(spark, d):
    a = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey")).distinct()


@query("SELECT 'stored' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 'legacy', c_custkey FROM customer WHERE c_acctbal < 0")
def set_union_all(spark, d):
    a = table(spark, d, "supplier").select(F.lit("stored").alias("kind"), F.col("s_suppkey").alias("id"))
    return a.unionByName(table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("legacy").alias("kind"), F.col("c_custkey").alias("id")))


@query("""
(SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_difference(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    return a.join(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AND props <> '{}' AS filled FROM events")
def json_path_and_emptiness(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), ((F.substring(F.trim("props"), 1, 1) == "{") & (F.col("props") != "{}")).alias("filled"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"method":"' || event_type || '"}' AS merged FROM events""")
def json_merge_and_build(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("method"))).alias("merged"))


# --- graph ------------------------------------------------------------------------------------------------------
@query("""
WITH RECURSIVE edge AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), reach(a, b) AS (
  SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT a, count(*) AS n_reachable, bool_or(a = b) AS on_cycle FROM reach GROUP BY a""")
def graph_reachability(spark, d):
    from foretide.operators.graph import reachable

    edges = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("b"))
    g = reachable(edges).groupBy("a").agg(F.count("*").alias("n_reachable"), F.bool_or(F.col("a") == F.col("b")).alias("on_cycle"))
    return g.select(F.col("a").cast("int").alias("a"), "n_reachable", "on_cycle")


@query("""WITH RECURSIVE n AS (SELECT max(c_custkey) + 1 AS n FROM customer), step(k, a) AS (SELECT 0, c_custkey FROM customer UNION SELECT k + 1, (a * a + 1) % n FROM step, n WHERE k < 400)
SELECT DISTINCT a, (a * a + 1) % n AS b FROM step, n WHERE k = 400""")
def graph_cyclic_core(spark, d):
    """Every customer leads to one other; what is left when those that nothing leads to are peeled off are the cycles."""
    from foretide.operators.graph import cyclic_core

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"))
    n = c.agg((F.max("a") + 1).alias("n"))
    nodes = c.union(F.broadcast(n).select(F.lit(0).cast("long")))
    return cyclic_core(nodes.crossJoin(F.broadcast(n)).select("a", ((F.col("a") * F.col("a") + 1) % F.col("n")).alias("b")))


@query("""
WITH RECURSIVE h AS (SELECT doc_id, md5(text) AS t FROM documents), e AS (SELECT min(doc_id) AS b, t FROM h GROUP BY t),
p AS (SELECT h.doc_id AS a, least(e.b, (h.doc_id // 25) * 25) AS b, (h.doc_id // 25) * 25 AS c, e.b AS f FROM h JOIN e USING (t)),
edge AS (SELECT a AS x, c AS y FROM p UNION SELECT a, f FROM p), both_ AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
walk(x, y) AS (SELECT x, y FROM both_ UNION SELECT w.x, b.y FROM walk w JOIN both_ b ON w.y = b.x)
SELECT doc_id, least(min(y), doc_id) AS component FROM h LEFT JOIN walk ON x = doc_id GROUP BY doc_id""")
def graph_components(spark, d):
    from foretide.operators.graph import components

    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("t"))
    first = docs.groupBy("t").agg(F.min("doc_id").alias("f"))
    edges = docs.join(first, "t").select("doc_id", F.explode(F.array(F.col("f"), F.floor(F.col("doc_id") / 25) * 25)).alias("b"))
    found = components(edges.select(F.col("doc_id").alias("a"), "b"))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("component"))
