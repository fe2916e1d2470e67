"""Linking, protection, relations, markets, back-tests and coverage over orders as signals and customers as their groups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.constants import STAGES
from foretide.operators import backtest, evaluation, governance, joins, link, market, media, partition, resolve, retrospective, reviews
from foretide.plans.records import customer_key, order_day, order_key, order_price
from foretide.plans.registry import registry
from foretide.plans.scalars import pick, s, sql_pick
from foretide.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

_LEVELS = ("committed", "planned", "reviewing", "declined")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as signals of their customer: stage, category, department, level and references by key."""
    none = F.lit(None).cast("string")
    return orders(spark, d).select(
        order_key().alias("id"), s(customer_key()).alias("institution"), (order_key() % 1000).alias("document_id"), pick(order_key(), *STAGES).alias("stage"), order_day().alias("observed_at"),
        F.concat(F.lit("[긴급] "), F.col("o_orderpriority")).alias("title"), pick(order_key(), "a", "b", "other", "b", "c").alias("category"), F.when(order_key() % 4 > 0, pick(order_key(), "x", "y", "z")).alias("department"),
        F.floor(order_price()).alias("budget_krw"), F.when(order_key() % 6 == 0, pick(order_key(), *_LEVELS)).alias("commitment"), F.when(order_key() % 7 == 0, F.year(order_day()) + 1).cast("int").alias("expected_year"), F.when(order_key() % 14 == 0, "H1").alias("expected_half"),
        F.array(s(order_key() % 9), s(order_key() % 5)).alias("keywords"),
        F.struct(
            F.when(order_key() % 3 == 0, F.concat(F.lit("P"), s(order_key() % 4))).alias("order_plan_no"), none.alias("prespec_no"), F.when(order_key() % 6 == 4, F.concat(F.lit("B"), s(order_key()))).alias("bid_notice_no"),
            F.array().cast("array<string>").alias("bid_notice_nos"), none.alias("cancels_bid_notice_no"),
        ).alias("refs"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lpad(s(order_key()), 12, "0").alias("stable_key"),
    )


#: The same in SQL: stage number, members in their order.
_SIGNALS = f"""g AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS inst, o_orderkey % 1000 AS doc, o_orderkey % 6 AS st, CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS title, {sql_pick('o_orderkey', 'a', 'b', 'other', 'b', 'c')} AS cat,
  CASE WHEN o_orderkey % 4 > 0 THEN {sql_pick('o_orderkey', 'x', 'y', 'z')} END AS dept, CAST(floor(o_totalprice) AS BIGINT) AS amount, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 4 END AS lv, CASE WHEN o_orderkey % 7 = 0 THEN year(o_orderdate) + 1 END AS ey,
  CASE WHEN o_orderkey % 14 = 0 THEN 'H1' END AS eh, [(o_orderkey % 9)::VARCHAR, (o_orderkey % 5)::VARCHAR] AS kw, lpad(o_orderkey::VARCHAR, 12, '0') AS k FROM orders)"""
_LAG = "[[180, 540], [60, 300], [20, 150], [7, 45], [0, 0], [0, 0]][CAST(t.st AS INTEGER) + 1]"


#: Members of given groups: vectors of most, notices that later ones of their number withdraw.
_MEMBERS = _SIGNALS + """, v AS (SELECT *, CASE WHEN st = 4 THEN 'N' || id % 2 END AS no, st = 4 AND id % 4 = 2 AS cancels FROM g),
rev AS (SELECT inst, no FROM v WHERE no IS NOT NULL GROUP BY inst, no HAVING arg_max(cancels, (dt, cancels))),
m AS (SELECT v.*, NOT (v.st = 4 AND (v.cancels OR rev.no IS NOT NULL)) AS live FROM v LEFT JOIN rev ON rev.inst = v.inst AND rev.no = v.no AND NOT v.cancels),
base AS (SELECT * FROM m QUALIFY live OR NOT bool_or(live) OVER (PARTITION BY inst)),
vec AS (SELECT inst, sum(id % 7 - 3)::DOUBLE AS x, sum(id % 5 - 1)::DOUBLE AS y FROM m WHERE id % 4 > 0 GROUP BY inst)"""


@query(f"""WITH {_MEMBERS},
a AS (SELECT inst, arg_max(struct_pack(st := st, title := title, cat := cat, dt := dt, ey := ey, eh := eh), (st, dt, k)) AS top,
  arg_max(struct_pack(st := st, dt := dt, ey := ey, eh := eh), (st, dt, k)) FILTER (WHERE ey IS NOT NULL) AS timed, arg_max(title, (st, dt, k)) FILTER (WHERE st >= 1) AS formal,
  arg_max(amount, (st, dt, k)) FILTER (WHERE amount <> 0) AS amount, CASE WHEN bool_or(live) THEN min(dt) FILTER (WHERE live AND st >= 4) ELSE min(dt) END AS bid, bool_or(live) AS alive FROM base GROUP BY inst),
all_ AS (SELECT inst, count(*) AS n, count(DISTINCT doc) AS docs, min(dt) AS first_at, max(dt) AS last_at, max(3 - lv) AS lv FROM m GROUP BY inst),
kw AS (SELECT inst, list(w ORDER BY n) AS kws FROM (SELECT inst, w, row_number() OVER (PARTITION BY inst ORDER BY st DESC, dt DESC, k DESC, at_) AS n FROM (SELECT inst, w, st, dt, k, at_ FROM (SELECT inst, st, dt, k, unnest(kw) AS w, unnest([0, 1]) AS at_ FROM m) QUALIFY row_number() OVER (PARTITION BY inst, w ORDER BY st DESC, dt DESC, k DESC, at_) = 1)) WHERE n <= 10 GROUP BY inst),
c AS (SELECT inst, cat FROM (SELECT inst, cat, count(*) AS n, min((dt, k)) AS f FROM m WHERE cat <> 'other' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY inst ORDER BY n DESC, f) = 1),
dp AS (SELECT inst, dept FROM (SELECT inst, dept, count(*) AS n, min((dt, k)) AS f FROM m WHERE dept IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY inst ORDER BY n DESC, f) = 1),
t AS (SELECT *, coalesce(timed.st, top.st) AS st, coalesce(timed.dt, top.dt) AS tat, coalesce(timed.ey, top.ey) AS ey, coalesce(timed.eh, top.eh) AS eh FROM a JOIN all_ USING (inst)),
w AS (SELECT *, CASE WHEN ey IS NOT NULL AND make_date(CAST(ey AS INTEGER), CASE WHEN eh = 'H1' THEN 6 ELSE 11 END, 30) >= tat THEN true ELSE false END AS by_year, {_LAG} AS lag FROM t),
u AS (SELECT *, CASE WHEN by_year THEN greatest(make_date(CAST(ey AS INTEGER), 1, CASE WHEN eh = 'H1' THEN 1 ELSE 15 END), tat) ELSE tat + lag[1] END AS ws, CASE WHEN by_year THEN make_date(CAST(ey AS INTEGER), CASE WHEN eh = 'H1' THEN 6 ELSE 11 END, 30) ELSE tat + lag[2] END AS we FROM w)
SELECT v.inst AS group_key, {sql_pick('top.st', *STAGES)} AS stage, CAST(n AS INTEGER) AS signal_count, first_at AS first_seen_at, last_at AS last_signal_at, coalesce(formal, top.title) AS title, coalesce(c.cat, top.cat) AS category, dept AS department, amount AS est_budget_krw,
  ['declined', 'reviewing', 'planned', 'committed'][CAST(lv AS INTEGER) + 1] AS best_commitment, bid AS bid_published_at, coalesce(bid, ws) AS bid_window_start, coalesce(bid, we) AS bid_window_end,
  array_to_string(kws, ',') AS keywords, round(x / greatest(sqrt(x * x + y * y), 1e-300), 9) AS v0, round(y / greatest(sqrt(x * x + y * y), 1e-300), 9) AS v1,
  CASE WHEN NOT alive THEN 'closed' WHEN bid IS NOT NULL THEN CASE WHEN date_diff('day', bid, DATE '2000-01-01') <= 21 THEN 'bid_open' ELSE 'closed' END WHEN date_diff('day', last_at, DATE '2000-01-01') > 540 OR date_diff('day', we, DATE '2000-01-01') > 180 THEN 'dormant' ELSE 'open' END AS status,
  CASE WHEN top.st >= 4 THEN 1.0 ELSE round(least(0.98::DOUBLE, ([0.35, 0.7, 0.85, 0.95]::DOUBLE[])[CAST(top.st AS INTEGER) + 1] * CASE WHEN top.st = 0 THEN coalesce(([0.15, 0.6, 1.2, 1.6]::DOUBLE[])[CAST(lv AS INTEGER) + 1], 1) ELSE 1 END + 0.05::DOUBLE * least(greatest(docs - 1, 0), 3)), 3) END AS conversion_prob
FROM u AS v LEFT JOIN kw ON kw.inst = v.inst LEFT JOIN vec ON vec.inst = v.inst LEFT JOIN c ON c.inst = v.inst LEFT JOIN dp ON dp.inst = v.inst""")
def link_group_summaries(spark, d):
    """Summaries of groups that are given, one a customer: with vectors, keywords and withdrawn notices."""
    k = F.col("id")
    bid, number = F.col("stage") == "bid_notice", F.concat(F.lit("N"), s(k % 2))
    m = signals(spark, d).withColumn("group_key", F.col("institution")).withColumns(
        {
            "refs": F.col("refs").withField("bid_notice_no", F.when(bid & (k % 4 != 2), number)).withField("cancels_bid_notice_no", F.when(bid & (k % 4 == 2), number)),
            "embedding": F.when(k % 4 > 0, F.array((k % 7 - 3).cast("double"), (k % 5 - 1).cast("double"))),
        }
    )
    g = link.summaries(m, date(2000, 1, 1))
    part = lambda i: F.round(F.get("embedding", F.lit(i)), 9).alias(f"v{i}")
    return g.select(*[c for c in g.columns if c not in ("embedding", "keywords")], F.array_join("keywords", ",").alias("keywords"), part(0), part(1))


@query(f"""WITH {_SIGNALS}, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'P' || id % 4 END AS plan FROM g)
SELECT id, inst || ':' || CASE WHEN plan IS NULL THEN k ELSE first_value(k) OVER (PARTITION BY inst, coalesce(plan, k) ORDER BY dt, k) END AS group_key,
  CASE WHEN plan IS NOT NULL AND row_number() OVER (PARTITION BY inst, coalesce(plan, k) ORDER BY dt, k) > 1 THEN 'ref' ELSE 'seed' END AS method FROM r""")
def link_by_reference(spark, d):
    """The partition where only reference numbers link: no similarity reaches the threshold."""
    return partition.canonical_partition(signals(spark, d), threshold=9.0).select("id", "group_key", "method")


@query(f"""SELECT v.arrival, x.* FROM ({ORACLE_SQL["link_by_reference"]}) x, (VALUES ('publication'), ('reverse'), ('budget_first')) v(arrival)""")
def link_arrival_orders(spark, d):
    """Signals arrive in two deliveries, in three orders; each delivery is linked from where the one before has ended."""
    out = None
    for name, found in partition.replayed(signals(spark, d), threshold=9.0).items():
        found = found.select(F.lit(name).alias("arrival"), "id", "group_key", "method")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_orderkey % 4 ELSE 'B' || o_orderkey END AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 6 = 4), m AS (SELECT DISTINCT c, v, (id % 7) AS g FROM r WHERE id % 2 = 0), j AS (SELECT DISTINCT r.id, m.g FROM r JOIN m USING (c, v))
SELECT id, CASE WHEN count(*) = 1 THEN min(g) END AS target, count(*) > 1 AS conflict FROM j GROUP BY id""")
def link_reference_targets(spark, d):
    sig = signals(spark, d)
    return joins.reference_matches(sig, sig.filter("id % 2 = 0").withColumn("group_id", F.col("id") % 7))


@query("""SELECT o_custkey || ':' || o_orderkey % 3 AS group_key, o_custkey * 10 + o_orderkey % 3 AS opportunity_id FROM orders GROUP BY o_custkey, o_orderkey % 3 HAVING count(*) FILTER (WHERE o_custkey % 2 = 0 OR o_orderkey % 5 > 0) > 0""")
def link_kept_identities(spark, d):
    """Groups keep the ids they had: of even customers with the same members, of odd ones by what is left of them."""
    o = orders(spark, d).select(s(customer_key()).alias("institution"), customer_key().alias("c"), order_key().alias("id"))
    new = o.select("institution", F.concat("institution", F.lit(":"), s(F.col("id") % 3)).alias("group_key"), "id")
    old = o.filter((F.col("c") % 2 == 0) | (F.col("id") % 5 > 0)).select("institution", (F.col("c") * 10 + F.col("id") % 3).alias("opportunity_id"), "id")
    return link.keep_identities(new, old)


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey AS g FROM orders WHERE o_orderkey % 5 > 0), a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS g FROM orders WHERE o_orderkey % 7 > 0)
SELECT coalesce(a.id, b.id) AS id, b.g AS before, a.g AS after, CASE WHEN b.g IS NULL THEN 'linked' WHEN a.g IS NULL THEN 'unlinked' ELSE 'moved' END AS event FROM a FULL JOIN b ON a.id = b.id WHERE a.g IS DISTINCT FROM b.g""")
def link_membership_events(spark, d):
    o = orders(spark, d).select(order_key().alias("id"), customer_key().alias("opportunity_id"))
    new = o.filter("id % 7 > 0").withColumn("opportunity_id", F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("opportunity_id")))
    return link.membership_events(o.filter("id % 5 > 0"), new)


@query("""SELECT c_custkey AS opportunity_id, CASE WHEN c_custkey % 4 = 0 THEN 'dormant' ELSE 'open' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS conversion_prob, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 3 END AS BIGINT) AS signal_count FROM customer""")
def link_reconciled(spark, d):
    """Opportunities after a reconciliation: those that no group keeps are dormant and empty, the others as their group."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("opportunity_id"))
    stored = c.select("opportunity_id", F.lit("bid_open").alias("status"), F.lit(0.9).alias("conversion_prob"), F.lit(7).cast("long").alias("signal_count"))
    now = c.filter("opportunity_id % 4 > 0").select("opportunity_id", F.lit("open").alias("status"), F.lit(0.5).alias("conversion_prob"), F.lit(3).cast("long").alias("signal_count"))
    return link.reconciled(stored, now)


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS opp, o_orderkey % 53 = 0 AS manual, o_orderkey % 59 = 0 AS tentative, CASE WHEN o_orderkey % 61 = 0 THEN 'rejected' ELSE 'accepted' END AS v, CASE WHEN o_orderkey % 67 = 0 THEN -1 ELSE o_custkey % 9 END AS si, o_custkey % 9 AS oi FROM orders),
scope AS (SELECT c_custkey AS opp FROM customer WHERE c_custkey % 9 IN (1, 2) UNION SELECT opp FROM m WHERE si IN (1, 2)),
hit AS (SELECT opp FROM m WHERE manual OR tentative OR v <> 'accepted' OR si <> oi UNION SELECT opp FROM m WHERE id % 71 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 37 = 0 UNION SELECT unnest([c_custkey, c_custkey + 1]) FROM customer WHERE c_custkey % 41 = 0
  UNION SELECT c_custkey FROM customer WHERE c_custkey % 43 = 0 UNION SELECT opp FROM m WHERE id % 73 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 47 = 0)
SELECT DISTINCT opp AS opportunity_id FROM scope WHERE opp IN (SELECT opp FROM hit)""")
def govern_protected(spark, d):
    """Every rule of protection, each met by some customers."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    o = c.select(k.alias("opportunity_id"), s(k % 9).alias("institution"))
    m = orders(spark, d).select(
        order_key().alias("id"), customer_key().alias("opportunity_id"), F.when(order_key() % 53 == 0, "manual").otherwise("similarity").alias("method"), (order_key() % 59 == 0).alias("tentative"),
        F.when(order_key() % 61 == 0, "rejected").otherwise("accepted").alias("verdict"), F.when(order_key() % 67 == 0, "-1").otherwise(s(customer_key() % 9)).alias("signal_institution"),
    )
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<bigint>")
    rev = orders(spark, d).filter(order_key() % 71 == 0).select(order_key().alias("signal_id"), F.lit("done").alias("status"), none.alias("resolved_at"), none.alias("resolved_by"), empty.alias("mentions"))
    named = c.filter(k % 37 == 0).select(F.lit(-1).cast("long").alias("signal_id"), F.lit("open").alias("status"), none.alias("resolved_at"), none.alias("resolved_by"), F.array(k).alias("mentions"))
    rel = c.filter(k % 41 == 0).select(k.alias("project_id"), (k + 1).alias("contract_id"))
    told = c.filter(k % 43 == 0).select(F.array(k).alias("opportunity_ids"), empty.alias("evidence_signal_ids"))
    moved = orders(spark, d).filter(order_key() % 73 == 0).select(empty.alias("opportunity_ids"), F.array(order_key()).alias("evidence_signal_ids"))
    cores = c.filter(k % 47 == 0).select(k.alias("opportunity_id"), F.when(k % 2 == 0, F.array(F.lit(-5).cast("long"))).otherwise(empty).alias("signal_ids"))
    return governance.protected(o, m, rev.union(named), rel, told.union(moved), cores, ["1", "2"])


@query("""SELECT o_custkey AS opportunity_id, array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderdate <= a)), '|') AS core FROM orders JOIN (SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS a FROM orders GROUP BY 1) USING (o_custkey) WHERE o_orderdate <= a GROUP BY 1""")
def govern_anchors(spark, d):
    acts = orders(spark, d).filter("o_orderstatus = 'F'").select(customer_key().alias("opportunity_id"), F.col("o_orderdate").alias("at"))
    m = orders(spark, d).select(customer_key().alias("opportunity_id"), order_key().alias("id"), F.col("o_orderdate").alias("linked_at"))
    return governance.anchors(acts, m).select("opportunity_id", F.array_join("signal_ids", "|").alias("core"))


@query("""SELECT coalesce(s.i, c.i) AS institution, CAST(coalesce(s.gen, 0) + CASE WHEN c.i IS NULL THEN 0 ELSE 1 END AS INTEGER) AS generation, CAST(coalesce(s.gen - 1, 0) AS INTEGER) AS reconciled
FROM (SELECT c_custkey AS i, CAST(c_custkey % 4 + 1 AS INTEGER) AS gen FROM customer WHERE c_custkey % 3 > 0) s FULL JOIN (SELECT DISTINCT o_custkey AS i FROM orders WHERE o_orderstatus = 'P') c ON s.i = c.i""")
def govern_dirty_generations(spark, d):
    k = F.col("c_custkey")
    st = table(spark, d, "customer").filter(k % 3 > 0).select(k.alias("institution"), (k % 4 + 1).cast("int").alias("generation"), (k % 4).cast("int").alias("reconciled"))
    return governance.dirty(st, orders(spark, d).filter("o_orderstatus = 'P'").select(customer_key().alias("institution")))


@query("""WITH x AS (SELECT c_custkey AS id, c_custkey % 8 AS k FROM customer WHERE c_custkey >= 2)
SELECT id AS relation_id, array_to_string(list_sort(CASE k WHEN 0 THEN [] WHEN 1 THEN ['evidence_changed'] WHEN 2 THEN ['missing_evidence:' || -id, 'both_endpoint_roles_required'] WHEN 3 THEN ['evidence_ids_invalid', 'both_endpoint_roles_required'] WHEN 4 THEN ['institution_mismatch', 'evidence_institution_mismatch:' || (id * 10 + 1)]
  WHEN 5 THEN ['evidence_not_eligible:' || (id * 10 + 1), 'both_endpoint_roles_required'] WHEN 6 THEN ['evidence_wrong_endpoint_or_stage:' || (id * 10 + 1), 'both_endpoint_roles_required'] ELSE ['evidence_changed'] END), '|') AS reasons, CASE WHEN k = 7 THEN 'rejected' WHEN k = 0 THEN 'confirmed' ELSE 'stale' END AS effective_status FROM x""")
def govern_relation_validity(spark, d):
    """Relations of which each eighth breaks in its own way."""
    id_ = F.col("id")
    x = table(spark, d, "customer").filter("c_custkey >= 2").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).alias("k"))
    first, second = id_ * 10, id_ * 10 + 1
    ev = lambda i, f="f": F.struct(i.alias("signal_id"), F.lit(f).alias("fingerprint"))
    evidence = F.when(F.col("k").isin(1, 7), F.array(ev(first), ev(second, "old"))).when(F.col("k") == 2, F.array(ev(first), ev(-id_))).when(F.col("k") == 3, F.array(ev(first))).otherwise(F.array(ev(first), ev(second)))
    rel = x.select(id_.alias("relation_id"), (id_ * 100).alias("project_id"), (id_ * 100 + 1).alias("contract_id"), F.when(F.col("k") == 7, "rejected").otherwise("confirmed").alias("status"), evidence.alias("evidence"))
    opp = x.select((id_ * 100).alias("opportunity_id"), F.lit("I").alias("institution")).union(x.select(id_ * 100 + 1, F.when(F.col("k") == 4, "J").otherwise("I")))
    a = x.select(first.alias("signal_id"), (id_ * 100).alias("opportunity_id"), F.lit("I").alias("institution"), F.lit("budget_line").alias("stage"), F.lit("accepted").alias("verdict"), F.lit(False).alias("tentative"), F.lit("f").alias("fingerprint"))
    b = x.select(second.alias("signal_id"), (id_ * 100 + 1).alias("opportunity_id"), F.when(F.col("k") == 4, "J").otherwise("I").alias("institution"), F.when(F.col("k") == 6, "budget_line").otherwise("bid_notice").alias("stage"), F.when(F.col("k") == 5, "rejected").otherwise("accepted").alias("verdict"), F.lit(False).alias("tentative"), F.lit("f").alias("fingerprint"))
    return governance.relation_validity(rel, opp, a.union(b)).select("relation_id", F.array_join("reasons", "|").alias("reasons"), "effective_status")


@query("""SELECT o_custkey AS relation_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def govern_relation_state(spark, d):
    e = orders(spark, d).select(customer_key().alias("relation_id"), order_key().alias("version"), F.col("o_orderstatus").alias("status"), customer_key().alias("project_id"), customer_key().alias("contract_id"), s(order_key()).alias("idempotency_key"))
    return governance.relation_state(e.union(e)).select("relation_id", "version", "status")


@query("""SELECT o_custkey % 50 AS contract_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1""")
def govern_relation_violations(spark, d):
    st = orders(spark, d).select((customer_key() % 50).alias("contract_id"), F.when(F.col("o_orderstatus") == "P", "confirmed").otherwise("proposed").alias("status"))
    return governance.relation_violations(st)


@query("""SELECT o_orderkey AS relation_id FROM orders WHERE o_orderstatus = 'F' AND (o_custkey = 5 OR o_custkey + 1 = 5) AND o_orderkey > 10 ORDER BY 1 LIMIT 51""")
def govern_relation_page(spark, d):
    rel = orders(spark, d).select(order_key().alias("relation_id"), F.col("o_orderstatus").alias("status"), customer_key().alias("project_id"), (customer_key() + 1).alias("contract_id"))
    return governance.connected_pages(rel, 10, 50, "F", 5).select("relation_id")


@query("""SELECT o_custkey AS opportunity_id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey > 20 GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 6 < 2) > 0 AND count(*) FILTER (WHERE o_orderkey % 6 >= 2) > 0 ORDER BY 1 LIMIT 51""")
def govern_mixed_groups(spark, d):
    m = orders(spark, d).select(customer_key().alias("opportunity_id"), pick(order_key(), *STAGES).alias("stage"), F.lit("accepted").alias("verdict"), (F.col("o_orderstatus") == "P").alias("tentative"))
    return governance.mixed_groups(m, 20, 50).select("opportunity_id")


_COVER = """d AS (SELECT source, lang, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'available' WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'unverified' END AS raw, coalesce(CASE doc_id % 5 WHEN 0 THEN 'crawled' WHEN 1 THEN 'provider' END, 'unspecified') AS origin, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS dt FROM documents WHERE doc_id % 11 > 0)"""


@query(f"""WITH {_COVER}, h AS (SELECT source, lang, grouping_id(lang, source) AS level, origin, count(*) AS n FROM d GROUP BY GROUPING SETS ((lang, origin), (source, origin), (origin)))
SELECT coalesce(a.lang, '*') AS lang, coalesce(a.source, '*') AS source, CAST(a.level AS BIGINT) AS level, collected, raw_available, raw_missing, first_at, last_at, sources, origins FROM
 (SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS collected, count(*) FILTER (WHERE raw = 'available') AS raw_available, count(*) FILTER (WHERE raw = 'missing') AS raw_missing, min(dt) AS first_at, max(dt) AS last_at, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
  FROM d GROUP BY GROUPING SETS ((lang), (source), ())) a JOIN (SELECT lang, source, level, string_agg(origin || '=' || n, '|' ORDER BY origin) AS origins FROM h GROUP BY 1, 2, 3) b
 ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source""")
def govern_coverage(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        "source", "lang", (k % 3 == 0).alias("has_inline"), F.when(k % 4 > 0, "gs://x").alias("raw_uri"), (k % 11 == 0).alias("synthetic"), F.when(k % 5 == 0, "crawled").when(k % 5 == 1, "provider").alias("published_from"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 300 as int))").alias("published_at"),
    )
    c = governance.coverage(docs, ["lang", "source"])
    shown = F.array_join(F.transform("origins", lambda e: F.concat(e["origin"], F.lit("="), s(e["n"]))), "|")
    return c.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "level", "collected", "raw_available", "raw_missing", "first_at", "last_at", F.array_join("sources", "|").alias("sources"), shown.alias("origins"))


@query("""WITH o AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3), m AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM o))
SELECT 'prediction' AS record_type, id FROM o UNION ALL SELECT 'evidence', id FROM m UNION ALL SELECT 'lineage', id * 10 FROM m""")
def govern_forecast_snapshot(spark, d):
    none = F.lit(None).cast("string")
    k = F.col("c_custkey")
    o = table(spark, d, "customer").select(k.alias("opportunity_id"), s(F.col("c_nationkey")).alias("institution"), none.alias("stage"), none.alias("status"), none.alias("bid_window_start"), none.alias("bid_window_end"), none.alias("conversion_prob"))
    m = orders(spark, d).select(order_key().alias("id"), customer_key().alias("opportunity_id"), none.alias("stage"), order_day().alias("observed_at"), (order_key() * 10).alias("document_id"))
    docs = orders(spark, d).select((order_key() * 10).alias("document_id"), order_day().alias("published_at"))
    return governance.forecast_snapshot(o, m, docs, "3").select("record_type", "id")


@query("SELECT c_nationkey::VARCHAR AS institution, count(*) AS n FROM customer WHERE c_custkey % 4 < 2 GROUP BY 1")
def govern_frozen_counts(spark, d):
    k = F.col("c_custkey")
    return governance.freeze_open(table(spark, d, "customer").select(s(F.col("c_nationkey")).alias("institution"), pick(k, "open", "bid_open", "closed", "dormant").alias("status")))


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey AS opp, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 3 > 0), x AS (SELECT o_orderkey AS id, o_orderkey % 5 > 0 AS ok, l.opp, l.n, o_orderkey % 7 = 0 AS manual, o_orderkey % 11 = 0 AS elsewhere FROM orders LEFT JOIN l ON l.id = o_orderkey WHERE o_orderkey % 2 = 0)
SELECT id, CASE WHEN ok AND opp IS NOT NULL AND NOT elsewhere AND (manual OR n = 1) THEN 'preserve' WHEN ok AND opp IS NOT NULL THEN 'relink' WHEN ok THEN 'link' WHEN opp IS NOT NULL THEN 'unlink' ELSE 'none' END AS action FROM x""")
def review_actions(spark, d):
    sig = signals(spark, d).withColumn("verdict", F.lit("needs_review"))
    links = orders(spark, d).filter(order_key() % 3 > 0).select(order_key().alias("id"), customer_key().alias("opportunity_id"), F.when(order_key() % 7 == 0, "manual").otherwise("similarity").alias("method"), F.when(order_key() % 11 == 0, "-").otherwise(s(customer_key())).alias("institution"), F.lit(None).cast("string").alias("fingerprint"))
    dec = orders(spark, d).filter(order_key() % 2 == 0).select(order_key().alias("id"), F.when(order_key() % 5 > 0, "accepted").otherwise("rejected").alias("verdict"))
    return reviews.after_review(sig, links, dec).select("id", "action")


@query("""WITH b AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS label FROM orders), h AS (SELECT id, CAST('0x' || substr(sha256(label::VARCHAR), 1, 8) AS BIGINT) % 100 AS b FROM b)
SELECT id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM h""")
def review_splits(spark, d):
    return reviews.review_split(orders(spark, d).select(order_key().alias("id"), customer_key().alias("document_id"), F.sha2(s(customer_key()), 256).alias("text_hash"))).select("id", "split")


# --- market --------------------------------------------------------------------------------------------------------------------
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("opportunity_id"), s(F.col("c_nationkey")).alias("institution"), pick(k, "open", "bid_open", "closed", "open", "dormant").alias("status"), F.concat(F.lit("Works "), F.col("c_name")).alias("title"), F.lower("c_mktsegment").alias("category"),
        pick(k, *STAGES).alias("stage"), F.array(F.lower("c_mktsegment"), s(k % 10)).alias("keywords"), (k * 1000).alias("est_budget_krw"), F.expr("date_add(date'2000-01-01', cast(c_custkey % 400 as int) - 100)").alias("bid_window_start"),
        F.expr("date_add(date'2000-01-01', cast(c_custkey % 400 as int) - 40)").alias("bid_window_end"), (k % 10 / 10).alias("conversion_prob"), F.lit(None).cast("array<double>").alias("embedding"),
        F.expr("date_sub(date'2000-01-01', cast(c_custkey % 90 as int))").alias("last_signal_at"), F.lit(None).cast("date").alias("bid_published_at"),
    )


_OPPS = f"""o AS (SELECT c_custkey AS id, c_nationkey AS inst, {sql_pick('c_custkey', 'open', 'bid_open', 'closed', 'open', 'dormant')} AS status, lower(c_mktsegment) AS cat, c_custkey % 6 AS st, c_name FROM customer)"""


@query(f"""WITH {_OPPS} SELECT id AS opportunity_id FROM o WHERE status IN ('open', 'bid_open') AND inst % 4 > 0""")
def market_open_and_settled(spark, d):
    n = F.col("n_nationkey")
    states = table(spark, d, "nation").select(s(n).alias("institution"), F.when(n % 4 == 0, 2).otherwise(1).alias("generation"), F.lit(1).alias("reconciled"))
    return market.open_and_settled(opportunities(spark, d), states).select("opportunity_id")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(1, ["building", "3"], ["zzz"], ["machinery"], ["1"], 1000, 900_000), (2, ["#00000000", "7"], [], [], [], None, None), (3, ["nothing"], ["household"], ["household", "building"], ["2", "3"], None, 500_000)]
    kinds = "org_id long, keywords array<string>, exclude_keywords array<string>, categories array<string>, region_codes array<string>, budget_min long, budget_max long"
    return spark.createDataFrame(rows, kinds).withColumn("embedding", F.lit(None).cast("array<double>"))


_PROFILES = """p(org, kws, cats) AS (VALUES (1, ['building', '3'], ['machinery']), (2, ['#00000000', '7'], []), (3, ['nothing'], ['household', 'building']))"""


@query(f"""WITH {_OPPS}, {_PROFILES}, f AS (SELECT * FROM o WHERE status IN ('open', 'bid_open')),
w AS (SELECT DISTINCT org, f.id FROM f, p, unnest(kws) AS t(k) WHERE k IN (cat, (f.id % 10)::VARCHAR) OR 'Works ' || c_name ILIKE '%' || k || '%'), c AS (SELECT DISTINCT org, f.id FROM f, p WHERE list_contains(cats, cat))
SELECT DISTINCT org::BIGINT AS org_id, id AS opportunity_id FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY org ORDER BY id) <= 40 UNION SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY org ORDER BY id) <= 40)""")
def market_candidates(spark, d):
    return market.candidates(market.open_and_settled(opportunities(spark, d)), profiles(spark), 40)


@query("""WITH q AS (SELECT vec_id AS org, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT org AS org_id, vec_id AS opportunity_id FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY org ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id) <= 10""")
def market_nearest(spark, d):
    """Each twentieth vector's ten nearest of all."""
    e = table(spark, d, "embeddings")
    return market.nearest(e.select(F.col("vec_id").alias("opportunity_id"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("org_id"), F.col("embedding").alias("pv")), 10).select("org_id", "opportunity_id")


@query(f"""WITH {_OPPS}, r AS (SELECT o.*, id % 100 / 100.0::DOUBLE AS score FROM o WHERE status IN ('open', 'bid_open') AND cat IN ('building', 'machinery') AND (id % 3 > 0))
SELECT id AS opportunity_id, score, CAST(date_diff('day', DATE '1970-01-01', greatest(DATE '2000-01-01' + CAST(id % 400 AS INTEGER) - 100, DATE '2000-01-01')) AS DOUBLE) AS sort_key FROM r ORDER BY sort_key, score DESC, id DESC LIMIT 21""")
def market_feed_page(spark, d):
    o = opportunities(spark, d)
    rec = o.select(F.lit(1).alias("org_id"), "opportunity_id", (F.col("opportunity_id") % 100 / 100).alias("score"), F.when(F.col("opportunity_id") % 3 == 0, "dismissed").alias("feedback"))
    rows = market.feed(rec, o, 1, date(2000, 1, 1), sort="soon", categories=["building", "machinery"])
    return market.feed_page(rows).select("opportunity_id", "score", "sort_key")


@query(f"""WITH {_OPPS} SELECT {sql_pick('st', *STAGES)} AS stage, count(*) AS n FROM o WHERE status IN ('open', 'bid_open') AND contains(c_name, '1') GROUP BY 1""")
def market_stage_counts(spark, d):
    o = opportunities(spark, d)
    rec = o.select(F.lit(1).alias("org_id"), "opportunity_id", F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("feedback"))
    return market.stage_counts(market.feed(rec, o, 1, date(2000, 1, 1), q="R#%1"))


@query(f"""WITH {_OPPS}, r AS (SELECT o.*, id % 2 AS org, id % 100 / 100.0::DOUBLE AS score FROM o WHERE status IN ('open', 'bid_open') AND id % 100 >= 55 AND id % 3 > 0 AND (id % 5 > 0 OR st > 1))
SELECT org AS org_id, id AS opportunity_id, row_number() OVER w AS rank, row_number() OVER w <= CASE WHEN org = 1 THEN 20 ELSE 15 END AS shown FROM r WINDOW w AS (PARTITION BY org ORDER BY score DESC, id)""")
def market_alerts(spark, d):
    o, k = opportunities(spark, d), F.col("opportunity_id")
    rec = o.select((k % 2).alias("org_id"), k, (k % 100 / 100).alias("score"), F.when(k % 3 == 0, "dismissed").alias("feedback"), F.when(k % 5 == 0, "budget_line").alias("notified_stage"))
    rules = spark.createDataFrame([(0, 0.55, None, "daily"), (1, 0.55, [], "instant")], "org_id long, min_score double, stages array<string>, mode string")
    return market.fresh_alerts(rec, o, rules).select("org_id", "opportunity_id", F.col("rank").cast("long").alias("rank"), "shown")


# --- back-test, evaluation --------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey AS id, greatest(CAST(o_orderdate AS DATE), DATE '1996-01-01') AS available FROM orders WHERE NOT (o_orderkey % 5 = 0 OR (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 1))""")
def backtest_public_dates(spark, d):
    sig = orders(spark, d).select(order_key().alias("id"), F.when(order_key() % 5 == 0, "crawled").when(order_key() % 5 == 1, "provider").alias("published_from"), F.when(order_key() % 7 == 0, order_key()).alias("council_id"), F.lit("1996-01-01").cast("date").alias("published_at"), order_day().alias("observed_at"))
    return backtest.publicly_dated(sig)[0].select("id", "available")


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 6 AS st, DATE '1996-06-01' + CAST(c_custkey % 700 AS INTEGER) AS lo, DATE '1996-06-01' + CAST(c_custkey % 700 AS INTEGER) + 90 AS hi FROM customer),
b AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS bid FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), x AS (SELECT p.*, b.bid, p.id % 5 > 0 AS watched FROM p LEFT JOIN b ON b.id = p.id),
y AS (SELECT *, CASE WHEN st >= 4 THEN 'already_published' WHEN bid <= DATE '1996-03-01' THEN 'outcome_predates_freeze' WHEN DATE '1996-03-01' + 540 > DATE '1998-01-01' THEN 'right_censored' WHEN NOT watched THEN 'coverage_incomplete' ELSE 'evaluated' END AS status, coalesce(bid <= DATE '1996-03-01' + 540, false) AS conv FROM x)
SELECT id AS opportunity_id, status, conv AS converted, CAST(CASE WHEN status = 'evaluated' AND conv THEN date_diff('day', DATE '1996-03-01', bid) END AS INTEGER) AS lead_days,
  CASE WHEN status NOT IN ('already_published', 'outcome_predates_freeze') AND lo > DATE '1996-03-01' AND hi <= DATE '1998-01-01' AND watched THEN coalesce(bid BETWEEN lo AND hi, false) END AS window_hit FROM y""")
def backtest_follow_up(spark, d):
    """Forecasts frozen on a day, followed up two years later; watched spans touch but do not overlap."""
    k = F.col("c_custkey")
    lo = F.expr("date_add(date'1996-06-01', cast(c_custkey % 700 as int))")
    c = table(spark, d, "customer")
    p = c.select(k.alias("opportunity_id"), pick(k, *STAGES).alias("stage"), F.lit(None).cast("date").alias("bid_published_at"), lo.alias("bid_window_start"), F.date_add(lo, 90).alias("bid_window_end"))
    out = orders(spark, d).filter("o_orderstatus = 'P'").select(customer_key().alias("opportunity_id"), order_day().alias("published_at"))
    spans = spark.createDataFrame([(date(1996, 1, 1), date(1996, 12, 31)), (date(1997, 1, 1), date(1998, 6, 1))], "start date, end date")
    cov = c.filter(k % 5 > 0).select(k.alias("opportunity_id"), F.explode(F.array(F.struct(F.lit(date(1996, 1, 1)).alias("start"), F.lit(date(1996, 12, 31)).alias("end")), F.struct(F.lit(date(1997, 1, 1)).alias("start"), F.lit(date(1998, 6, 1)).alias("end")))).alias("x")).select("opportunity_id", "x.*")
    del spans
    return backtest.follow_up(p, out, cov, date(1996, 3, 1), date(1998, 1, 1), None)


@query("""SELECT o_orderpriority AS stratum, count(*) AS signals, count(*) FILTER (WHERE h) AS hits, round(quantile_cont(l, 0.5) FILTER (WHERE h), 6) AS median_lead, CAST(min(l) AS BIGINT) AS least_lead, CAST(max(l) AS BIGINT) AS most_lead, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS eligible, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_custkey % 2 = 0) AS within
FROM (SELECT *, o_orderstatus = 'F' AS h, o_orderkey % 365 AS l FROM orders) GROUP BY 1""")
def retrospective_strata(spark, d):
    j = orders(spark, d).select(F.col("o_orderpriority").alias("stratum"), (F.col("o_orderstatus") == "F").alias("hit"), (order_key() % 365).alias("lead_days"), (order_key() % 2 == 0).alias("eligible"), (customer_key() % 2 == 0).alias("in_window"))
    return retrospective.strata(j).withColumn("median_lead", F.round("median_lead", 6))


@query("""SELECT o_orderpriority AS operation, count(*) AS slices, count(*) FILTER (WHERE o_orderkey % 10 >= o_custkey % 10) AS complete, CAST(sum(o_orderkey % 10) AS BIGINT) AS read, CAST(sum(o_custkey % 10) AS BIGINT) AS total FROM orders GROUP BY 1""")
def retrospective_completeness(spark, d):
    return retrospective.census_completeness(orders(spark, d).select(F.col("o_orderpriority").alias("operation"), (order_key() % 10).alias("read"), (customer_key() % 10).alias("total")))


@query("""SELECT o_custkey AS notice_no, o_orderkey % 3 AS revision, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2""")
def retrospective_census(spark, d):
    return retrospective.census(orders(spark, d).select(customer_key().alias("notice_no"), (order_key() % 3).alias("revision"), order_key().alias("seq")))


_AFF = "coalesce(list_max(list_filter(range(3, length({w}) + 1), lambda n: contains(t, left({w}, n)) OR contains(t, right({w}, n)))), 0)"


@query(f"""WITH l AS (SELECT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1), x AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_orderdate AS DATE) AS at, p_name FROM orders JOIN l ON l_orderkey = o_orderkey),
j AS (SELECT a.id AS signal_id, b.id AS notice_id, b.at AS notice_date, string_split(a.p_name, ' ')[1] AS u, string_split(a.p_name, ' ')[2] AS v, replace(b.p_name, ' ', '') AS t FROM x a JOIN x b ON a.c = b.c AND b.at > a.at WHERE a.id % 6 < 2 AND b.id % 6 = 4),
k AS (SELECT *, {_AFF.format(w='u')} AS nu, {_AFF.format(w='v')} AS nv FROM j), r AS (SELECT signal_id, notice_id, notice_date, (nu + nv) / (length(u) + length(v)) AS score FROM k WHERE nu + nv >= 3 AND (nu + nv) / (length(u) + length(v)) >= 0.5)
SELECT signal_id, notice_id, notice_date, round(score, 6) AS score, row_number() OVER w AS rank FROM r WINDOW w AS (PARTITION BY signal_id ORDER BY score DESC, notice_date, notice_id) QUALIFY row_number() OVER w <= 8""")
def retrospective_notices(spark, d):
    """Later notices of the same customer whose title shares what the signal's title names."""
    first = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    x = orders(spark, d).join(first, order_key() == F.col("l_orderkey")).select(order_key().alias("id"), s(customer_key()).alias("institution"), order_day().alias("at"), "p_name")
    early = x.filter("id % 6 < 2").select(F.col("id").alias("signal_id"), "institution", F.col("p_name").alias("title"), F.col("at").alias("observed_at"))
    late = x.filter("id % 6 = 4").select(F.col("id").alias("notice_id"), "institution", F.col("p_name").alias("notice_title"), F.col("at").alias("notice_date"))
    out = retrospective.notice_candidates(early, late)
    return out.select("signal_id", "notice_id", "notice_date", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_orderkey AS doc, l_linenumber::BIGINT AS gold_id, l_linenumber::BIGINT AS pred_id, 50 - min(l_partkey) % 40 AS overlap FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING min(l_suppkey) % 4 > 0""")
def evaluate_overlaps(spark, d):
    ln, shift = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 40
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    gold = li.select(F.col("l_orderkey").alias("doc"), ln.alias("gold_id"), (ln * 100).alias("start"), (ln * 100 + 50).alias("end"))
    pred = li.filter("l_suppkey % 4 > 0").select(F.col("l_orderkey").alias("doc"), ln.alias("pred_id"), (ln * 100 + shift).alias("start"), (ln * 100 + shift + 50).alias("end"))
    return evaluation.best_overlap(gold, pred)


@query("""SELECT o_custkey::VARCHAR AS "case", count(*) AS matched FROM orders GROUP BY 1""")
def evaluate_matching(spark, d):
    """Every order can have its own side or its neighbour's; a maximum matching serves all."""
    o = orders(spark, d).select(s(customer_key()).alias("case"), order_key().alias("k"))
    edges = o.select("case", F.lpad(s(F.col("k")), 9, "0").alias("left"), F.explode(F.array(s(F.col("k")), F.lit("shared"))).alias("right"))
    return evaluation.maximum_matching(edges).groupBy("case").agg(F.count("*").alias("matched"))


@query("""SELECT o_custkey::VARCHAR AS "case", o_orderkey AS expected, o_orderkey AS predicted FROM orders WHERE o_orderkey % 3 < 2""")
def evaluate_two_pass(spark, d):
    """Expectations found by title, or by title and keywords, or not at all."""
    word = F.concat(F.lit("<"), s(order_key()), F.lit(">"))
    want = orders(spark, d).select(s(customer_key()).alias("case"), F.lit("expected").alias("kind"), order_key().alias("id"), F.lit("").alias("title"), F.array(word).alias("words"))
    got = orders(spark, d).select(s(customer_key()).alias("case"), F.lit("predicted").alias("kind"), order_key().alias("id"), F.when(order_key() % 3 == 0, word).otherwise("x").alias("title"), F.when(order_key() % 3 == 1, F.array(word)).otherwise(F.array().cast("array<string>")).alias("words"))
    return evaluation.two_pass_match(want.union(got))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, left(p_name, length(p_name) - 1) || '0' AS misread FROM n) SELECT p_name AS code, true AS close FROM m""")
def resolve_spelling(spark, d):
    """Long names with one misread letter find their body."""
    n = table(spark, d, "part").select("p_name").distinct()
    long_ = F.concat(F.col("p_name"), F.lit(" "), F.sha2("p_name", 256))
    names = n.select(F.xxhash64("p_name").alias("nid"), F.concat(F.expr("left(concat(p_name, ' ', sha2(p_name, 256)), 60)"), F.lit("#"), F.substring(long_, F.lit(62), F.lit(99))).alias("jamo"))
    found = resolve.spelled_like(names, n.select(F.col("p_name").alias("code"), long_.alias("alias_jamo")))
    return found.join(n.select(F.xxhash64("p_name").alias("nid"), "p_name"), "nid").select(F.col("fuzzy_code").alias("code"), (F.col("fuzzy_code") == F.col("p_name")).alias("close"))


# --- media ----------------------------------------------------------------------------------------------------------------------------
@query("""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS sp FROM events), c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR sp IS NULL OR lag(sp) OVER w IS NULL OR sp <> lag(sp) OVER w THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c) SELECT user_id AS media, min(event_id) AS "start", max(event_id) AS "end", any_value(sp) AS speaker FROM r GROUP BY user_id, run""")
def media_caption_runs(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("media"), F.col("event_id").alias("t"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("speaker"))
    return media.caption_runs(ev).select("media", "start", "end", "speaker")


@query("""SELECT p.event_id, s.sp AS speaker FROM (SELECT event_id, user_id, ts + INTERVAL 2 SECOND AS t FROM events WHERE event_type = 'click') p ASOF JOIN (SELECT user_id, ts, max(event_type || event_id) AS sp FROM events WHERE event_type <> 'click' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.t >= s.ts""")
def media_speakers(spark, d):
    ev = table(spark, d, "events")
    seg = ev.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("media"), F.col("ts").alias("start"))
    cap = ev.filter("event_type <> 'click'").select(F.col("user_id").alias("media"), F.col("ts").alias("t"), F.concat("event_type", s(F.col("event_id"))).alias("speaker"))
    return media.speakers(seg, cap).filter("speaker is not null").select("event_id", "speaker")


@query("""WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
t AS (SELECT user_id, run, min(event_id) AS "start", string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS text FROM r GROUP BY 1, 2)
SELECT user_id AS media, "start", md5(text) AS digest, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM t""")
def media_transcript(spark, d):
    seg = table(spark, d, "events").select(F.col("user_id").alias("media"), F.col("event_id").alias("start"), F.col("event_type").alias("speaker"), s(F.col("event_id")).alias("text"))
    return media.transcript(seg).select("media", "start", F.md5("text").alias("digest"), "char_start")


@query("""SELECT a.event_id AS id, min(b.event_id) AS t0, max(b.event_id) AS t1 FROM (SELECT *, event_id * 10 AS x FROM events WHERE event_type = 'error') a JOIN (SELECT *, event_id * 10 + 300 AS x FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.x < b.x + 900 AND b.x < a.x + 2500 GROUP BY 1""")
def media_evidence_times(spark, d):
    k = F.col("event_id")
    ev = table(spark, d, "events").select(F.col("user_id").alias("media"), k.alias("id"), "event_type")
    a = ev.filter("event_type = 'error'").select("media", "id", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 2500).alias("end"))
    b = ev.filter("event_type = 'view'").select("media", (F.col("id") * 10 + 300).alias("start"), (F.col("id") * 10 + 1200).alias("end"), F.col("id").alias("t0"), F.col("id").alias("t1"))
    return media.evidence_times(a, b)
