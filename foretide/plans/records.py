"""Sources, sinks, parsers, chunkers and service tables over items that are rendered from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretide.functions import chunks, extract, parse, udfs
from foretide.operators import accounts, endpoints, governance, ingest, market, ranking, resolve, reviews
from foretide.plans.registry import registry
from foretide.plans.scalars import part_key, part_name, part_size, pick, s, sql_pick
from foretide.sources import html, minutes, procurement, readers, shared
from foretide.sources.tables import spread, table

QUERIES, ORACLE_SQL, query = registry()


def order_key() -> Column:
    return F.col("o_orderkey")


def customer_key() -> Column:
    return F.col("o_custkey")


def order_day() -> Column:
    return F.to_date("o_orderdate")


def order_price() -> Column:
    return F.col("o_totalprice")


def orders(spark, d):
    return table(spark, d, "orders")


def part(spark, d):
    return table(spark, d, "part")


# --- sources -------------------------------------------------------------------------------------------------------------
@query("""SELECT path, CAST(since AS DATE) AS since, CAST(least(since + INTERVAL 6 DAY, DATE '2026-02-03') AS DATE) AS until, CAST(i // 10 + 1 AS INTEGER) AS page, '{"n": ' || i || '}' AS item
FROM (SELECT unnest(['plans', 'bids']) AS path) p, (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-02-03', INTERVAL 7 DAY)) AS since) w, (SELECT unnest(range(0, 25)) AS i) n""")
def source_paged(spark, d):
    """The paged source: one partition for each path and week, pages until all is read."""
    readers.register(spark)
    options = {"paths": "plans,bids", "since": "2026-01-01", "until": "2026-02-03", "rows": "10", "client": "foretide.sources.world:numbered"}
    return spark.read.format("paged_records").options(**options).load()


def items(spark, d):
    """Orders as items of the provider's plan listing: numbers with commas, dates with slashes, blanks."""
    return orders(spark, d).select(
        F.concat(F.lit("P"), s(order_key())).alias("orderPlanUntyNo"), F.when(order_key() % 10 == 3, "  ").otherwise(F.col("o_orderpriority")).alias("bizNm"),
        F.when(order_key() % 10 == 4, "").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("nticeDt"), F.format_number(F.floor(order_price() / 10), 0).alias("sumOrderAmt"),
        F.when(order_key() % 2 == 0, s(customer_key())).otherwise("").alias("orderInsttNm"), F.concat(F.lit("body "), s(customer_key())).alias("dminsttNm"), s(customer_key()).alias("orderInsttCd"),
        F.concat(F.lit("R26BK"), F.lpad(s(order_key()), 8, "0"), F.lit("000, R26BK"), F.lpad(s(order_key()), 8, "0"), F.lit("001,,X1")).alias("bidNtceNoList"),
    )


@query("""SELECT 'P' || o_orderkey AS external_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS published_at, CASE WHEN floor(o_totalprice / 10) >= 10000 THEN CAST(floor(o_totalprice / 10) AS BIGINT) END AS amount_krw,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'body ' || o_custkey END AS publisher_raw, o_custkey::VARCHAR AS provider_code, 'P' || o_orderkey AS plan_no, 'R26BK' || lpad(o_orderkey::VARCHAR, 8, '0') || '|X1' AS bids
FROM orders WHERE o_orderkey % 10 NOT IN (3, 4)""")
def source_item_map(spark, d):
    m = procurement.map_items(items(spark, d), "order_plan")
    return m.select("external_id", "title", "published_at", "amount_krw", "publisher_raw", "provider_code", F.col("refs.order_plan_no").alias("plan_no"), F.array_join("refs.bid_notice_nos", "|").alias("bids"))


@query("""SELECT count(*) AS items, count(*) FILTER (WHERE ok) AS mapped, round(avg(CASE WHEN floor(o_totalprice / 10) >= 10000 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 4) AS amount_krw, 1.0::DOUBLE AS publisher_raw, 1.0::DOUBLE AS provider_code, 0.0::DOUBLE AS department
FROM (SELECT *, o_orderkey % 10 NOT IN (3, 4) AS ok FROM orders)""")
def source_health(spark, d):
    return procurement.health(items(spark, d), "order_plan")


@query("""SELECT sha256(concat_ws(chr(31), o_custkey::VARCHAR, '9', '', (o_orderkey % 2)::VARCHAR, '본회의', strftime(o_orderdate, '%Y') || '0101')) AS external_id, make_date(year(o_orderdate), 1, 1) AS day, array_to_string(list_sort(list(DISTINCT o_orderkey::VARCHAR), 'DESC'), '|') AS revisions
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_custkey, o_orderkey % 2, strftime(o_orderdate, '%Y'), year(o_orderdate)""")
def source_meetings(spark, d):
    rows = orders(spark, d).select(
        s(order_key()).alias("DOCID"), s(customer_key()).alias("RASMBLY_ID"), F.lit("9").alias("RASMBLY_NUMPR"), F.lit(None).cast("string").alias("RASMBLY_SESN"), s(order_key() % 2).alias("MINTS_ODR"),
        F.lit("본회의").alias("MTGNM"), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("0101")).alias("MTG_DE"),
    )
    m = minutes.meetings(rows, "1996-01-01", "1998-12-31", "본회의")
    return m.select("external_id", "day", F.array_join("revisions", "|").alias("revisions"))


@query("""WITH m AS (SELECT o_custkey, list_sort(list(o_orderkey::VARCHAR), 'DESC') AS r, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS external_id, CASE WHEN o_custkey % 3 = 0 THEN r[2] ELSE r[1] END AS docid, o_custkey % 3 = 0 AS revised FROM m WHERE CASE WHEN o_custkey % 3 = 0 THEN len(r) > 1 ELSE day >= DATE '1998-01-01' END""")
def source_unread_meetings(spark, d):
    """Known meetings come back with a revision that was not seen, new ones from a day on."""
    found = orders(spark, d).groupBy(s(customer_key()).alias("external_id")).agg(F.sort_array(F.collect_list(s(order_key())), asc=False).alias("revisions"), F.max(order_day()).alias("day"))
    known = found.filter(F.col("external_id").cast("long") % 3 == 0).select("external_id", F.slice("revisions", 1, 1).alias("seen"))
    return minutes.to_read(found, known, "1998-01-01").select("external_id", "docid", "revised")


_REGION, _FULL = ("서울", "경기", "제주", "없는곳"), ("서울특별시", "경기도", "제주특별자치도", "없는곳")


@query(f"SELECT p_partkey, {sql_pick('p_partkey', *_FULL)} AS sido, CASE WHEN p_size % 3 = 0 THEN {sql_pick('p_partkey', *_FULL)} ELSE p_name END AS name FROM part")
def source_region_split(spark, d):
    region = pick(part_key(), *_REGION)
    name = F.when(part_size() % 3 == 0, F.concat(region, F.lit("본청"))).when(part_size() % 3 == 1, F.concat(region, part_name())).otherwise(part_name())
    return part(spark, d).select("p_partkey", minutes.split_region(region, name).alias("r")).select("p_partkey", "r.*")


@query("""SELECT p_partkey, CAST(2020 + p_size % 9 AS INTEGER) AS fiscal_year, CASE p_partkey % 4 WHEN 0 THEN '본' WHEN 1 THEN '제2회 추가경정' WHEN 2 THEN '추가경정' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN make_date(CAST(2019 + p_size % 9 AS INTEGER), 12, 31) WHEN 3 THEN NULL ELSE make_date(CAST(2020 + p_size % 9 AS INTEGER), 12, 31) END AS adopted_by FROM part""")
def source_budget_facts(spark, d):
    t = F.concat(s(part_size() % 9 + 2020), F.lit("년도 "), pick(part_key(), "본예산서", "제2회 추경 예산", "추가경정예산", "결산"))
    return part(spark, d).select("p_partkey", minutes.budget_facts(t).alias("f")).select("p_partkey", "f.*")


_ANSWERS = {(200, "00"): "ok", (200, "INFO-200"): "ok", (429, "00"): "quota", (200, "22"): "quota", (503, "x"): "transient", (200, "04"): "transient", (403, "30"): "fatal"}


@query(f"SELECT p_partkey, {sql_pick('p_partkey', *_ANSWERS.values())} AS kind FROM part")
def source_error_kinds(spark, d):
    status = F.element_at(F.array(*[F.lit(k[0]) for k in _ANSWERS]), (part_key() % len(_ANSWERS) + 1).cast("int"))
    return part(spark, d).select("p_partkey", parse.error_kind(status, pick(part_key(), *[k[1] for k in _ANSWERS])).alias("kind"))


@query("""SELECT coalesce(CASE WHEN o_orderstatus = 'P' THEN 'unmapped' WHEN year(o_orderdate) < 1996 THEN 'fiscal_year' WHEN month(o_orderdate) > 6 THEN 'window' WHEN o_custkey % 7 = 0 THEN 'institution' END, 'kept') AS reason, count(*) AS n FROM orders GROUP BY 1""")
def source_listing_reasons(spark, d):
    rules = [("unmapped", F.col("o_orderstatus") != "P"), ("fiscal_year", F.year("o_orderdate") >= 1996), ("window", F.month("o_orderdate") <= 6), ("institution", customer_key() % 7 != 0)]
    _, counts = ingest.listing_filter(orders(spark, d), rules)
    return counts.select(F.coalesce("reason", F.lit("kept")).alias("reason"), "n")


@query("SELECT s_suppkey::VARCHAR AS code, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'gu' || s_nationkey END AS sigungu, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_aliases FROM supplier")
def source_registry_csv(spark, d):
    """Institutions written as CSV and scanned again."""
    none = F.lit(None).cast("string")
    code = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        s(code).alias("code"), F.col("s_name").alias("name"), F.lit("council").alias("kind"), F.lit("a").alias("sido"), F.when(code % 3 > 0, F.concat(F.lit("gu"), s(F.col("s_nationkey")))).otherwise("").alias("sigungu"),
        none.alias("region_code"), none.alias("executive_code"), F.when(code % 2 == 0, F.concat(F.lit("x"), s(code), F.lit("|| y"))).alias("aliases"),
    )
    path = shared.new_path(spark, "registry")
    rows.write.option("header", True).csv(path)
    return readers.registry(spark, path).select("code", "name", "sigungu", F.size("aliases").alias("n_aliases"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def sink_json_lines(spark, d):
    """Rows written as gzip JSON lines in order and scanned again."""
    path = shared.new_path(spark, "links")
    readers.write_links(orders(spark, d).select("o_orderkey", "o_orderpriority", "o_totalprice"), path, ["o_orderkey"])
    return readers.json_lines(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


@query("SELECT sha256(text) AS raw_sha256, CAST(any_value(strlen(text)) AS BIGINT) AS size, 1::BIGINT AS copies FROM documents GROUP BY 1")
def sink_blobs(spark, d):
    """Contents put twice are stored once."""
    path = shared.new_path(spark, "blobs")
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    for half in (F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 > 0):
        put = readers.put_blobs(docs.filter(half), path)
    wanted = put.select("raw_sha256").union(docs.select(F.sha2("content", 256)))
    return readers.get_blobs(spark, path, wanted).groupBy("raw_sha256").agg(F.max(F.length("content")).cast("long").alias("size"), F.count("*").alias("copies"))


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN o.doc_id IS NULL THEN 'created' WHEN o.h = n.h THEN 'skipped' ELSE 'updated' END AS action,
  CASE WHEN n.doc_id IS NULL OR o.h = n.h THEN 'done' ELSE 'pending' END AS parse_status FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def sink_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = docs.filter("doc_id % 3 <> 0").withColumn("parse_status", F.lit("done"))
    new = docs.filter("doc_id % 2 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("content_hash"))).withColumn("seq", F.lit(1))
    return ingest.upsert(old, new, ["doc_id"]).select("doc_id", "action", "parse_status")


@query("""WITH n AS (SELECT c_custkey % 20 AS org_id, c_custkey AS opportunity_id, c_acctbal AS score FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT c_custkey % 20 AS org_id, c_custkey AS opportunity_id, -1.0::DOUBLE AS score, CASE WHEN c_custkey % 4 = 0 THEN 'relevant' END AS feedback FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.org_id, o.org_id) AS org_id, coalesce(n.opportunity_id, o.opportunity_id) AS opportunity_id, coalesce(n.score, o.score) AS score, o.feedback FROM n FULL JOIN o ON n.org_id = o.org_id AND n.opportunity_id = o.opportunity_id WHERE n.score IS NOT NULL OR o.feedback IS NOT NULL""")
def sink_recommendations(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("org_id"), F.col("c_custkey").alias("opportunity_id"), F.col("c_acctbal").alias("score"))
    k = F.col("opportunity_id")
    old = c.filter(k % 2 == 0).select("org_id", "opportunity_id", F.lit(-1.0).alias("score"), F.when(k % 4 == 0, "relevant").alias("feedback"), F.lit(None).cast("timestamp").alias("feedback_at"), F.lit(None).cast("string").alias("notified_stage"))
    return ingest.replace_recommendations(old, c.filter(k % 3 != 0)).select("org_id", "opportunity_id", "score", "feedback")


@query("SELECT p_name, min(p_brand) AS brand FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1")
def sink_cache_import(spark, d):
    rows = part(spark, d).groupBy("p_name").agg(F.min("p_brand").alias("brand"))
    return ingest.insert_absent(rows.filter("p_name like 'red%'"), rows.union(rows), ["p_name"])


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'transient' ELSE 'permanent' END AS o, p_size % 6 AS a, p_size % 7 = 0 AS idle FROM part)
SELECT p_partkey, CASE WHEN idle THEN 'sent' WHEN o = 'sent' THEN 'sent' WHEN o = 'transient' AND a + 1 < 5 THEN 'pending' ELSE 'failed' END AS status, CAST(CASE WHEN idle THEN a ELSE a + 1 END AS INTEGER) AS attempts,
  CASE WHEN NOT idle AND o = 'transient' AND a + 1 < 5 THEN 5 * pow(2.0::DOUBLE, a) END AS wait_minutes, NOT idle AND o = 'permanent' AS disable, p_size % 24 >= 22 OR p_size % 24 < 8 AS quiet FROM x JOIN part USING (p_partkey)""")
def sink_delivery(spark, d):
    n = market.delivery(F.when(part_size() % 7 == 0, "sent").otherwise("pending"), (part_size() % 6).cast("int"), pick(part_key(), "sent", "transient", "permanent"))
    return part(spark, d).select("p_partkey", n.alias("n"), market.quiet(part_size() % 24).alias("quiet")).select("p_partkey", "n.*", "quiet")


# --- parsers ----------------------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, '[발주계획] ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' | 수요기관: ' || p_brand ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' | 금액: ' || format('{:,}', p_size * 1000) || '원' ELSE '' END AS line FROM part")
def parse_record_text(spark, d):
    t = procurement.record_text(F.lit("발주계획"), part_name(), F.when(part_size() % 2 == 0, F.col("p_brand")), F.lit(None).cast("string"), F.when(part_size() % 3 == 0, part_size() * 1000))
    return part(spark, d).select("p_partkey", t.alias("line"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_brand || ' ' || p_type || chr(10) || '○' || p_name || '  a & b' AS body FROM part")
def parse_html(spark, d):
    page = F.concat(F.lit("<html><head><style>p{}</style></head><nav>x</nav><div>"), part_name(), F.lit("</div><p>\n"), F.col("p_brand"), F.lit("   <i>"), F.col("p_type"), F.lit("</i></p><b>○"), part_name(), F.lit("</b>a &amp; b<script>var p;</script></html>"))
    return part(spark, d).select("p_partkey", html.html_text(page).alias("body"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'plain' END AS method, CASE p_partkey % 4 WHEN 2 THEN p_name WHEN 3 THEN p_name || ' 끝' END AS body FROM part""")
def parse_dispatch(spark, d):
    mime = pick(part_key(), "application/json", "application/pdf", "text/html; charset=utf-8", "text/plain")
    raw = F.when(part_key() % 4 == 2, F.encode(F.concat(F.lit("<p>"), part_name(), F.lit("</p>")), "UTF-8")).when(part_key() % 4 == 1, F.encode(F.lit("%PDF-"), "UTF-8")).otherwise(F.encode(F.concat(part_name(), F.lit(" 끝")), "UTF-8"))
    return part(spark, d).select("p_partkey", parse.parse_content(mime, raw).alias("p")).select("p_partkey", "p.method", F.col("p.text").alias("body"))


@query("""WITH p AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.5 END AS c, o_orderkey % 2 = 0 AS good FROM orders)
SELECT o_custkey AS document_id, round(avg(CASE WHEN good THEN 1.0 ELSE coalesce(c, 0) END), 6) AS quality, count(*) FILTER (WHERE NOT good) AS ocr_pages, count(*) AS pages FROM p GROUP BY 1""")
def parse_page_quality(spark, d):
    body = F.when(order_key() % 2 == 0, F.repeat(F.col("o_orderpriority"), 20)).when(order_key() % 4 == 1, F.lit("short")).otherwise(F.concat(F.repeat(F.lit("가"), 50), F.repeat(F.lit(""), 10)))
    pages = orders(spark, d).select(customer_key().alias("document_id"), body.alias("text"), F.when(order_key() % 3 != 0, 0.5).alias("confidence"))
    return parse.document_quality(pages).withColumn("quality", F.round("quality", 6))


_PLAIN = """cuts(doc_id, t, seq, a, b) AS (
  SELECT doc_id, t, 0, 0, CASE WHEN length(t) <= 1500 THEN length(t) WHEN strpos(reverse(substring(t, 751, 750)), chr(10)) > 0 THEN 1500 - strpos(reverse(substring(t, 751, 750)), chr(10)) ELSE 1500 END FROM x WHERE length(t) > 0
  UNION ALL SELECT doc_id, t, seq + 1, n, CASE WHEN length(t) <= n + 1500 THEN length(t) WHEN strpos(reverse(substring(t, n + 751, 750)), chr(10)) > 0 THEN n + 1500 - strpos(reverse(substring(t, n + 751, 750)), chr(10)) ELSE n + 1500 END
  FROM (SELECT doc_id, t, seq, greatest(b - 200, a + 1) AS n, b FROM cuts) WHERE b < length(t))"""


@query(f"WITH RECURSIVE x AS (SELECT doc_id, text AS t FROM documents), {_PLAIN} SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end, md5(substring(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS digest FROM cuts")
def chunk_plain_offsets(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(chunks.plain_chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.seq", "c.char_start", "c.char_end", F.md5("c.text").alias("digest"))


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS seq, CAST(k * 1000 AS INTEGER) AS char_start, CAST(least(k * 1000 + 1000, p_size * 100) AS INTEGER) AS char_end FROM part, unnest(range(0, CAST(ceil(p_size / 10) AS BIGINT))) AS t(k)""")
def chunk_line_blocks(spark, d):
    lines = F.repeat(F.concat(F.rpad("p_name", 99, "."), F.lit("\n")), part_size())
    c = part(spark, d).select("p_partkey", F.explode(chunks.block_chunks(lines)).alias("c"))
    return c.select("p_partkey", "c.seq", "c.char_start", "c.char_end")


_SAYS = ("○위원장 김한솔  개의합니다.", "○이두리 의원  정류장은 언제 고칩니까? ", "○교통과장 박세찌  내년에 고치겠습니다. ", "○도로과장 송태아  보도도 고치겠습니다. ")


@query("""SELECT p_partkey, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS nth, unnest(['위원장', '의원', '교통과장', '도로과장']) AS role, unnest(['김한솔', '이두리', '박세찌', '송태아']) AS name FROM part""")
def chunk_turns(spark, d):
    """Speeches by the SQL table function."""
    udfs.register(spark)
    minutes_text = F.concat(*[x for line in _SAYS for x in (F.lit(line), part_name(), F.lit("\n"))])
    part(spark, d).select("p_partkey", minutes_text.alias("body")).createOrReplaceTempView("turn_texts")
    rows = spark.sql("SELECT p_partkey, t.role, t.name, t.start FROM turn_texts, LATERAL turns(body) t")
    return ranking.top_k(rows, ["p_partkey"], [F.asc("start")], 10).select("p_partkey", (F.col("rank") - 1).alias("nth"), "role", "name")


@query("SELECT p_partkey, CAST(unnest([0, 1]) AS INTEGER) AS seq, unnest(['procedure', 'exchange']) AS kind, CAST(unnest([1, 3]) AS INTEGER) AS speakers, CAST(unnest([0, 17 + length(p_name)]) AS INTEGER) AS char_start FROM part")
def chunk_minutes(spark, d):
    minutes_text = F.concat(*[x for line in _SAYS for x in (F.lit(line), part_name(), F.lit("\n"))])
    c = part(spark, d).select("p_partkey", F.explode(chunks.minutes_chunks(minutes_text)).alias("c"))
    return c.select("p_partkey", "c.seq", "c.kind", F.size("c.labels").alias("speakers"), "c.char_start")


@query("""SELECT p_partkey, CAST(unnest([0, 1]) AS INTEGER) AS seq, unnest(['도로과|' || p_name || ' 설치', '교통과|' || p_name]) AS labels, unnest([2, 1])::INTEGER AS lines FROM part""")
def chunk_budget(spark, d):
    book = F.concat(F.lit("(단위: 천원)\n부서: 도로과\n"), part_name(), F.lit(" 설치 1,200 1,000 200\n ○ 2대\n합계\n부서: 교통과\n"), part_name(), F.lit(" 300 0 300\n"))
    c = part(spark, d).select("p_partkey", F.explode(chunks.budget_chunks(book)).alias("c"))
    return c.select("p_partkey", "c.seq", F.array_join("c.labels", "|").alias("labels"), F.size(F.split("c.text", "\n")).alias("lines"))


@query("SELECT doc_id, 'record' AS kind, CAST(length(text) AS INTEGER) AS char_end FROM documents")
def chunk_record(spark, d):
    return table(spark, d, "documents").select("doc_id", F.get(chunks.record_chunk(F.col("text")), F.lit(0)).alias("c")).select("doc_id", "c.kind", "c.char_end")


@query("""SELECT o_custkey AS source, o_orderkey AS char_start FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_custkey || ':' || o_orderkey), o_orderkey) <= 2""")
def chunk_excerpts(spark, d):
    blocks = orders(spark, d).select(customer_key().alias("source"), order_key().alias("char_start"), F.col("o_orderpriority").alias("text"))
    return chunks.excerpts(blocks, "URGENT|HIGH", 2).select("source", "char_start")


@query("""WITH x AS (SELECT p_partkey, p_size FROM part), w AS (SELECT p_partkey, p_size * 100.0::DOUBLE AS n, unnest(range(0, 9)) AS k FROM x)
SELECT p_partkey::VARCHAR AS media, CAST(k AS INTEGER) AS nth, k * 600.0::DOUBLE AS "start", CASE WHEN n - k * 600 > 630 THEN (k + 1) * 600.0::DOUBLE ELSE n END AS "end", CASE WHEN n - k * 600 > 630 THEN 'silence' ELSE 'end' END AS cut FROM w WHERE k = 0 OR n - (k - 1) * 600 > 630""")
def chunk_recording_windows(spark, d):
    """Recordings with a pause at every tenth minute are cut in the pauses."""
    pauses = part(spark, d).select(s(part_key()).alias("media"), (part_size() * 100.0).alias("duration"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"))
    return parse.plan_windows(pauses.select("media", "duration", (F.col("k") * 600.0 - 1).alias("start"), (F.col("k") * 600.0 + 1).alias("end"))).select("media", "nth", "start", "end", "cut")


@query("""SELECT p_partkey, '스마트쉘터 설치' AS title, 'smart_city' AS category, '교통과' AS department, p_size * 10000::BIGINT AS budget_krw, CAST(2027 AS INTEGER) AS expected_year, 'committed' AS commitment FROM part""")
def extract_minutes(spark, d):
    said = F.concat(F.lit("○이두리 의원  정류장 개선은 언제 합니까?\n○교통과장 박세찌  내년도 본예산에 스마트쉘터 설치 사업비 "), s(part_size()), F.lit("만원을 반영하겠습니다. 고맙습니다."))
    c = spread(part(spark, d)).select(part_key().alias("chunk_id"), F.lit("council_minutes").alias("doc_type"), said.alias("text"), F.lit("2026-03-01").cast("date").alias("document_date"), F.lit(None).cast("int").alias("unit"), F.lit(None).cast("int").alias("fiscal_year"))
    return extract.extract_signals(c).select(F.col("chunk_id").alias("p_partkey"), "title", "category", "department", "budget_krw", "expected_year", "commitment")


@query("""SELECT p_partkey, CAST(unnest([0, 2]) AS INTEGER) AS seq, unnest(['보행교 설치공사', '도서관 리모델링']) AS title, 'facility' AS category, unnest([p_size * 1000, 5000])::BIGINT AS budget_krw, CAST(2026 AS INTEGER) AS expected_year FROM part""")
def extract_budgets(spark, d):
    book = F.concat(F.lit("부서: 도로과\n보행교 설치공사 "), s(part_size()), F.lit(" 300,000 52,000\n기본경비 9,000 1,000 8,000\n도서관 리모델링 5 0 5\n가로등 교체 0 10,000 △10,000\n"))
    c = spread(part(spark, d)).select(part_key().alias("chunk_id"), F.lit("budget_book").alias("doc_type"), book.alias("text"), F.lit("2026-03-01").cast("date").alias("document_date"), F.lit(1000).alias("unit"), F.lit(2026).alias("fiscal_year"))
    return extract.extract_signals(c).select(F.col("chunk_id").alias("p_partkey"), "seq", "title", "category", "budget_krw", "expected_year")


# --- bodies -------------------------------------------------------------------------------------------------------------------
_REGISTRY = (
    ("A1", "수원시", "local_gov", "경기도", "수원시", ["경기수원"]), ("A2", "수원시의회", "council", "경기도", "수원시", []), ("B1", "중구", "local_gov", "서울특별시", "중구", []),
    ("B2", "중구", "local_gov", "부산광역시", "중구", []), ("C1", "경기도", "local_gov", "경기도", None, []), ("D1", "한국별빛도로교통진흥원", "public_body", None, None, []),
)
_RAW = {("수원시 교통과", None): ("A1", "exact"), ("경기 수원", None): ("A1", "exact"), ("수원시의회", None): ("A2", "exact"), ("서울특별시 중구 도로과", None): ("B1", "exact"), ("중구청 도로과", "부산광역시"): ("B2", "context"), ("중구청 도로과", None): (None, "ambiguous"), ("한국별빛도로교통진흥언", None): ("D1", "fuzzy"), ("", None): (None, "none")}


@query(f"SELECT p_partkey AS id, nullif({sql_pick('p_partkey', *[v[0] or '' for v in _RAW.values()])}, '') AS code, {sql_pick('p_partkey', *[v[1] for v in _RAW.values()])} AS method FROM part")
def resolve_names(spark, d):
    reg = spark.createDataFrame([r for r in _REGISTRY], "code string, name string, kind string, sido string, sigungu string, aliases array<string>")
    hint = F.nullif(pick(part_key(), *[k[1] or "" for k in _RAW]), F.lit(""))
    rec = part(spark, d).select(part_key().alias("id"), pick(part_key(), *[k[0] for k in _RAW]).alias("raw"), F.lit(None).cast("string").alias("code_hint"), hint.alias("sido_hint"))
    return resolve.resolve(rec, reg).select("id", "code", "method")


@query("""SELECT 'G2B-' || o_custkey AS code, arg_min('body ' || o_orderpriority, (CAST(o_orderdate AS DATE), o_orderkey)) AS name, 'public_body' AS kind FROM orders WHERE o_custkey % 5 > 0 GROUP BY o_custkey HAVING o_custkey % 2 = 0""")
def resolve_learned_providers(spark, d):
    rec = orders(spark, d).select(order_key().alias("id"), F.when(customer_key() % 5 > 0, s(customer_key())).alias("provider_code"), F.concat(F.lit("body "), F.col("o_orderpriority")).alias("raw"), order_day().alias("published_at"))
    reg = table(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.concat(F.lit("G2B-"), s(F.col("c_custkey"))).alias("code"))
    return resolve.learn_providers(rec, reg).select("code", "name", "kind")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'G2B-' || p_size WHEN p_partkey % 2 = 0 THEN 'A1' END AS code, CASE WHEN p_size % 3 = 0 THEN 'provider' WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'none' END AS method FROM part WHERE p_partkey % 7 > 0""")
def resolve_again(spark, d):
    """Unresolved records are resolved again: coded ones by their provider's body, others by name, one lookup a name."""
    reg = spark.createDataFrame([r for r in _REGISTRY], "code string, name string, kind string, sido string, sigungu string, aliases array<string>")
    rec = part(spark, d).select(
        part_key().alias("id"), F.when(part_size() % 3 == 0, F.lit("별빛본부")).when(part_key() % 2 == 0, "수원시 교통과").otherwise("없는이름입니다").alias("raw"), F.when(part_size() % 3 == 0, s(part_size())).alias("provider_code"),
        F.lit(None).cast("string").alias("sido_hint"), F.lit("2026-01-01").cast("date").alias("published_at"), F.when(part_key() % 7 == 0, "X").alias("institution"),
    )
    return resolve.reresolve(rec, reg).select("id", "code", "method")


# --- accounts -----------------------------------------------------------------------------------------------------------------
@query("""WITH l AS (SELECT o_custkey AS org_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN -5 ELSE 7 END AS delta, 'k' || o_orderkey // 2 AS k FROM orders), b AS (SELECT *, sum(delta) OVER w AS bal, row_number() OVER (PARTITION BY org_id, k ORDER BY id) > 1 AS again FROM l WINDOW w AS (PARTITION BY org_id ORDER BY id ROWS UNBOUNDED PRECEDING))
SELECT org_id, id, CAST(bal AS BIGINT) AS balance_after, again FROM b WHERE id % 11 = 0 OR bal < 0 OR again""")
def ledger_audit(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("org_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    e = orders(spark, d).select(customer_key().alias("org_id"), order_key().alias("id"), F.when(F.col("o_orderstatus") == "F", -5).otherwise(7).alias("delta"), F.concat(F.lit("k"), s(F.floor(order_key() / 2))).alias("idempotency_key"))
    e = e.withColumn("balance_after", F.sum("delta").over(w) + F.when(F.col("id") % 11 == 0, 1).otherwise(0))
    return accounts.ledger_audit(e).select("org_id", "id", "balance_after", "again")


@query("""WITH e AS (SELECT event_id // 2 AS job_id, any_value(event_type) AS meter, min(event_id) AS id FROM events GROUP BY event_id // 2, event_type)
SELECT user_id AS org_id, date_trunc('month', ts + INTERVAL 9 HOUR) AS month, event_type AS meter, CAST(sum(event_id % 10) AS BIGINT) AS quantity, count(*) AS n FROM events GROUP BY ALL""")
def usage_by_month(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("meter"), F.col("user_id").alias("org_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 10).alias("quantity"), F.lit(None).cast("double").alias("usd"))
    out = accounts.usage_by_month(e.union(e))  # each row delivered twice counts once
    return out.select("org_id", F.col("month").cast("timestamp_ntz").alias("month"), "meter", "quantity", "n")


@query("""SELECT o_orderkey AS id, ((o_orderkey * [30000, 2500][CAST(o_orderkey % 2 AS INTEGER) + 1] + o_custkey * [150000, 12500][CAST(o_orderkey % 2 AS INTEGER) + 1] + 5000) // 10000) / 1000000.0::DOUBLE AS usd FROM orders""")
def model_costs(spark, d):
    calls = orders(spark, d).select(order_key().alias("id"), pick(order_key(), "big", "small").alias("model"), order_key().alias("tin"), customer_key().alias("tout"))
    prices = spark.createDataFrame([("big", 3.0, 15.0), ("small", 0.25, 1.25)], "model string, price_in double, price_out double")
    return accounts.call_cost({"in": F.col("tin"), "out": F.col("tout")}, prices, calls).select("id", F.round(F.col("usd").cast("double"), 6).alias("usd"))


@query("""SELECT p_partkey, least(3600.0::DOUBLE, 30 * pow(2.0::DOUBLE, p_size % 12 - 1)) AS wait, CASE WHEN p_partkey % 2 = 0 THEN 'active' WHEN p_size % 5 >= 3 THEN 'ended' ELSE 'past_due' END AS status, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size % 5 + 1 END AS INTEGER) AS attempts,
  CAST(CASE WHEN p_partkey % 2 = 1 AND p_size % 5 < 3 THEN [1, 3, 7][CAST(p_size % 5 AS INTEGER) + 1] END AS INTEGER) AS wait_days FROM part""")
def renewals(spark, d):
    r = accounts.renewal(F.lit("active"), (part_size() % 5).cast("int"), pick(part_key(), "paid", "declined"))
    return part(spark, d).select("p_partkey", accounts.backoff_seconds(part_size() % 12).alias("wait"), r.alias("r")).select("p_partkey", "wait", "r.*")


@query("""WITH RECURSIVE t(id, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT o_orderkey, depth + 1 FROM t JOIN orders ON o_orderkey // 3 = id AND o_orderkey > 1)
SELECT id, CAST(depth AS INTEGER) AS depth, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'cancelled' END AS state FROM t JOIN orders ON o_orderkey = id""")
def job_tree(spark, d):
    """A job, all below it, and their states after it is cancelled."""
    jobs = orders(spark, d).select(order_key().alias("id"), F.when(order_key() > 1, F.floor(order_key() / 3)).alias("parent_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("state"))
    return accounts.cancelled(jobs, 1).select("id", "depth", "state")


@query("""WITH v AS (SELECT o_orderpriority AS queue, list_sort(list(o_totalprice) FILTER (WHERE o_orderstatus = 'F')) AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(avg((o_orderkey % 3 > 0)::INT), 6) AS retried FROM orders GROUP BY 1)
SELECT queue, done, failed, retried, v[CAST(ceil(0.95 * len(v)) AS BIGINT)] AS p95 FROM v""")
def job_statistics(spark, d):
    jobs = orders(spark, d).select(F.col("o_orderpriority").alias("queue"), F.element_at(F.create_map(*map(F.lit, ("F", "done", "P", "failed", "O", "queued"))), F.col("o_orderstatus")).alias("state"), (order_key() % 3 + 1).alias("attempts"), order_price().alias("seconds"))
    return accounts.job_statistics(jobs).withColumn("retried", F.round("retried", 6))


# --- endpoints --------------------------------------------------------------------------------------------------------------
@query("""SELECT o_custkey AS opportunity_id, CAST(min(p) AS BIGINT) AS least, CAST(max(p) AS BIGINT) AS most, CAST(arg_max(p, (o_orderdate, o_orderkey)) AS BIGINT) AS latest, count(*) AS n FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) GROUP BY 1""")
def card_budget_trajectory(spark, d):
    sig = orders(spark, d).select(customer_key().alias("opportunity_id"), F.floor(order_price()).alias("budget_krw"), F.col("o_orderdate").alias("observed_at"), order_key().alias("id"))
    return endpoints.budget_trajectory(sig)


@query("""WITH f AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:8] AS h, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS q FROM orders GROUP BY 1)
SELECT o_custkey AS opportunity_id, array_to_string(h, '|') AS history, q AS best_quote FROM f""")
def card_brief_facts(spark, d):
    sig = orders(spark, d).select(customer_key().alias("opportunity_id"), F.col("o_orderdate").alias("observed_at"), order_key().alias("id"), F.lit("x").alias("stage"), F.lit("t").alias("title"), F.col("o_orderpriority").alias("quote"), order_price().alias("quote_score"))
    return market.brief_facts(sig).select("opportunity_id", F.array_join(F.transform("history", lambda h: s(h["id"])), "|").alias("history"), "best_quote")


@query("""SELECT o_custkey AS org_id, o_orderkey AS opportunity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'relevant' WHEN o_orderkey % 2 = 0 THEN 'dismissed' END AS feedback, NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 > 0) AS visible FROM orders""")
def card_feedback(spark, d):
    """Recommendations with the latest of their feedback events, and whether the feed shows them."""
    rec = orders(spark, d).select(customer_key().alias("org_id"), order_key().alias("opportunity_id"), F.lit(None).cast("string").alias("feedback"))
    at = lambda n: F.lit(f"2026-01-0{n}").cast("timestamp")
    first = rec.filter(F.col("opportunity_id") % 2 == 0).select("org_id", "opportunity_id", F.lit("dismissed").alias("feedback"), at(1).alias("at"))
    then = rec.filter(F.col("opportunity_id") % 3 == 0).select("org_id", "opportunity_id", F.lit("relevant").alias("feedback"), at(2).alias("at"))
    out = endpoints.with_feedback(rec, then.union(first))
    return out.select("org_id", "opportunity_id", "feedback", market.visible(F.col("feedback")).alias("visible"))


@query("""SELECT s_suppkey AS source, coalesce(arg_max(l_returnflag, (l_shipdate, l_orderkey * 10 + l_linenumber)), 'never_recorded') AS last_status, s_suppkey % 5 < 3 AS healthy FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_suppkey % 4 > 0 GROUP BY s_suppkey""")
def admin_sources(spark, d):
    k = F.col("s_suppkey")
    src = table(spark, d, "supplier").select(k.alias("source"), (k % 5).alias("consecutive_failures"))
    runs = table(spark, d, "lineitem").filter("l_suppkey % 4 > 0").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("started_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return endpoints.source_status(src, runs).select("source", "last_status", "healthy")


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS pending, (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS triaged, (SELECT count(*) FROM orders) AS signals,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS accepted, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS open, (SELECT count(*) FROM part WHERE p_size < 10) AS reviews, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AND event_type = 'click') AS done_24h,
  (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AND event_type = 'error') AS failed_24h""")
def admin_overview(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("done").alias("parse_status"))
    state = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return endpoints.overview(
        docs, table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("triaged")), orders(spark, d).select(F.when(F.col("o_orderstatus") == "F", "accepted").alias("verdict")),
        table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "open").otherwise("closed").alias("status")), part(spark, d).select(F.when(part_size() < 10, "open").otherwise("done").alias("status")),
        table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("finished_at"), state.alias("state")), F.lit("2024-01-20").cast("timestamp"),
    )


@query("""SELECT o_orderkey AS review_id, o_custkey AS id, c_name AS context FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def admin_review_queue(spark, d):
    rev = orders(spark, d).select(order_key().alias("review_id"), customer_key().alias("signal_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    c = table(spark, d, "customer")
    return endpoints.review_queue(rev, c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("chunk_id")), c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("text"))).select("review_id", "id", "context")


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def admin_pending_sweep(spark, d):
    docs = orders(spark, d).select(order_key().alias("document_id"), F.col("o_orderdate").alias("published_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("parse_status"))
    return endpoints.pending_documents(docs).select("document_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderkey < 100000 ORDER BY o_orderkey DESC LIMIT 31")
def account_latest_entries(spark, d):
    return endpoints.own_page(orders(spark, d).select(customer_key().alias("org_id"), order_key().alias("id")), 7, "id", 30, 100000).select("id")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 4 = 0 AND o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 21""")
def account_root_jobs(spark, d):
    jobs = orders(spark, d).select(order_key().alias("id"), (customer_key() % 3).alias("org_id"), F.when(order_key() % 4 > 0, order_key() - 1).alias("parent_id"))
    return endpoints.root_jobs(jobs, 1, 20, 5000).select("id")


@query("SELECT s_suppkey AS code, s_name AS name FROM supplier WHERE contains(s_name, '7') OR contains('alias' || s_suppkey, '7')")
def directory(spark, d):
    k = F.col("s_suppkey")
    inst = table(spark, d, "supplier").select(k.alias("code"), F.col("s_name").alias("name"), F.lit("k").alias("kind"), F.lit("s").alias("sido"), F.lit("g").alias("sigungu"), F.array(F.concat(F.lit("alias"), s(k))).alias("aliases"))
    return endpoints.institution_directory(inst, "7").select("code", "name")


@query("""WITH x AS (SELECT event_type AS model, list_sort(list(value)) AS v, count(*) AS cases, count(*) FILTER (WHERE user_id % 10 = 0) AS errors, CAST(sum(user_id) AS BIGINT) AS input, round(quantile_cont(value, 0.5), 6) AS p50, count(*) FILTER (WHERE user_id % 20 = 0) AS a, count(*) FILTER (WHERE user_id % 20 = 10) AS b FROM events GROUP BY 1)
SELECT model, cases, errors, input, p50, v[CAST(ceil(0.95 * len(v)) AS BIGINT)] AS p95, 'quota=' || b || '|timeout=' || a AS error_counts FROM x""")
def model_comparison(spark, d):
    u = F.col("user_id")
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.when(u % 20 == 0, "timeout").when(u % 10 == 0, "quota").alias("error"), u.alias("input_tokens"), u.alias("output_tokens"), F.lit(0.0).alias("usd"), F.col("value").alias("seconds"))
    out = endpoints.model_comparison(calls)
    shown = F.array_join(F.transform("error_counts", lambda e: F.concat(e["error"], F.lit("="), s(e["n"]))), "|")
    return out.select("model", "cases", "errors", "input", F.round("p50", 6).alias("p50"), "p95", shown.alias("error_counts"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderstatus AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS b, floor(o_totalprice) AS v FROM orders WHERE o_orderkey % 4 > 0)
SELECT count(*) AS hits, round(avg((a = b)::INT), 4) AS category, round(avg((id % 3 > 0)::INT), 4) AS budget, round(count(*) / (SELECT count(*) FROM orders), 4) AS precision FROM m""")
def extraction_scores(spark, d):
    g = orders(spark, d).select(order_key().alias("gold_id"), F.col("o_orderstatus").alias("category"), F.lit("c").alias("commitment"), F.floor(order_price()).alias("budget_krw"), F.lit(2026).alias("expected_year"))
    p = g.select(F.col("gold_id").alias("pred_id"), F.when(F.col("gold_id") % 5 == 0, "X").otherwise(F.col("category")).alias("category"), "commitment", F.when(F.col("gold_id") % 3 == 0, F.col("budget_krw") * 2).otherwise(F.col("budget_krw")).alias("budget_krw"), "expected_year")
    m = g.filter("gold_id % 4 > 0").select("gold_id", F.col("gold_id").alias("pred_id"))
    return endpoints.extraction_scores(m, g, p).select("hits", "category", "budget", "precision")


@query("SELECT o_custkey, sha256(string_agg(json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus)::VARCHAR, chr(10) ORDER BY json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus)::VARCHAR)) AS digest FROM orders GROUP BY 1")
def row_digests(spark, d):
    return reviews.row_digests(orders(spark, d), ["o_custkey"], ["o_orderkey", "o_orderstatus"])


_LEVELS = ", ".join(f"l{i} AS (SELECT node // 1000 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM l{i - 1} GROUP BY 1)" for i in (1, 2))


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, line) - 1 AS rank, line FROM (SELECT l_orderkey, '{{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}}' AS line FROM lineitem)),
l0 AS (SELECT rank // 64 AS node, sha256(string_agg(sha256(line), '' ORDER BY rank)) AS digest FROM l GROUP BY 1), {_LEVELS}
SELECT (SELECT count(*) FROM lineitem) AS samples, CASE WHEN (SELECT count(*) FROM l0) = 1 THEN (SELECT min(digest) FROM l0) WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT min(digest) FROM l1) ELSE (SELECT min(digest) FROM l2) END AS root""")
def export_root(spark, d):
    """All lines of orders written in order, with the root of their digests."""
    lines = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey"))
    return reviews.export(lines, ["l_orderkey", "l_partkey", "l_linenumber"], shared.new_path(spark, "export"), leaf=64).select("samples", "root")


@query("""SELECT o_orderkey AS id, sha256('{"title":"' || o_orderpriority || '","stage":"' || o_orderstatus || '","refs":["' || o_custkey || '"]}') AS stable_key FROM orders""")
def stable_signal_keys(spark, d):
    return orders(spark, d).select(order_key().alias("id"), reviews.canonical_key(title=F.col("o_orderpriority"), stage=F.col("o_orderstatus"), refs=F.array(s(customer_key())), missing=F.lit(None).cast("string")).alias("stable_key"))


@query("""SELECT doc_id, 'a=' || doc_id || '|b=new|c=3' AS properties FROM documents""")
def json_merge(spark, d):
    a = F.create_map(F.lit("a"), s(F.col("doc_id")), F.lit("b"), F.lit("old"))
    b = F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("3"))
    m = F.array_sort(F.map_entries(ingest.merged_properties(a, b)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("properties"))


@query("""SELECT text_key, n FROM (SELECT left(p_name, 3) AS text_key, count(*) AS n FROM part GROUP BY 1) WHERE n > 1""")
def duplicate_keys(spark, d):
    return governance.duplicates_by_key(part(spark, d).select(F.substring("p_name", 1, 3).alias("text_key")), ["text_key"])


@query("""WITH e AS (SELECT o_custkey % 20 AS org, o_orderkey AS id, o_orderdate AS at_, CASE WHEN o_orderkey % 5 = 0 THEN ['free', 'pro', 'team'][CAST(o_orderkey % 3 AS INTEGER) + 1] END AS plan, o_orderkey % 5 > 0 AS used FROM orders),
p AS (SELECT *, coalesce(last_value(plan IGNORE NULLS) OVER (PARTITION BY org ORDER BY at_, used, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'free') AS now_ FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY org, date_trunc('month', at_) ORDER BY at_, id) AS nth, CASE now_ WHEN 'free' THEN 3 WHEN 'pro' THEN 40 ELSE 150 END AS credits FROM p WHERE used)
SELECT org AS org_id, id, now_ AS plan, CAST(credits AS INTEGER) AS credits, CAST(nth AS INTEGER) AS nth, nth <= credits AS allowed FROM u""")
def plan_limits(spark, d):
    """Uses of twenty organisations against the plan in force, which a fifth of the orders change."""
    k = order_key()
    o = orders(spark, d).select((customer_key() % 20).alias("org_id"), k.alias("id"), F.col("o_orderdate").alias("at"), pick(k, "free", "pro", "team").alias("plan"))
    return accounts.within_limits(o.filter("id % 5 = 0"), o.filter("id % 5 > 0"))

