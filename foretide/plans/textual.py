"""Text functions, lexicon scores and vectors over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions import money, scores, text, timing
from foretide.operators import vectors
from foretide.plans.registry import registry
from foretide.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


_GRAMS = """CASE WHEN length(t) < {n} THEN [] ELSE list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n})) END"""


@query(f"""
WITH p AS (SELECT DISTINCT p_name, regexp_replace(p_name, '\\s+', '', 'g') AS t FROM part)
SELECT p_name, array_to_string({_GRAMS.format(n=2)}, '|') AS bigrams, CAST(len({_GRAMS.format(n=3)}) AS BIGINT) AS n_trigrams FROM p""")
def text_char_ngrams(spark, d):
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", F.array_join(text.char_ngrams(F.col("p_name"), 2), "|").alias("bigrams"), F.size(text.char_ngrams(F.col("p_name"), 3)).cast("long").alias("n_trigrams"))


@query(f"""
WITH p AS (SELECT DISTINCT p_name, regexp_replace(p_name, '\\s+', '', 'g') AS t FROM part), g AS (SELECT p_name, list_distinct({_GRAMS.format(n=2)}) AS g FROM p),
x AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) AS i, len(list_distinct(list_concat(a.g, b.g))) AS u FROM g a JOIN g b ON a.p_name < b.p_name)
SELECT a, b, round(i / u, 6) AS similarity FROM x WHERE i > 0""")
def text_title_similarity_pairs(spark, d):
    """Bigram Jaccard of all titles that share a bigram: joined on the bigrams, whose number in common is counted."""
    p = table(spark, d, "part").select("p_name").distinct()
    g = p.select("p_name", F.array_distinct(text.char_ngrams(F.col("p_name"), 2)).alias("g")).select("p_name", F.size("g").alias("n"), F.explode("g").alias("k"))
    a, b = (g.select(F.col("p_name").alias(c), F.col("n").alias(f"n{c}"), "k") for c in ("a", "b"))
    both = a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select("a", "b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("similarity"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([a-z]+)', 1), lambda x: length(x) >= 3) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM t""")
def text_tokens(spark, d):
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda x: F.length(x) >= 3)
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus)) AS dedupe_key FROM orders""")
def text_stable_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.stable_key(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("dedupe_key"))


_LEX = {"nature": ("that", "there", "here"), "body": ("hand", "head"), "action": ("ing", "tion", "er")}


def _vote_sql() -> str:
    score = lambda ws: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {(0.3 if w == 'er' else 1.0) * (1 + len(w) / 4)} ELSE 0.0::DOUBLE END" for w in ws)
    cols = ", ".join(f"({score(ws)})::DOUBLE AS {k}" for k, ws in _LEX.items())
    best = "greatest(" + ", ".join(_LEX) + ")"
    name = "CASE " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in _LEX) + " END"
    return f"""WITH s AS (SELECT doc_id, {cols} FROM documents)
SELECT doc_id, CASE WHEN {best} > 0 THEN {name} ELSE 'other' END AS category, CASE WHEN {best} > 0 THEN round({best} / ({' + '.join(_LEX)}), 3) ELSE 0 END AS confidence FROM s"""


@query(_vote_sql())
def score_category_vote(spark, d):
    v = scores.vote(F.col("text"), _LEX, ("er",))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.category", "v.confidence")


@query("""
WITH f AS (SELECT doc_id, least(contains(text, 'ing')::INT + contains(text, 'tion')::INT + contains(text, 'ment')::INT, 2) AS verbs,
  regexp_matches(text, '[0-9]{3,}')::INT AS amount, least(contains(text, '!!')::INT + contains(text, '$$')::INT, 2) AS noise FROM documents)
SELECT doc_id, round(1 / (1 + exp(-(-1.2 + 0.55 * verbs + 1.1 * amount - 0.9 * noise))), 4) AS score FROM f""")
def score_triage_logistic(spark, d):
    c = F.col("text")
    z = -1.2 + 0.55 * text.count_words(c, ("ing", "tion", "ment"), 2) + 1.1 * c.rlike("[0-9]{3,}").cast("int") - 0.9 * text.count_words(c, ("!!", "$$"), 2)
    return table(spark, d, "documents").select("doc_id", F.round(1 / (1 + F.exp(-z)), 4).alias("score"))


@query("""
SELECT count(*) FILTER (WHERE quality = 1 AND f = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND f = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND f <> 1) AS fn,
  round(count(*) FILTER (WHERE quality = 1 AND f = 1) / count(*) FILTER (WHERE f = 1), 6) AS precision, round(count(*) FILTER (WHERE quality = 1 AND f = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall
FROM (SELECT quality, (NOT contains(text, '!!'))::INT AS f FROM labels JOIN documents USING (doc_id))""")
def score_precision_recall(spark, d):
    from foretide.operators.evaluation import binary_scores

    docs = table(spark, d, "documents").select("doc_id", (~F.contains(F.col("text"), F.lit("!!"))).cast("int").alias("f"))
    return binary_scores(table(spark, d, "labels").join(docs, "doc_id"), "quality", "f")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= 20""")
def vector_top_k(spark, d):
    """Each twentieth vector's twenty nearest of all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = vectors.nearest(e, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 20)
    return out.select("query_id", F.col("id").alias("vec_id"), "similarity")


@query("""
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)
SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity, row_number() OVER w AS rank FROM embeddings JOIN q USING (label)
WINDOW w AS (PARTITION BY label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def vector_top_k_per_group(spark, d):
    from foretide.operators.ranking import top_k

    e = table(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    s = e.join(q, "label").select("label", "vec_id", F.round(scores.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return top_k(s, ["label"], [F.desc("similarity"), F.asc("vec_id")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS q, label AS own FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, label, own, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS c FROM embeddings, q),
t AS (SELECT qid, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) <= 30), g AS (SELECT qid, vec_id FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) <= 30)
SELECT round((SELECT count(*) FROM t JOIN g USING (qid, vec_id)) / (SELECT count(*) FROM t), 6) AS recall""")
def vector_recall(spark, d):
    """Share of each twentieth vector's thirty nearest that a search within its own label finds."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    truth = vectors.nearest(rows, rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 30).select("query_id", "id")
    labelled = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    got = vectors.within(labelled, labelled.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), "label", 30).select("query_id", "id", F.lit(1).alias("hit"))
    return truth.join(got, ["query_id", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def _indexed(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, vectors.indexed(e)


@query()
def vector_index_top_k(spark, d):
    """Each twentieth vector's thirty nearest among the inverted lists that it looks at."""
    e, index = _indexed(spark, d)
    out = vectors.probed(index, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 30)
    return out.select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


@query("SELECT count(*) AS queries, 30 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, d):
    """Of each twentieth vector's thirty nearest, the index finds nine tenths or more."""
    e, index = _indexed(spark, d)
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = vectors.probed(index, q, 30).select("query_id", "id", F.lit(1).alias("hit"))
    truth = vectors.nearest(e, q, 30).select("query_id", "id").join(got, ["query_id", "id"], "left")
    return truth.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN '0원' ELSE concat_ws(' ', CASE WHEN v // 100000000 > 0 THEN format('{:,}', v // 100000000) || '억' END,
  CASE WHEN v % 100000000 // 10000 > 0 THEN format('{:,}', v % 100000000 // 10000) || '만' END, CASE WHEN v // 100000000 = 0 AND v % 10000 > 0 THEN format('{:,}', v % 10000) END) || '원' END AS shown
FROM (SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice * 1000) AS BIGINT) AS v FROM orders)""")
def money_format(spark, d):
    v = F.floor(F.col("o_totalprice") * 1000).cast("long")
    return table(spark, d, "orders").select("o_orderkey", money.format_krw(v).alias("shown"))


@query("""
SELECT o_orderkey, l_linenumber, (a = b OR (a > 0 AND b > 0 AND abs(a - b) / greatest(a, b) <= 0.01)) AS agree, round(CASE WHEN a = 0 OR b = 0 THEN 0.5 ELSE greatest(0, 1 - abs(ln(a / b)) / ln(3)) END, 6) AS similarity
FROM (SELECT o_orderkey, l_linenumber, o_totalprice AS a, l_extendedprice AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""")
def money_agreement(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    x = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_totalprice"), F.col("l_extendedprice")
    return x.select("o_orderkey", "l_linenumber", money.amounts_agree(a, b).alias("agree"), F.round(scores.budget_similarity(a, b), 6).alias("similarity"))


_WINDOW = """CASE WHEN o_orderstatus = 'F' THEN MAKE_DATE(y, 1, 1) WHEN o_orderstatus = 'O' THEN MAKE_DATE(y, 7, 1) ELSE MAKE_DATE(y, 1, 15) END"""


@query(f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) + (o_orderkey % 2) AS INTEGER) AS y FROM orders),
w AS (SELECT *, {_WINDOW} AS a, CASE WHEN o_orderstatus = 'F' THEN MAKE_DATE(y, 6, 30) WHEN o_orderstatus = 'O' THEN MAKE_DATE(y, 12, 31) ELSE MAKE_DATE(y, 11, 30) END AS b FROM x)
SELECT o_orderkey, CASE WHEN b >= d THEN greatest(a, d) ELSE d + 60 END AS window_start, CASE WHEN b >= d THEN b ELSE d + 300 END AS window_end FROM w""")
def timing_forecast_window(spark, d):
    o = table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))
    half = F.when(F.col("o_orderstatus") == "F", "H1").when(F.col("o_orderstatus") == "O", "H2")
    w = timing.forecast_window(F.lit("budget_line"), F.col("d"), (F.year("d") + F.col("o_orderkey") % 2).cast("int"), half)
    return o.select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query("""
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) AS b, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 5 END AS p, DATE '1996-06-01' AS today FROM orders)
SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN p WHEN b < today THEN a ELSE greatest(a, today) END AS left_from, coalesce(p, b) AS left_to, (p IS NULL AND b < today) AS passed FROM x""")
def timing_remaining_window(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.to_date("o_orderdate")).withColumn("b", F.expr("date_add(a, cast(o_orderkey % 200 as int))"))
    p = F.when(F.col("o_orderstatus") == "P", F.date_add("a", 5))
    w = timing.remaining_window(F.col("a"), F.col("b"), F.lit("1996-06-01").cast("date"), p)
    return o.select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("left_from"), F.col("w.end").alias("left_to"), "w.passed")


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'bid_open' ELSE 'open' END AS s, CAST(o_orderdate AS DATE) AS a, DATE '1996-01-01' AS t FROM orders),
y AS (SELECT *, date_diff('day', t, greatest(a, t)) AS n, a + 30 < t AS passed FROM x)
SELECT o_orderkey, round(CASE WHEN s = 'bid_open' THEN 0.6 WHEN s = 'closed' THEN 0 WHEN passed THEN 0.35 WHEN n = 0 THEN 0.75 WHEN n <= 60 THEN 0.7 + 0.3 * n / 60 WHEN n <= 270 THEN 1 ELSE greatest(0.35, 1 - (n - 270) / 400) END, 6) AS value FROM y""")
def score_lead_time(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.to_date("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "bid_open").otherwise("open")
    v = scores.lead_time_value(status, F.col("a"), F.date_add("a", 30), F.lit("1996-01-01").cast("date"))
    return o.select("o_orderkey", F.round(v, 6).alias("value"))


@query("""
SELECT o_orderkey, round(CASE WHEN o_totalprice BETWEEN 50000 AND 200000 THEN 1 ELSE greatest(0, 1 - abs(ln(o_totalprice / CASE WHEN o_totalprice < 50000 THEN 50000 ELSE 200000 END)) / ln(4)) END, 6) AS fit FROM orders""")
def score_budget_fit(spark, d):
    fit = scores.budget_fit(F.col("o_totalprice"), F.lit(50000.0), F.lit(200000.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(fit, 6).alias("fit"))


@query("""
SELECT doc_id, seq, char_start, least(char_start + 1500, n) AS char_end, md5(substring(text, CAST(char_start + 1 AS BIGINT), 1500)) AS chunk_md5
FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(CAST(ceil((length(text) - 200) / 1300) AS BIGINT), 1))) AS seq FROM documents) t, LATERAL (SELECT seq * 1300 AS char_start)""")
def chunk_fixed_size(spark, d):
    """Overlapping windows of 1,500 characters every 1,300, with code-point offsets."""
    n = F.greatest(F.ceil((F.length("text") - 200) / 1300), F.lit(1))
    x = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("seq"))
    x = x.withColumn("char_start", F.col("seq") * 1300)
    piece = F.substring(F.col("text"), (F.col("char_start") + 1).cast("int"), F.lit(1500))
    return x.select("doc_id", "seq", "char_start", F.least(F.col("char_start") + 1500, F.length("text")).alias("char_end"), F.md5(piece).alias("chunk_md5"))


@query("""
WITH b AS (SELECT doc_id, source, sha256(source || ':' || doc_id) AS h FROM documents WHERE n_chars > 500)
SELECT source, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) <= 3""")
def sample_by_hash(spark, d):
    from foretide.operators.ranking import top_k

    h = F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256)
    b = table(spark, d, "documents").filter("n_chars > 500").select("doc_id", "source", h.alias("h"))
    return top_k(b, ["source"], [F.asc("h")], 3).select("source", "doc_id")


@query()
def html_to_text(spark, d):
    from foretide.sources.html import html_text

    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS site, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles FROM pages),
l AS (SELECT page_id, site, unnest(hrefs) AS href, unnest(titles) AS title, unnest(range(len(hrefs))) AS at_ FROM a)
SELECT page_id, site || href AS url, arg_max(trim(regexp_replace(title, '\\s+', ' ', 'g')), at_) AS title FROM l GROUP BY page_id, site || href""")
def html_links(spark, d):
    from foretide.sources.html import links

    return links(table(spark, d, "pages"))


@query()
def chunk_plain(spark, d):
    from foretide.functions.chunks import plain_chunks

    return table(spark, d, "documents").select("doc_id", F.explode(plain_chunks(F.col("text"))).alias("c")).select("doc_id", "c.*")


_RULES = (("/t", False), ("/th", True), ("/than", False), ("/e", False), ("/d", False), ("/de", True))


@query(f"""WITH h AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT DISTINCT page_id, scheme || '://' || host || href AS url, href AS path FROM h),
r AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {a})" for p, a in _RULES)}) v(prefix, allow)),
b AS (SELECT page_id, url, arg_max(allow, length(prefix)) AS allow FROM l JOIN r ON starts_with(path, prefix) GROUP BY ALL)
SELECT page_id, url, CASE WHEN NOT coalesce(b.allow, true) THEN 'robots' WHEN l.url NOT IN (SELECT url FROM pages) THEN 'absent' END AS reason FROM l LEFT JOIN b USING (page_id, url)""")
def crawl_reasons(spark, d):
    """Every link of every page, with why it is not followed: the rules of its host, or no such page."""
    from foretide.operators import crawl
    from foretide.sources import html

    pages = table(spark, d, "pages")
    rules = pages.select(crawl.host_of(F.col("url")).alias("host")).distinct()
    rules = rules.select("host", F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in _RULES])).alias("r")).select("host", "r.*")
    return crawl.judged(html.links(pages).select("page_id", "url"), rules, pages.select("url"))
