"""What queries cost in plans: how often an expression is worked out, over how many tasks rows are spread."""

import pytest
from pyspark.sql import functions as F

from foretide.constants import SYNONYMS
from foretide.functions import text, udfs
from foretide.operators import governance, partition
from foretide.plans import catalog, domain
from foretide.sources import shared

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_synonyms_are_looked_up_once_a_title(spark):
    variants = sum(len(g) - 1 for g in SYNONYMS)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    two = spark.createDataFrame([("스마트 쉘터 설치", "AI 상담 구매"), ("text", None)], "a string, b string")
    # A plan shows a function of an array twice.
    assert plan(two.select(text.canonical_terms(F.col("a")))).count("regexp_replace(") <= 2 * variants
    got = two.select(text.canonicalize(F.col("a")).alias("c"), text.canonicalize(F.col("b")).alias("d"), text.terms_conflict(F.col("a"), F.col("b")).alias("x")).collect()
    assert tuple(got[0]) == ("스마트쉘터 설치", "챗봇 구매", True) and tuple(got[1])[:2] == ("text", None)


def test_costly_rows_of_a_small_file_are_spread(spark):
    for name in ("text_conflicts", "text_title_similarity", "extract_budgets", "extract_minutes"):
        assert "Repartition" in plan(catalog.QUERIES[name](spark, SMALL)), name


def test_chunks_are_not_read_twice_to_see_whether_they_say_anything(spark):
    for name in ("extract_budgets", "extract_minutes"):
        below = [x for x in plan(catalog.QUERIES[name](spark, SMALL)).split("\n") if "Filter" in x]
        assert not any("size(" in x for x in below), (name, below)


def test_opportunities_are_not_broadcast_for_their_candidates(spark):
    # Profiles come from rows of no known size, opportunities from a small file that holds many words.
    shown = catalog.QUERIES["market_candidates"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    sides = [x for x in shown.split("\n") if "HashJoin" in x and "Inner" in x]
    assert len(sides) == 3 and all("BuildRight" in x for x in sides), sides


def test_a_snapshot_is_whole_at_any_size(spark):
    none = F.lit(None).cast("string")
    o = spark.range(1).select(F.col("id").alias("opportunity_id"), F.lit("I").alias("institution"), *[none.alias(c) for c in ("stage", "status", "bid_window_start", "bid_window_end", "conversion_prob")])
    m = spark.range(100_001).select("id", F.lit(0).cast("long").alias("opportunity_id"), none.alias("stage"), none.alias("observed_at"), F.col("id").alias("document_id"))
    docs = spark.range(5).select(F.col("id").alias("document_id"), none.alias("published_at"))
    assert governance.forecast_snapshot(o, m, docs, "I").count() == 100_001 + 5 + 1
    with pytest.raises(ValueError):
        governance.forecast_snapshot(o, m, docs, "I", cap=100_000)


def test_equal_features_of_a_text_are_hashed_once(monkeypatch):
    made = []
    real = udfs.hashlib.blake2b
    monkeypatch.setattr(udfs.hashlib, "blake2b", lambda *a, **k: made.append(1) or real(*a, **k))
    v = udfs.embed_text("qxzj " * 500)
    assert len(made) <= 8 and abs(float((v * v).sum()) - 1) < 1e-12


def test_rounds_of_linking_carry_numbers_not_keys(spark):
    s = partition.prepared(domain.projects(spark, SMALL)).select("at", "key", "id", "o").collect()
    assert all(set(r["o"].asDict()) == {"phase", "nth"} for r in s)
    by = lambda r: (r["at"], r["key"], r["id"])
    assert sorted(s, key=by) == sorted(s, key=lambda r: r["o"]["nth"])


def test_a_table_of_a_round_replaces_the_one_before(spark):
    path = shared.new_path(spark, "round")
    shared.stored(spark.range(100), "round", path)
    assert shared.stored(spark.range(3), "round", path).count() == 3 and spark.read.parquet(path).count() == 3
