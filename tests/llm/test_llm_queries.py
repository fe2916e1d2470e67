"""The registered queries on the small tables, their SQL, and the pipeline."""

import pytest
from oracle import check

import corpus_pipeline
from foretide.llm import queries
from foretide.llm.common import stored


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert check(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_the_pipeline_ends_with_each_source_near_its_target(spark):
    """Words of each source in run()'s own rows against the targets of what the mixing stage was given; every row is one of
    its documents, none more than three times, and shards differ by one row at most."""
    from collections import Counter

    from pyspark.sql import functions as F

    from foretide.llm import mixing
    from foretide.llm.common import n_words

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, sf), name)
    own = docs.withColumn("words", n_words(F.col("text")))
    sized = own.groupBy("source").agg(F.sum("words").alias("source_size"))
    target = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    biggest = own.agg(F.max("words")).first()[0]
    out = stored(corpus_pipeline.run(spark, sf), "result")
    got = {r["source"]: r["w"] for r in out.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("w")).collect()}
    assert set(got) <= set(target) and all(abs(got.get(k, 0) - t) <= max(0.02 * t, min(biggest, 200)) for k, t in target.items()), (got, target)
    assert out.select(docs.columns).distinct().join(docs, "doc_id", "left_anti").isEmpty()
    assert max(Counter(r["doc_id"] for r in out.select("doc_id").collect()).values()) <= 3
    rows = Counter(r["shard"] for r in out.select("shard").collect())
    assert len(rows) == 8 and max(rows.values()) - min(rows.values()) <= 1 and out.select("shard", "slot").distinct().count() == sum(rows.values())


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), name)
        if name in ("quality", "near_copies", "decontamination"):
            assert out.columns == columns and 0 < out.count() <= seen
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs, seen = out, out.count()
    assert docs.columns == [*columns, "shard", "slot"]
    assert docs.select("shard", "slot").distinct().count() == seen and docs.filter("text is not null").count() > 0
    assert corpus_pipeline.run(spark, sf).count() == seen


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path, kind):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and tables without rows."""
    from llm.helpers import frame, rows

    data = rows(60) if kind == "awkward" else []
    sf = str(tmp_path)
    frame(spark, data).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(i % 11 != 0), 0) for i in range(60)] if data else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    items = [(1, data[5][1]), (2, None), (None, "")] if data else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] if data else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), name)
        if name != "sharding":
            assert out.columns == columns
        assert bool(out.count()) == bool(data)
        docs = out
    for name in queries.QUERIES:
        if name not in ("op7_decontamination", "op11_lexical_search", "op13_whitening"):
            n = queries.QUERIES[name](spark, sf).count()
            assert n == len(data), name
    assert queries.QUERIES["op11_lexical_search"](spark, sf).count() == (10 if data else 0)
    assert queries.QUERIES["op13_whitening"](spark, sf).count() == 2 * len(vectors)
