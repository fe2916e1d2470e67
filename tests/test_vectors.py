"""Exact and indexed nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.operators import vectors


def table(spark, n=600, dim=12, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((15, dim)) * 2
    data = [(i, [float(x) for x in centres[i % 15] + rng.standard_normal(dim)]) for i in range(n)]
    data += [(n + i, data[3][1]) for i in range(copies)]
    data += [(10**9, None), (10**9 + 1, [0.0] * dim)]
    return data, spark.createDataFrame(data, "id long, vector array<double>").repartition(5)


def brute(data, asked, k):
    ids = np.array([i for i, v in data if v is not None])
    x = vectors.unit(np.array([v for _, v in data if v is not None]))
    out = {}
    for q, v in asked:
        s = np.round(x @ vectors.unit(np.array([v]))[0], 6)
        order = np.lexsort((ids, -s))[:k]
        out[q] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["similarity"], 6)))
    return out


@pytest.mark.parametrize("piece", [64 << 20, 2000])
def test_exact_neighbours_in_pieces_of_any_size(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE_BYTES", piece)
    data, df = table(spark, copies=40)
    asked = [r for r in data if r[0] % 20 == 0 and r[1] is not None][:30]
    q = df.filter("id % 20 = 0 and id < 600").withColumnRenamed("id", "query_id")
    assert found(vectors.nearest(df, q, 7)) == brute(data, asked, 7)


def test_all_lists_give_the_exact_answer_also_where_a_list_is_hot(spark, monkeypatch):
    """A third of the rows are copies; lists and queries are cut into many groups."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 6)
    data, df = table(spark, copies=300)
    asked = [r for r in data if r[0] % 20 == 0 and r[0] < 600]
    index = vectors.indexed(df, k=10)
    index.probes = len(index.centroids)
    assert index.rows.count() == len(data) - 1
    q = df.filter("id % 20 = 0 and id < 600").withColumnRenamed("id", "query_id")
    assert found(vectors.probed(index, q, 10)) == brute(data, asked, 10)


def test_probes_reach_the_recall_and_look_at_few_lists(spark):
    data, df = table(spark, 2000)
    asked = [r for r in data if r[0] % 20 == 0 and r[0] < 2000]
    index = vectors.indexed(df, k=10)
    q = df.filter("id % 20 = 0 and id < 2000").withColumnRenamed("id", "query_id")
    got, want = found(vectors.probed(index, q, 10)), brute(data, asked, 10)
    recall = np.mean([len({i for i, _ in got[k]} & {i for i, _ in want[k]}) / 10 for k in want])
    assert recall >= 0.9 and index.probes < len(index.centroids) / 2
    assert all(dict(want[k]).get(i, s) == s for k in want for i, s in got[k])


def test_index_of_nothing(spark):
    _, df = table(spark, 5)
    none = df.limit(0)
    q = df.withColumnRenamed("id", "query_id")
    assert vectors.probed(vectors.indexed(none), q, 3).count() == 0
    assert vectors.probed(vectors.indexed(df.filter("id >= 1000000000")), q, 3).select("id").distinct().count() == 1
    assert vectors.probed(vectors.indexed(df), q.limit(0), 3).count() == 0
    assert vectors.nearest(df, q.filter(F.lit(False)), 3).count() == 0
