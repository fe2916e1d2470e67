"""Exact search in pieces: what is ranked, and search inside groups."""

import numpy as np
from pyspark.sql import functions as F

from foretide.operators import vectors


def test_only_what_can_be_among_the_best_is_ranked(monkeypatch):
    rng = np.random.default_rng(5)
    s, ids, k = np.round(rng.random((50, 20_000)), 4), rng.permutation(20_000), 30
    sorted_, real = [], np.lexsort
    monkeypatch.setattr(vectors.np, "lexsort", lambda keys, **more: sorted_.append(len(keys[0])) or real(keys, **more))
    best = vectors.Best(50, k, 3)
    for at in range(0, 20_000, 500):
        best.add(s[:, at : at + 500], ids[at : at + 500])
    q, i, x = best.rows()
    assert sum(sorted_) < 0.1 * s.size
    for n in range(50):
        want = sorted(zip(-np.round(s[n], 3), ids, strict=True))[:k]
        assert [(-b, a) for a, b in zip(i[q == n], x[q == n], strict=True)] == want


def test_search_inside_groups_looks_at_every_row_of_them(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    rows = spark.range(300).select("id", F.array(*[F.sin(F.col("id") * c) for c in (1.1, 2.3, 3.7)]).alias("vector"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")).alias("g"))
    got = vectors.within(rows, rows.filter("id % 7 = 0").withColumnRenamed("id", "query_id"), "g", 5).collect()
    every = [(r["id"], np.array(r["vector"]), r["g"]) for r in rows.collect()]
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for i, v, g in every:
        want = sorted((-cos(v, w), j) for j, w, h in every if g is not None and g == h)[:5] if i % 7 == 0 else []
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == [j for _, j in want]
