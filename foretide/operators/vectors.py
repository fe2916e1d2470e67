"""Nearest neighbours by cosine of a stated set of query vectors: exact, against all rows in blocks of queries, or by a
partitioned index that looks at some inverted lists only, as many as a measured recall asks for.

Defined cases: null vectors are nobody's neighbours and ask for none; vectors without length have similarity 0; ids are
whole numbers, ties go to the smaller one; repeated rows are neighbours of their own."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.operators.ranking import top_k
from foretide.sources.shared import stored

#: Bytes of query vectors that are broadcast at a time; each block is one pass over the rows. Bytes of similarities that a
#: task holds at a time: rows of a batch are taken in pieces.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 64 << 20
#: Index: rows that centroids are trained on for each list, most lists, rows and queries of a task's group, the recall that
#: the number of probed lists has to reach, on so many queries.
TRAINING, MOST_LISTS, LIST_ROWS, QUERY_ROWS, RECALL, MEASURED = 64, 4096, 50_000, 2_000, 0.95, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of length 0 stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


class Best:
    """The ``k`` best (similarity, id) of each of ``n`` queries among the pieces seen so far. Of a piece only what reaches a
    query's k-th best is kept at all; it is ranked once there is as much of it as of what it is ranked with."""

    def __init__(self, n: int, k: int, digits: int | None):
        self.k, self.digits, self.margin = k, digits, 0.0 if digits is None else 10.0**-digits
        self.least = np.full(n, -np.inf)
        self.held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        self.new, self.count = [], 0

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """Similarities of all queries (rows) with the rows ``ids``."""
        least = self.least
        if s.shape[1] > self.k and not len(self.held[0]) and not self.new:
            least = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1] - self.margin
        q, at = np.nonzero(s >= least[:, None])
        found = s[q, at]
        self.new.append((q, ids[at], found if self.digits is None else np.round(found, self.digits)))
        self.count += len(q)
        if self.count >= max(len(self.held[0]), self.k * len(self.least)):
            self.rank()

    def rank(self) -> None:
        q, ids, s = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -s, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        kept = np.arange(len(q)) - first[q] < self.k
        self.held = (q[kept], ids[order][kept], s[order][kept])
        self.new, self.count = [], 0
        last = first + self.k - 1
        full = np.bincount(q, minlength=len(self.least)) >= self.k
        self.least[full] = s[order][last[full]] - self.margin

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, similarity)."""
        if self.new:
            self.rank()
        return self.held


def blocks(queries: DataFrame):
    """(ids, unit vectors) of the queries (query_id, vector), block by block; only their number and width are asked for
    first, and a block is about BLOCK_BYTES at most."""
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = max(1, -(-n * max(width, 1) * 8 // BLOCK_BYTES))
    for b in range(parts if n else 0):
        own = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)
        got = own.select("query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector")).collect()
        if got:
            yield [r["query_id"] for r in got], unit(np.array([r["vector"] for r in got], dtype=np.float64))


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """(query_id, id, similarity, rank): for each query (query_id, vector) the ``k`` rows (id, vector) of greatest cosine,
    rounded to ``digits``, ties to the smaller id. Every row meets every query; a task keeps k rows a query, which is all
    that is shuffled. Null vectors are nobody's neighbours."""
    import pyarrow as pa

    spark = rows.sparkSession
    own = rows.filter("vector is not null").select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    found = None

    def scan(shared):
        def run(batches):
            ids, vectors = shared.value
            best = Best(len(ids), k, digits)
            for b in batches:
                if not b.num_rows:
                    continue
                flat = unit(matrix(b.column("vector")))
                own = b.column("id").to_numpy()
                step = max(1, PIECE_BYTES // (8 * len(ids)))
                for at in range(0, len(flat), step):
                    best.add(vectors @ flat[at : at + step].T, own[at : at + step])
            q, i, s = best.rows()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(i), pa.array(s)], names=["query_id", "id", "similarity"])

        return run

    for block in blocks(queries.filter("vector is not null")):
        part = own.mapInArrow(scan(spark.sparkContext.broadcast(block)), kinds)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"{kinds}, rank int")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


# --- index --------------------------------------------------------------------------------------------------------
@dataclass
class Index:
    """Inverted lists: ``rows`` (id, vector, list) of every row, stored by list; unit centroids; how many lists a query
    looks at."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def _doubles(df: DataFrame, *names) -> DataFrame:
    return df.filter("vector is not null").select(*names, F.transform("vector", lambda v: v.cast("double")).alias("vector"))


def centroids(rows: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of at most ``lists`` lists: k-means by cosine on about TRAINING rows a list, chosen by their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    long = rows.filter(F.exists("vector", lambda v: v != 0))
    share = min(1.0, lists * TRAINING / max(long.count(), 1))
    sample = stored(long.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).select(array_to_vector("vector").alias("features")), "training")
    if sample.isEmpty():
        return np.zeros((0, 0))
    found = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
    return unit(np.array(found.clusterCenters()))


def _ordered(df: DataFrame, c: np.ndarray, most: int, name: str) -> DataFrame:
    """``df`` with the numbers of the ``most`` nearest centroids of ``vector``, nearest first."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(c)  # MOST_LISTS centroids at most

    def near(batches):
        for b in batches:
            if b.num_rows:
                x, step, out = unit(matrix(b.column("vector"))), max(1, PIECE_BYTES // (8 * len(c))), []
                for at in range(0, len(x), step):
                    out.append(np.argsort(-(x[at : at + step] @ shared.value.T), axis=1, kind="stable")[:, :most].astype(np.int32))
                got = np.concatenate(out)
                lists = pa.ListArray.from_arrays(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, name])

    return df.mapInArrow(near, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def indexed(rows: DataFrame, k: int = 30, recall: float = RECALL, lists: int | None = None) -> Index:
    """The index of all ``rows`` (id, vector), about one list for the root of their number. The number of lists to probe
    is the least with a mean recall of ``recall`` on about MEASURED rows as queries, against their exact ``k`` nearest."""
    own = stored(_doubles(rows, "id"), "vectors")
    n = own.count()
    c = centroids(own, lists or min(MOST_LISTS, max(2, math.isqrt(n)))) if n else np.zeros((0, 0))
    if not len(c):
        return Index(own.withColumn("list", F.lit(0)), np.zeros((1, 1)), 1)
    listed = _ordered(own, c, 1, "l").select("id", "vector", F.get("l", 0).alias("list"))
    listed = stored(listed.repartitionByRange(F.col("list"), F.xxhash64("id")).sortWithinPartitions("list"), "lists")
    asked = own.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < min(1.0, MEASURED / n) * 1_000_000).withColumnRenamed("id", "query_id")
    truth = nearest(own, asked, k).select("query_id", "id").join(listed.select("id", "list"), "id")
    order = _ordered(asked, c, len(c), "near").select("query_id", F.posexplode("near").alias("place", "list"))
    found = truth.join(order, ["query_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).collect()  # one row a list at most
    hits = np.zeros(len(c))
    for r in found:
        hits[r["place"]] = r["n"]
    share = np.cumsum(hits) / max(hits.sum(), 1)
    return Index(listed, c, int(np.searchsorted(share, recall - 1e-12) + 1) if hits.sum() else len(c))


def probed(index: Index, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` best rows of the lists that each query (query_id, vector) looks at, their
    similarities exact."""
    queries = _doubles(queries, "query_id")
    if index.centroids.shape[1] > 1 or len(index.centroids) > 1:
        asked = _ordered(queries, index.centroids, index.probes, "l").select("query_id", "vector", F.explode("l").alias("list"))
    else:
        asked = queries.withColumn("list", F.lit(0))
    return _met(index.rows, stored(asked, "probes"), k, digits)


def within(rows: DataFrame, queries: DataFrame, group: str, k: int, digits: int | None = 6) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` rows (id, vector, ``group``) of greatest cosine of each query (query_id,
    vector, ``group``) among those of its own group; every row of the group is looked at."""
    own, asked = (_doubles(df, n, F.col(group).alias("list")) for df, n in ((rows, "id"), (queries, "query_id")))
    return _met(own.filter("list is not null"), asked.filter("list is not null"), k, digits)


def _met(listed: DataFrame, asked: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The ``k`` best rows (list, id, vector) of each query (list, query_id, vector) in its lists. A list meets its queries in
    groups of LIST_ROWS rows and QUERY_ROWS queries, so a list with a third of all rows is many tasks' work, and no row is left
    out."""
    import pyarrow as pa

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {listed.schema['id'].dataType.simpleString()}, similarity double"
    parts = lambda df, name, most: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    plan = F.broadcast(parts(listed, "parts", LIST_ROWS).join(parts(asked, "turns", QUERY_ROWS), "list"))  # one row a list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows = listed.join(plan, "list").select("list", own("id", "parts").alias("part"), spread("turns").alias("turn"), "id", "vector")
    asked = asked.join(plan, "list").select("list", spread("parts").alias("part"), own("query_id", "turns").alias("turn"), "query_id", "vector")

    def meet(left, right):
        ids, q = left.column("id").to_numpy(), unit(matrix(right.column("vector").combine_chunks())) if right.num_rows else np.zeros((0, 1))
        best = Best(len(q), k, digits)
        if len(q) and len(ids):
            x, step = unit(matrix(left.column("vector").combine_chunks())), max(1, PIECE_BYTES // (8 * len(q)))
            for at in range(0, len(ids), step):
                best.add(q @ x[at : at + step].T, ids[at : at + step])
        of, i, s = best.rows()
        return pa.Table.from_arrays([right.column("query_id").combine_chunks().take(pa.array(of)), pa.array(i), pa.array(s)], names=["query_id", "id", "similarity"])

    key = ["list", "part", "turn"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, kinds)
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)
