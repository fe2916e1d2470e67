"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows lie in P partitions. How many rows go from each partition to each of T output blocks is drawn exactly, as a
uniform permutation would have it: row by row of the matrix from the multivariate hypergeometric distribution of what
the blocks still lack. Each partition permutes its rows where they lie and deals them out by its row of the matrix, the
rows are exchanged once, and each block permutes what it got: rows of a block are put in the order of a random number,
in runs of that number's range, so that no task sorts more than about RUN_ROWS. A shard is a run of blocks, and a row's
slot is its block's offset plus its place in the block.

Defined cases: null text has size 1 and the CRC of the empty string; rows are told apart by their place in the stored
input, so null, equal and repeated ids are shuffled like others; an empty table gives no rows; copies are not kept
together, for a group may be larger than a shard; extra columns of any name are passed on by ``sharded``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretide.llm.common import free_name, numbered, stored

#: Bounds of the matrix: 2,048 x 2,048 counts are 4 M longs on the driver; a block holds at least BLOCK_ROWS rows
#: unless the table is smaller, and more where the table is larger: then it is permuted in runs of about RUN_ROWS.
MOST_BLOCKS, BLOCK_ROWS, RUN_ROWS, MOST_BROADCAST = 2048, 5_000, 20_000, 200_000
#: ``monotonically_increasing_id``: the partition stands above, the row's place in it below.
PLACE_BITS = 33


def communication_matrix(have: list[int], want: list[int], seed: int) -> np.ndarray:
    """Counts[i, j] of rows that go from partition i to block j under a uniform permutation: rows sum to ``have``,
    columns to ``want``, exactly."""
    rng, left = np.random.default_rng(seed), np.array(want, dtype=np.int64)
    out = np.zeros((len(have), len(want)), dtype=np.int64)
    for i, n in enumerate(have):
        rest, lacking = int(n), int(left.sum())
        if lacking < 1_000_000_000:
            out[i] = rng.multivariate_hypergeometric(left, rest, method="marginals") if rest else 0
            left -= out[i]
            continue
        for j, w in enumerate(left):  # conditional hypergeometric draws, one block at a time
            if not rest:
                break
            lacking -= int(w)
            out[i, j] = got = rest if not lacking else draw(rng, int(w), lacking, rest)
            rest -= got
        left -= out[i]
    return out


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw. Past numpy's range by rejection: a binomial draw from the smaller side is accepted in
    proportion to the chance that a binomial draw from the other makes up the rest, which leaves the hypergeometric law;
    half of the proposals or more are accepted."""
    if good > bad:
        return n - draw(rng, bad, good, n)
    if not n or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    chance = lambda k: log_choose(bad, k) + k * math.log(p) + (bad - k) * math.log1p(-p) if 0 <= k <= bad else -math.inf
    if p >= 1.0:
        return good
    top = chance(min(int((bad + 1) * p), bad))
    while True:
        x = int(rng.binomial(good, p))
        if math.log(rng.random() or 1e-300) <= chance(n - x) - top:
            return x


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def deal(rows: DataFrame, rid: str, shards: int, seed: int, name: str = "block") -> tuple[DataFrame, list[tuple[int, int]]]:
    """(``rows`` with a column ``name`` for the block, blocks as (shard, size)): the communication matrix and the permutation within each
    partition. ``rid`` is the stored row number; partitions are gathered into at most MOST_BLOCKS, so that the matrix
    stays bounded. Nothing is shuffled."""
    import pyarrow as pa

    at = F.shiftright(rid, PLACE_BITS)
    counts = sorted((r["at"], r["n"]) for r in rows.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect())
    have, offset = [0] * min(MOST_BLOCKS, max(len(counts), 1)), {}
    for i, (k, n) in enumerate(counts):
        part = i % len(have)
        offset[k] = (part, have[part])
        have[part] += n
    per = max(1, min(MOST_BLOCKS // shards, -(-sum(have) // (shards * BLOCK_ROWS))))
    blocks = [(s, size) for s, n in enumerate(shard_sizes(sum(have), shards)) for size in shard_sizes(n, per)]
    matrix = np.cumsum(communication_matrix(have, [n for _, n in blocks], seed), axis=1)
    shared = rows.sparkSession.sparkContext.broadcast((offset, have, matrix))  # at most 4 M longs, and three a partition
    def run(batches):
        offset, have, matrix = shared.value
        order: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(rid).to_numpy()
            out = np.empty(len(ids), dtype=np.int32)
            for k in np.unique(ids >> PLACE_BITS):
                part, first = offset[int(k)]
                if part not in order:
                    order = {part: np.random.default_rng([seed, part]).permutation(have[part])}
                own = np.flatnonzero(ids >> PLACE_BITS == k)
                place = order[part][(ids[own] & ((1 << PLACE_BITS) - 1)) + first]
                out[own] = np.searchsorted(matrix[part], place, side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])), blocks


def placed(rows: DataFrame, rid: str, shards: int, seed: int) -> DataFrame:
    """``rows`` with shard and slot. One exchange, by block and run; a run's first slot comes from the runs' counts."""
    block, run, nth, start = (free_name(rows.columns, c) for c in ("block", "run", "nth", "start"))
    dealt, blocks = deal(rows, rid, shards, seed, block)
    starts, at, last = [], 0, 0
    for s, n in blocks:
        at = at if s == last else 0
        starts.append(at)
        at, last = at + n, s
    runs = max(1, -(-max((n for _, n in blocks), default=0) // RUN_ROWS))
    number = F.xxhash64(F.lit(seed + 1), rid)
    of_run = F.floor(F.shiftrightunsigned(number, 33) * runs / (1 << 31)).cast("int")
    dealt = dealt.withColumn(run, of_run)
    spark = rows.sparkSession
    of = spark.createDataFrame([(i, s, a) for i, ((s, _), a) in enumerate(zip(blocks, starts, strict=True))], f"{block} int, shard int, {start} long")
    if runs == 1:
        first = of.withColumn(run, F.lit(0))
    else:
        # Counted from the row numbers alone.
        counts = deal(rows.select(rid), rid, shards, seed, block)[0].withColumn(run, of_run).groupBy(block, run).agg(F.count("*").alias("n"))
        before = Window.partitionBy(block).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
        counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard-runs")
        first = counts.join(of, block).select(block, run, "shard", (F.col(start) + F.col("before")).alias(start))
    w = Window.partitionBy(block, run).orderBy(number, rid)
    # A row for each block's run; broadcast only while they are few.
    first = F.broadcast(first) if len(blocks) * runs <= MOST_BROADCAST else first
    out = dealt.withColumn(nth, F.row_number().over(w)).join(first, [block, run])
    return out.withColumn("slot", F.col(start) + F.col(nth) - 1).drop(block, run, nth, start)


def shard(docs: DataFrame, shards: int = 8, seed: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null under this law)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size, crc = (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")
    rows, rid = numbered(docs.select(F.col(doc_id).alias("doc_id"), size, crc), "shard-rows")
    return placed(rows, rid, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """The rows of ``docs`` themselves, all columns, with shard and slot (out_shard and out_slot where ``docs`` has
    columns of these names). Texts move once."""
    own = {c: free_name(docs.columns, f"own_{c}") for c in docs.columns if c.lower() in ("shard", "slot")}
    new = {c: c if c not in {x.lower() for x in own} else free_name(docs.columns, f"out_{c}") for c in ("shard", "slot")}
    rows, rid = numbered(docs.withColumnsRenamed(own), "shard-docs")
    out = placed(rows, rid, shards, seed).drop(rid).withColumnsRenamed(new)
    return out.withColumnsRenamed({v: k for k, v in own.items()})


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
