"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

A source's target is its share of all words by weight, at most ``most`` times its own size, the excess reshared by
weight. Its documents are dealt into blocks; the mix takes every block ``floor(target / size)`` times and, for the
rest, permuted blocks until the quota is full, the last of them document by document. The exact numbers of blocks so
drawn are split among the output shards by a binary tree of multivariate-hypergeometric draws, each shard takes its
own run of each source's permuted blocks, disjoint from every other's, and shuffles its rows.

Defined cases: null text has size 0; the null source is a source of its own, last in order; a source of size 0 has
target 0; documents of size 0 are taken with their block; repeated rows are separate documents; an empty table gives
no rows. All choices hang on MD5 of ids, so reruns agree.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm.common import WORD, free_name, hex_rank, n_words, numbered, stored

#: Documents of a block and most blocks of a source; rows of an output shard, least and most output shards (the quota
#: table has sources x shards); documents that the rounding of a source's last block looks at.
BLOCK_ROWS, MOST_BLOCKS, SHARD_ROWS, LEAST_SHARDS, MOST_SHARDS, ROUNDING_ROWS = 128, 65_536, 250_000, 8, 4096, 256
#: Most rows of an output shard that one task writes.
RUN_ROWS = 10_000
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size) with weight and target. The level where no target is above ``most`` times its
    size follows in closed form: sources fill up in order of size by weight, and the first that does not sets it."""
    n = len(weights)
    ordered = sources.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(int(w)) for w in weights]),
            ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % n + 1).cast("int"),
        ),
    )
    ordered = ordered.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    ordered = ordered.withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    )
    ordered = ordered.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return ordered.withColumn("target", F.least("limit", fits["level"] * F.col("weight"))).select(
        "source", "source_size", "weight", "target", *[c for c in sources.columns if c not in ("source", "source_size")]
    )


def splitting_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Quota[s, i]: how many of the ``counts[i]`` drawn blocks of source i go to shard s. Halves of the shards get
    equal shares of all blocks, drawn without replacement, down to single shards; columns sum to ``counts``."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(counts)), dtype=np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        want, left, rest = round(total * (mid - lo) / (hi - lo)), np.zeros_like(have), total
        for i, n in enumerate(have):
            rest -= int(n)
            left[i] = got = rng.hypergeometric(int(n), rest, want) if want else 0
            want -= int(got)
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.array(counts, dtype=np.int64), 0, shards)
    return out


def _in_order(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a plan of built-in expressions."""
    lines = "\n".join(json.dumps(r) for r in rows)
    lines = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("j")).filter("j <> ''")
    return lines.select(F.from_json("j", schema).alias("m")).select("m.*")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, seed: int = 6, source: str = "source",
        text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, draws). Documents: rid, doc_id, size, source_size, target. Draws, one row for each copy that the mix
    takes: rid, size, pass, out_shard, out_slot (the place in the shard's own shuffled order).

    ``rid`` is the column of that name, a row number that is written with the rows of ``docs``; without one rows are
    numbered here, once, in a stored table.
    """
    spark = docs.sparkSession
    rank = lambda *x: hex_rank(F.lit(seed), *x)
    rows = docs.select(
        (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"),
        F.col(doc_id).alias("doc_id"),
        # A null source is told from every string by the prefix.
        F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("s"), source)).alias("key"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
    )
    rows = stored(rows, "mix-rows")
    sized = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = stored(
        targets(sized, weights, most)
        .withColumn("blocks", F.least(F.ceil(F.col("source_rows") / BLOCK_ROWS), F.lit(MOST_BLOCKS)))
        .withColumn(
            "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        )
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .drop("source"),
        "mix-sources",
    )
    placed = rows.drop("source").join(plan, "key").withColumn("block", F.pmod(rank(F.col("doc_id")), F.col("blocks")))
    placed = stored(placed.select("rid", "doc_id", "key", "size", "source_size", "target", "passes", "rest", "block"), "mix-placed")
    # Permuted blocks until the rest is full; the one that it ends in is taken in part.
    sums = placed.groupBy("key", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy(rank(F.lit("block"), F.col("key"), F.col("block")), "block")
    sums = sums.withColumn("room", F.col("rest") - F.sum("words").over(upto) + F.col("words"))
    part = F.when(F.col("room") >= F.col("words"), "all").when(F.col("room") > 0, "some").otherwise("none")
    part = F.when(F.col("rest") > 0, part).otherwise("none")
    blocks = stored(sums.select("key", "block", "passes", "room", part.alias("part")), "mix-blocks")
    some = blocks.filter("part = 'some'").select("key", "block", "room")
    docs_upto = Window.partitionBy("key").orderBy(rank(F.lit("doc"), F.col("doc_id")), "rid")
    inside = placed.join(some, ["key", "block"]).withColumn("upto", F.sum("size").over(docs_upto))
    first = inside.filter("upto <= room").select("rid")
    # What is still lacking is less than the next document: the largest that fit of those that follow fill it up.
    over = inside.filter("upto > room").withColumn("lacks", F.col("room") - F.min(F.col("upto") - F.col("size")).over(Window.partitionBy("key")))
    over = over.withColumn("nth", F.row_number().over(docs_upto)).filter(f"nth <= {ROUNDING_ROWS} and size <= lacks")
    fill = over.groupBy("key", "lacks").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "rid")), asc=False).alias("of"))
    fill = fill.select(
        F.explode(
            F.expr(
                "aggregate(of, struct(lacks as lacks, cast(array() as array<bigint>) as took), (s, x) -> "
                "if(x.size <= s.lacks, struct(s.lacks - x.size as lacks, array_append(s.took, x.rid) as took), s)).took"
            )
        ).alias("rid")
    )
    picked = first.union(fill).withColumn("picked", F.lit(True))
    # Exact numbers of drawn blocks, split among the shards.
    n_passes = F.col("passes") + F.when(F.col("part") == "none", 0).otherwise(1)
    units = blocks.filter(n_passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), n_passes.cast("long"))))
    counts = sorted((r["key"], r["n"]) for r in units.groupBy("key").agg(F.count("*").alias("n")).collect())
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-sum(n for _, n in counts) * BLOCK_ROWS // SHARD_ROWS)))
    quota = np.cumsum(splitting_tree([n for _, n in counts], shards, seed), axis=0)
    quota = _in_order(spark, [{"key": k, "upto": quota[:, i].tolist()} for i, (k, _) in enumerate(counts)], "key string, upto array<bigint>")
    nth = Window.partitionBy("key").orderBy(rank(F.lit("unit"), F.col("key"), F.col("block"), F.col("pass")), "block", "pass")
    units = (
        units.withColumn("nth", F.row_number().over(nth))
        .join(quota, "key")
        .select("key", "block", "pass", "part", F.expr("size(filter(upto, x -> x < nth))").alias("out_shard"))
    )
    draws = (
        placed.select("rid", "key", "block", "size", "passes")
        .join(units, ["key", "block"])
        .join(picked, "rid", "left")
        .filter((F.col("pass") <= F.col("passes")) | (F.col("part") == "all") | F.col("picked"))
    )
    local = Window.partitionBy("out_shard").orderBy(rank(F.lit("row"), F.col("rid"), F.col("pass")), "rid", "pass")
    draws = draws.select("rid", "size", "pass", "out_shard").withColumn("out_slot", F.row_number().over(local) - 1)
    return placed.select("rid", "doc_id", "size", "source_size", "target"), draws


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as it is taken, in the order of out_shard and
    out_slot.

    Defined cases: as for ``mix``; extra columns of any name are passed on."""
    docs, rid = numbered(docs, "mix-docs")
    shard, slot = free_name(docs.columns, "out_shard"), free_name(docs.columns, "out_slot")
    _, draws = mix(docs, rid=rid)
    draws = stored(draws.select(F.col("rid").alias(rid), F.col("out_shard").alias(shard), F.col("out_slot").alias(slot)), "mix-draws")
    most = draws.agg(F.max(shard).alias("shard"), F.max(slot).alias("slot")).first()
    # A shard is written as so many runs of its slots: no task holds more than RUN_ROWS rows.
    shards, slots = (most["shard"] or 0) + 1, (most["slot"] or 0) + 1
    runs = -(-slots // RUN_ROWS)
    part = F.col(shard) * runs + F.floor(F.col(slot) * runs / slots)
    # Never by broadcast: draws grow with the rows, and texts then move as often at every size.
    out = docs.join(draws.hint("merge"), rid)
    return out.repartitionById(shards * runs, part.cast("int")).sortWithinPartitions(shard, slot).drop(rid, shard, slot)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; rows come in the order of a document's first place (out_shard, out_slot) in
    the mix, those that are not taken last."""
    docs, draws = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    took = draws.groupBy("rid").agg(F.count("*").alias("copies"), F.sum("size").alias("taken"), F.min(F.struct("out_shard", "out_slot")).alias("first"))
    none = F.lit(0).cast("long")
    return docs.join(stored(took, "mix-took"), "rid", "left").orderBy(F.asc_nulls_last("first"), "rid").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("copies", none).alias("copies")
    )


def mix_sql(seed: int = 6) -> str:
    """What the mix takes, in DuckDB SQL: blocks and their order follow from MD5; which output shard a copy goes to does
    not change what is taken."""
    rank = lambda *x: f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(x)})), 1, 15) AS BIGINT)"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS key, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY key, source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(most, (SELECT arg_min(level, (ratio, level)) FROM l WHERE level <= ratio) * weight) AS target FROM l),
p AS (SELECT key, source_size, target, CAST(least(ceil(n / {BLOCK_ROWS}), {MOST_BLOCKS}) AS BIGINT) AS blocks, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
e AS (SELECT d.*, p.source_size, p.target, passes, target - passes * p.source_size AS rest, {rank("doc_id")} % blocks AS block FROM d JOIN p USING (key)),
b AS (SELECT key, block, rest, sum(size) AS words FROM e GROUP BY ALL),
c AS (SELECT key, block, words, rest, rest - sum(words) OVER (PARTITION BY key ORDER BY {rank("'block'", "key", "block")}, block) + words AS room FROM b),
u AS (SELECT e.rid, e.doc_id, e.key, e.size, room, sum(e.size) OVER o AS upto, hash_ FROM (SELECT *, {rank("'doc'", "doc_id")} AS hash_ FROM e) e
  JOIN c ON e.key = c.key AND e.block = c.block AND c.rest > 0 AND c.room > 0 AND c.room < c.words WINDOW o AS (PARTITION BY e.key ORDER BY hash_, e.rid)),
v AS (SELECT *, room - min(upto - size) OVER (PARTITION BY key) AS lacks, row_number() OVER (PARTITION BY key ORDER BY hash_, rid) AS nth FROM u WHERE upto > room),
f AS (SELECT key, rid, size, lacks, row_number() OVER (PARTITION BY key ORDER BY size DESC, doc_id DESC NULLS LAST, rid DESC) AS n FROM v WHERE nth <= {ROUNDING_ROWS} AND size <= lacks),
g(key, n, lacks, rid) AS (SELECT key, CAST(0 AS BIGINT), max(lacks), CAST(NULL AS BIGINT) FROM f GROUP BY key
  UNION ALL SELECT g.key, f.n, CASE WHEN f.size <= g.lacks THEN g.lacks - f.size ELSE g.lacks END, CASE WHEN f.size <= g.lacks THEN f.rid END FROM g JOIN f ON f.key = g.key AND f.n = g.n + 1),
x AS (SELECT rid FROM u WHERE upto <= room UNION SELECT rid FROM g WHERE rid IS NOT NULL),
y AS (SELECT e.*, CAST(passes AS BIGINT) + CASE WHEN c.rest > 0 AND c.room >= c.words OR e.rid IN (SELECT rid FROM x) THEN 1 ELSE 0 END AS copies FROM e JOIN c ON e.key = c.key AND e.block = c.block)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM y"""


OP6_SQL = mix_sql()
