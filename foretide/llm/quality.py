"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are a document's words, A-Z in lower case, by hash into WORD_TERMS of them, and the shapes of its words: letter case,
what a word ends in, its length, whether it repeats the word before it, and pairs of neighbouring shapes. Words tell what
a text is about, shapes how it is written; each half is weighted and scaled by itself. A bounded sample of labelled rows
gives the weights and a truncated SVD (by random projections and power steps with a fixed seed); every document's vector
is then compared with every labelled vector, exactly and in blocks, and the labels of the nearest vote with their cosine
as weight. Cosines are compared to six digits, ties go to the smaller id.

The labelled sample is the only bounded part: ``SAMPLE`` rows, the least in the order of a hash of their id, out of
all labelled rows outside the held-out third. What is broadcast has SAMPLE x (RANK + 1) + TERMS x RANK floats, whatever
the corpus. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts, and texts without words, have no terms and get the share of label 1 in the
sample; null ids are not held out; labels that are null or have no document are not learned from; without any labelled
row every score is 0.5; of several texts under one id the least is learned from; repeated rows are scored like others;
extra columns are ignored, or passed on by ``good``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import text_batches
from foretide.llm.hashing import LOWER, word_hashes

SAMPLE, RANK, NEIGHBOURS, BLOCK = 4000, 96, 15, 512
SHAPES = 32  # 4 cases x 4 endings x repeated or not
SHAPE_TERMS, WORD_TERMS = SHAPES * 3 + SHAPES * SHAPES, 2048
TERMS = SHAPE_TERMS + WORD_TERMS

#: Byte classes: 1 white space, 2 upper case, 4 lower case (and bytes beyond ASCII), 8 plain punctuation, 16 other signs.
_CLASS = np.full(256, 16, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 2, 4, 4, 0
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 8


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Documents x TERMS counts."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    if not texts:
        return out
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _CLASS[joined]
    space = kind == 1
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return out
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts - 1, side="right")

    def total(x):
        sums = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return sums[ends] - sums[starts]

    upper, lower = total(kind == 2), total(kind == 4)
    case = np.where(upper + lower == 0, 3, np.where(upper == 0, 0, np.where((upper > 1) & (upper >= lower), 2, 1)))
    last, before = joined[ends - 1], joined[np.maximum(ends - 2, starts)]
    bang = (last == 33) & (before == 33) & (lengths > 1)
    ending = np.where(bang, 2, np.where(kind[ends - 1] == 16, 3, np.where(kind[ends - 1] == 8, 1, 0)))
    word = word_hashes(LOWER[joined], starts, ends)
    same_doc = np.concatenate(([False], doc[1:] == doc[:-1]))
    repeats = same_doc & np.concatenate(([False], word[1:] == word[:-1]))
    shape = case * 8 + ending * 2 + repeats
    length = np.where(lengths <= 3, 0, np.where(lengths <= 8, 1, 2))
    pairs = np.flatnonzero(same_doc)
    flat = np.concatenate(
        (
            doc * TERMS + shape * 3 + length,
            doc[pairs] * TERMS + SHAPES * 3 + shape[pairs - 1] * SHAPES + shape[pairs],
            doc * TERMS + SHAPE_TERMS + (word >> np.uint64(40)).astype(np.int64) % WORD_TERMS,
        )
    )
    return np.bincount(flat, minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Term vectors of length 1, shapes and words with the same share."""
    x = np.log1p(counts) * weights
    return unit(np.concatenate((unit(x[:, :SHAPE_TERMS]), unit(x[:, SHAPE_TERMS:])), axis=1))


def fit(counts: np.ndarray, labels: np.ndarray) -> dict:
    """Term weights, the projection onto the leading singular directions, and the labelled unit vectors."""
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(counts, weights)
    seen = np.random.default_rng(5).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    for _ in range(4):
        seen = np.linalg.qr(x.T @ (x @ seen))[0]
    basis = seen @ np.linalg.svd(x @ seen, full_matrices=False)[2].T
    basis = np.ascontiguousarray(basis[:, :RANK], dtype=np.float32)
    return {"weights": weights, "basis": basis, "known": unit(x @ basis), "labels": labels.astype(np.float32)}


def neighbours(cosine: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest of each row to six digits, ties to the smaller column."""
    n = cosine.shape[1]
    rank = np.round(cosine * 1e6).astype(np.int64) * n - np.arange(n)
    return np.argpartition(-rank, k - 1, axis=1)[:, :k]


def score(model: dict, counts: np.ndarray) -> np.ndarray:
    prior = float(model["labels"].mean()) if len(model["labels"]) else 0.5
    out = np.full(len(counts), prior)
    if not len(model["labels"]):
        return out
    k = min(NEIGHBOURS, len(model["labels"]))
    for at in range(0, len(counts), BLOCK):
        vectors = unit(weighted(counts[at : at + BLOCK], model["weights"]) @ model["basis"])
        cosine = vectors @ model["known"].T
        near = neighbours(cosine, k)
        votes = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = votes.sum(axis=1)
        share = (votes * model["labels"][near]).sum(axis=1)
        np.divide(share, total, out=out[at : at + BLOCK], where=total > 0)
    return out


def _counts(batches):
    import pyarrow as pa

    for b in batches:
        for at, texts in text_batches(b.column("text")):
            c = term_counts(texts)
            rows, cols = np.nonzero(c)
            offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").slice(at, len(texts)),
                    b.column("label").slice(at, len(texts)),
                    pa.ListArray.from_arrays(offsets, pa.array(cols.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(c[rows, cols])),
                ],
                names=["id", "label", "term", "n"],
            )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of at most ``sample`` labelled rows outside the held-out third."""
    named = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    named = named.filter("id is not null and label is not null").filter(~held_out(F.col("id")))
    chosen = named.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    # At most ``sample`` ids: bounded, so broadcast.
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    # Of several texts under one id the least is learned from.
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("id").cast("string"), "label", "text")
    got = rows.mapInArrow(_counts, "id string, label int, term array<int>, n array<float>").collect()
    got.sort(key=lambda r: (len(r["id"]), r["id"], r["label"]))
    counts = np.zeros((len(got), TERMS), dtype=np.float32)
    for i, r in enumerate(got):
        counts[i, r["term"]] = r["n"]
    return fit(counts, np.array([r["label"] for r in got], dtype=np.float32))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, and the columns named in ``keep``."""
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    carried = [f for f in docs.schema.fields if f.name in keep]

    def scored(batches):
        for b in batches:
            for at, texts in text_batches(b.column("text")):
                s = np.round(score(model.value, term_counts(texts)), 6)
                rest = [b.column(c).slice(at, len(texts)) for c in ["doc_id", *(f.name for f in carried)]]
                names = ["doc_id", *(f.name for f in carried), "score"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s)], names=names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [docs.schema["doc_id"], *carried])
    out = docs.select("doc_id", *dict.fromkeys(["text", *keep])).mapInArrow(scored, f"{types}, score double")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *keep,
    )


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected (score of 0.5 or more). Defined cases: as for the module;
    without any labelled row nothing is rejected."""
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def kept(batches):
        for b in batches:
            own = [score(model.value, term_counts(t)).round(6) >= 0.5 for _, t in text_batches(b.column("text"))]
            yield b.filter(pa.array(np.concatenate(own) if own else [], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
