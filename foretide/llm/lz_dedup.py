"""Substring deduplication over words by relative Lempel-Ziv parsing.

Every word is removed that lies in a window of 35 words whose sequence also starts anywhere else in the corpus. The
reference of a context (see ``repeats``) is the block of all other contexts of its key, indexed by the hashes of their
windows. A context is parsed greedily from its first window on: where the window is in the index, the factor is drawn
out along its source word by word as far as both agree, and the parse goes on at the first window that the factor does
not hold; windows over a factor's boundary are so looked up one by one. Factors of 35 words and more are repeats.

Words are compared by 64-bit hashes of their bytes.

Defined cases: null text has no words; texts shorter than a window lose nothing; windows of one document may equal
each other, overlapping ones too; repeated rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import n_words, numbered
from foretide.llm.hashing import SPACE, mix, word_bounds, word_hashes
from foretide.llm.repeats import Windows, cleaned

LENGTH, SEED = 35, 6
MOST = LENGTH - SEED + 1


def _symbols(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    return word_hashes(raw, *word_bounds(raw, SPACE))


def _cut(text: bytes):
    symbols = _symbols(text)
    return lambda a, b: symbols[a:b].tobytes()


def parse(group: np.ndarray, low: np.ndarray, high: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which windows (by their anchor's offset in them) of each context lie in a factor against its group's others."""
    n, width = len(raw), LENGTH + MOST - 1
    words = np.zeros((n, width), dtype=np.uint64)  # the anchor stands in column MOST - 1
    end = np.zeros(n, dtype=np.int64)
    for i, (r, h) in enumerate(zip(raw, high.tolist(), strict=True)):
        own = np.frombuffer(r, dtype=np.uint64)
        start = MOST - 1 - h
        words[i, start : start + len(own)] = own
        end[i] = start + len(own)
    # The index: for each window another context of the group with the same window, or -1.
    other = np.full((n, MOST), -1, dtype=np.int64)
    for o in range(MOST):
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        h = group[live].astype(np.uint64)
        for c in range(MOST - 1 - o, MOST - 1 - o + LENGTH):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[live, c])
        by = np.argsort(h, kind="stable")
        same = h[by[1:]] == h[by[:-1]]
        x, y = live[by[1:]][same], live[by[:-1]][same]
        other[x, o], other[y[::-1], o] = y, x[::-1]
    out = np.zeros((n, MOST), dtype=bool)
    at = high.astype(np.int64).copy()
    rows = np.arange(n)
    while True:
        rows = rows[at[rows] >= low[rows]]
        if not len(rows):
            return out
        o = at[rows]
        source = other[rows, o]
        hit = np.flatnonzero(source >= 0)
        at[rows] -= 1
        if not len(hit):
            continue
        x, y, o = rows[hit], source[hit], o[hit]
        agree = words[x] == words[y]
        first = MOST - 1 - o
        # Words from the window's first on that agree, as far as both contexts reach.
        stop = np.minimum(end[x], end[y])
        column = np.arange(words.shape[1])
        bad = (column[None, :] >= first[:, None]) & (~agree | (column[None, :] >= stop[:, None]))
        factor = np.where(bad.any(axis=1), bad.argmax(axis=1), width) - first
        whole = factor >= LENGTH
        x, o, more = x[whole], o[whole], factor[whole] - LENGTH
        for k in range(int(more.max()) + 1 if len(more) else 0):
            inside = (k <= more) & (o - k >= low[x])
            out[x[inside], o[inside] - k] = True
        at[x] = o - more - 1


def _finish(text: bytes, a: np.ndarray, b: np.ndarray):
    words = text.split()
    ends = [0, *b.tolist()]
    kept = b" ".join(w for x, y in zip(ends, [*a.tolist(), len(words)], strict=True) for w in words[x:y])
    return hashlib.sha256(kept).hexdigest(), kept


WORDS = Windows(LENGTH, SEED, 8, _symbols, _cut, parse, _finish)


def lz_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and kept, the words that remain where any were
    removed (else null: all words stay)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows, rid = numbered(docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")), "lz-texts")
    rows = rows.withColumnRenamed(rid, "rid")
    changed = cleaned(rows.select("rid", "text"), WORDS).withColumnRenamed("kept_sha256", "new_sha256")
    spaced = F.regexp_replace(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), r"^ | \z", "")
    base = rows.select("rid", "doc_id", n_words(F.col("text")).alias("n_words"), F.sha2(spaced, 256).alias("sha"))
    return base.join(changed, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("new_sha256", "sha").alias("kept_sha256"),
        "kept",
    )


def op8_lz_dedup(spark, sf_dir: str) -> DataFrame:
    return lz_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Windows are told by MD5, which the brute-force test does not use.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i FROM win SEMI JOIN dup USING (h)), (SELECT unnest(range(35)) AS k)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
