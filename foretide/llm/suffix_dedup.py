"""Substring deduplication over bytes by deep-shallow suffix sorting.

Every byte is removed that lies in a string of 400 bytes which also starts anywhere else in the corpus. Anchors and
contexts come from ``repeats``; within a key the suffixes that start at the anchors, and the reversed prefixes that end
there, are sorted: multikey quicksort on 8-byte words down to a shallow depth, then, for the groups that still agree, a
blind trie each, which looks only at the bytes where strings branch. Two windows are equal when their suffixes share
enough of their order's common prefixes, and their prefixes likewise, so each window's answer is read off the two
orders.

Defined cases: null text counts as empty; texts shorter than a window lose nothing; windows of one document may equal
each other, overlapping ones too; repeated rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import numbered
from foretide.llm.hashing import BYTE
from foretide.llm.repeats import Windows, cleaned

LENGTH, SEED = 400, 128
#: Bytes that the quicksort looks at: the seed, which a key's strings share, and four words more.
SHALLOW = SEED + 32


class BlindTrie:
    """A Patricia trie over strings that agree up to ``depth``: nodes hold the place where strings branch, and a string
    is compared with one leaf only."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root: list | None = None  # [place, {byte or -1: node}] or [-1, [indices of equal strings]]

    def add(self, index: int) -> None:
        s = self.strings[index]
        if self.root is None:
            self.root = [-1, [index]]
            return
        node = self.root
        while node[0] >= 0:
            kids = node[1]
            c = s[node[0]] if node[0] < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        other = self.strings[node[1][0]]
        n = common(s, other, self.depth)
        if n == len(s) == len(other):
            node[1].append(index)
            return
        up, edge, node = None, None, self.root
        while 0 <= node[0] < n:
            up, edge = node, s[node[0]]
            node = node[1][edge]
        c = s[n] if n < len(s) else -1
        if node[0] == n:
            node[1][c] = [-1, [index]]
            return
        split = [n, {other[n] if n < len(other) else -1: node, c: [-1, [index]]}]
        if up is None:
            self.root = split
        else:
            up[1][edge] = split

    def in_order(self) -> tuple[list[int], list[int]]:
        """(indices in sorted order, length of the prefix that each shares with the one before)."""
        order, shared, stack = [], [], [(self.root, self.depth)]
        while stack:
            node, n = stack.pop()
            if node[0] < 0:
                order += node[1]
                shared += [n] + [len(self.strings[node[1][0]])] * (len(node[1]) - 1)
            else:
                keys = sorted(node[1])
                stack += [(node[1][c], node[0]) for c in reversed(keys[1:])]
                stack.append((node[1][keys[0]], n))
        return order, shared


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to ``at``, by halving."""
    low, high = at, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within their groups: (order, bytes that each shares with the one before it, -1 at a group's
    start). ``shallow`` is a multiple of 8."""
    n = len(strings)
    raw = np.zeros((n, shallow), dtype=np.uint8)
    size = np.fromiter(map(len, strings), np.int64, n)
    for i, s in enumerate(strings):
        head = s[:shallow]
        raw[i, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    words = raw.view(">u8").astype(np.uint64)
    # Multikey quicksort: only what still agrees is looked at one word deeper; padding sorts first, and a string that
    # ends within a word is told from one that goes on with zero bytes by its length.
    order = np.argsort(group, kind="stable")
    rank = group[order]
    new = np.concatenate(([True], rank[1:] != rank[:-1])) if n else np.zeros(0, bool)
    shared = np.where(new, -1, 0)
    for j in range(shallow // 8):
        open_ = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(open_):
            break
        run = np.cumsum(new)[open_]
        key, left = words[order[open_], j], np.minimum(size[order[open_]] - 8 * j, 8)
        by = np.lexsort((left, key, run))
        order[open_] = order[open_][by]
        key, left = key[by], left[by]
        same_run = np.concatenate(([False], run[1:] == run[:-1]))
        differ = same_run & np.concatenate(([False], (key[1:] != key[:-1]) | (left[1:] != left[:-1])))
        if differ.any():
            at = np.flatnonzero(differ)
            x = key[at] ^ key[at - 1]
            lead = np.zeros(len(at), dtype=np.int64)
            for k in range(8):
                lead += (lead == k) & ((x >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0)
            lead = np.minimum(lead, np.minimum(left[at], left[at - 1]))
            shared[open_[at]] = 8 * j + np.maximum(lead, 0)
            new[open_[at]] = True
        ended = same_run & ~differ & (left < 8)
        shared[open_[ended]] = size[order[open_[ended]]]
    # Blind tries for the groups that agree to the shallow depth.
    edges = np.append(np.flatnonzero(new), n)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            trie = BlindTrie([strings[i] for i in order[a:b]], min(shallow, int(size[order[a:b]].min())))
            for i in range(b - a):
                trie.add(i)
            own, lcp = trie.in_order()
            order[a:b] = order[a:b][own]
            shared[a + 1 : b] = lcp[1:]
    return order, shared


def compare(group: np.ndarray, low: np.ndarray, high: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which windows (by their anchor's offset in them) of each context occur in another context of its group."""
    n, most = len(raw), LENGTH - SEED + 1
    after = deep_shallow([r[h:] for r, h in zip(raw, high.tolist(), strict=True)], group, SHALLOW)
    before = deep_shallow([r[:h][::-1] for r, h in zip(raw, high.tolist(), strict=True)], group, 32)
    out = np.zeros((n, most), dtype=bool)
    place = np.empty(n, dtype=np.int64)
    for o in range(most):
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        code = np.zeros(n, dtype=np.int64)
        for (order, shared), need in ((after, LENGTH - o), (before, o)):
            place[order] = np.cumsum(shared < need)
            code = code * (n + 1) + place
        own = code[live]
        by = np.argsort(own)
        same = own[by[1:]] == own[by[:-1]]
        hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
        out[live[by[hit]], o] = True
    return out


def _cut(text: bytes):
    return lambda a, b: text[a:b]


def _finish(text: bytes, a: np.ndarray, b: np.ndarray):
    ends = [0, *b.tolist()]
    kept = b"".join(text[x:y] for x, y in zip(ends, [*a.tolist(), len(text)], strict=True))
    return hashlib.sha256(kept).hexdigest(), kept


def _symbols(text: bytes) -> np.ndarray:
    return BYTE[np.frombuffer(text, dtype=np.uint8)]


BYTES = Windows(LENGTH, SEED, 1, _symbols, _cut, compare, _finish)


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes that remain where any
    were removed (else null: the text is whole)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows, rid = numbered(docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")), "suffix-texts")
    rows = rows.withColumnRenamed(rid, "rid")
    changed = cleaned(rows.select("rid", "text"), BYTES).withColumnRenamed("kept_sha256", "new_sha256")
    base = rows.select(
        "rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")
    )
    return base.join(changed, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("new_sha256", "sha").alias("kept_sha256"),
        "kept",
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Bytes are pairs of hexadecimal digits; windows are told by MD5, which the brute-force test does not use.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT rid, i, md5(substring(x, 2 * i + 1, 800)) AS h FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS step FROM win SEMI JOIN dup USING (h)),
runs AS (SELECT rid, i, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM hit),
spans AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS after FROM spans),
kept AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
  string_agg(substring(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) || CASE WHEN after IS NULL THEN substring(x, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS t FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(t, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
