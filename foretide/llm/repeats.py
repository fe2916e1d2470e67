"""Windows that occur more than once: the part that byte and word substring deduplication share.

A window is ``length`` consecutive symbols of one document. Equal windows choose the same anchor inside them, the
leftmost run of ``seed`` symbols whose hash is least, so only anchors are compared, about two for each ``length - seed``
symbols. An anchor owns the windows that chose it; its context is what these windows cover. In periodic text every period
has an anchor; those that follow each other with the same context are one row with a count. The stages:

1. every document is scanned for its anchors: key (the seed's hash), owned windows, a hash of the context;
2. keys that occur once cannot belong to a repeated window and go; this is all that is shuffled for most documents;
3. equal contexts form classes: with two members or more, all their windows are repeats;
4. one context of each class whose key has other classes is cut from its text and compared within its key, by the
   method of the operator, which tells for each class which of its windows occur in another; keys of more than
   MOST_CLASSES classes (a passage in a large part of all documents, with other words around it each time) would be too
   much for one task, and their windows are counted one by one under 128-bit hashes instead, spread over all tasks;
5. members take their class's answer, documents their members' spans.

Nothing is emitted for pairs: every stage is linear in anchors. All stages that are used twice are stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import stored, text_batches
from foretide.llm.hashing import mix, run_hashes

#: Windows that are scanned at a time, and contexts that are compared together (a key is never split).
SEGMENT, CHUNK = 1 << 20, 20_000
MOST_CLASSES = 100_000
_POSITION = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Windows:
    """``symbols`` turns a text into hashes of its symbols, ``cut`` takes symbols [from, to) of a text as bytes, ``unit``
    bytes each, ``compare`` gets keys, owned windows and contexts, sorted by key, and returns which offsets are repeats."""

    length: int
    seed: int
    unit: int
    symbols: Callable
    cut: Callable
    compare: Callable
    finish: Callable

    @property
    def choices(self) -> int:
        """Seeds in a window."""
        return self.length - self.seed + 1


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last window that chose it) for windows of ``w`` consecutive seeds."""
    n = len(h) - w + 1
    ranked = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    ranked = np.concatenate((ranked, np.full(-len(h) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(ranked, axis=1).ravel()
    behind = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate(([0], cut))
    return chosen[first], first, np.concatenate((cut - 1, [n - 1]))


def scan(symbols: np.ndarray, kind: Windows) -> list[tuple[np.ndarray, ...]]:
    """Rows (packed anchor place and owned offsets, key, context hash, how many such anchors follow each other) of a
    document."""
    out = []
    for at in range(0, len(symbols) - kind.length + 1, SEGMENT):
        part = symbols[at : at + SEGMENT + kind.length - 1]
        seeds, whole = run_hashes(part, kind.seed), run_hashes(part, kind.length)
        a, first, last = anchors(seeds, kind.choices)
        with np.errstate(over="ignore"):
            context = mix(whole[first] * np.uint64(0x9E3779B97F4A7C15) + mix(whole[last] + (last - first).astype(np.uint64)))
        key, low, high = seeds[a], a - last, a - first
        # Anchors with equal contexts whose windows follow each other without a gap.
        same = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (np.diff(a) == (high - low + 1)[1:])
        of = np.flatnonzero(np.concatenate(([True], ~same)))
        run = np.diff(np.append(of, len(a)))
        packed = (a + at) << 32 | low << 16 | high
        out.append((packed[of], key[of].view(np.int64), context[of].view(np.int64), run))
    return out


def _scan(kind: Windows):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rids = b.column("rid").to_numpy()
            for at, texts in text_batches(b.column("text")):
                rows, owner = [], []
                for i, t in enumerate(texts):
                    for r in scan(kind.symbols(t), kind):
                        rows.append(r)
                        owner.append(np.full(len(r[0]), rids[at + i]))
                if rows:
                    columns = [np.concatenate(owner), *(np.concatenate([r[c] for r in rows]) for c in range(4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "at", "key", "context", "run"])

    return run


def _contexts(kind: Windows):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            anchors_of = b.column("own").to_pylist()
            for at, texts in text_batches(b.column("text")):
                rows = []
                for t, own in zip(texts, anchors_of[at : at + len(texts)], strict=True):
                    cut = kind.cut(t)
                    for x in own:
                        a, low, high = x["at"] >> 32, x["at"] >> 16 & 0xFFFF, x["at"] & 0xFFFF
                        rows.append((x["key"], x["context"], x["at"] & 0xFFFFFFFF, x["n"], cut(a - high, a - low + kind.length)))
                if rows:
                    names, kinds = ["key", "context", "own", "n", "raw"], [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _joined(held: list[tuple]) -> tuple:
    """Columns of batches, the last of them lists, put together once."""
    return (*(np.concatenate(x) for x in list(zip(*held, strict=True))[:-1]), [r for x in held for r in x[-1]])


def _compared(kind: Windows):
    import pyarrow as pa

    def answer(rows):
        key, context, own, n, raw = rows
        low, high = own >> 16, own & 0xFFFF
        repeats = kind.compare(np.unique(key, return_inverse=True)[1], low, high, raw)
        repeats &= (n == 1)[:, None]  # classes of several members are known to repeat wholly
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        columns = [key[row], context[row], own[row], first, last]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "context", "own", "first", "last"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((*(b.column(c).to_numpy() for c in ("key", "context", "own", "n")), b.column("raw").to_pylist()))
            size += b.num_rows
            last = held[-1][0][-1]
            if size >= CHUNK and held[0][0][0] != last:
                # Keys come sorted: all but the last one are whole.
                pieces = _joined(held)
                end = int(np.searchsorted(pieces[0], last))
                yield answer(tuple(x[:end] for x in pieces))
                held, size = [tuple(x[end:] for x in pieces)], size - end
        if size:
            yield answer(_joined(held))

    return run


def _windows(kind: Windows):
    """Every owned window of each context under a 128-bit hash."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        for b in batches:
            rows = []
            for key, context, own, n, raw in zip(*(b.column(c).to_pylist() for c in ("key", "context", "own", "n", "raw")), strict=True):
                high, size = own & 0xFFFF, kind.length * kind.unit
                for o in range(own >> 16, high + 1):
                    at = (high - o) * kind.unit
                    rows.append((key, context, own, n, o, xxhash.xxh3_128_digest(raw[at : at + size])))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "context", "own", "n", "first", "window"])

    return run


def spans(docs: DataFrame, kind: Windows) -> tuple[DataFrame, DataFrame]:
    """(rid and text of the documents with shared anchors, rid and the symbol spans [from, to) that repeats cover).

    ``docs`` is a stored table with rid, written with the rows, and text.
    """
    found = stored(docs.mapInArrow(_scan(kind), "rid long, at long, key long, context long, run long"), "anchors")
    # Small tables that large ones are joined with are stored first: both sides of the join are then plain exchanges,
    # and a key with a large part of all rows is split by the adaptive skew join.
    shared = stored(found.groupBy("key").agg(F.sum("run").alias("n")).filter("n > 1").select("key"), "shared")
    members = stored(found.join(shared, "key", "left_semi").withColumn("own", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))), "members")
    texts = stored(docs.join(members.select("rid").distinct(), "rid", "left_semi"), "texts")
    same = ["key", "context", "own"]
    classes = stored(members.groupBy(*same).agg(F.sum("run").alias("n"), F.min(F.struct("rid", "at")).alias("one")), "classes")
    several = stored(classes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "several")

    def contexts(keys: DataFrame) -> DataFrame:
        chosen = classes.join(keys.select("key"), "key", "left_semi").select("one.rid", F.struct("one.at", "key", "context", "n").alias("x"))
        chosen = chosen.groupBy("rid").agg(F.collect_list("x").alias("own"))
        cut = texts.join(chosen, "rid").select("text", "own")
        return cut.mapInArrow(_contexts(kind), "key long, context long, own long, n long, raw binary")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = contexts(several.filter(F.col("m") <= MOST_CLASSES)).repartition(parts, "key").sortWithinPartitions("key")
    partly = cut.mapInArrow(_compared(kind), "key long, context long, own long, first long, last long")
    if not several.filter(F.col("m") > MOST_CLASSES).isEmpty():
        each = contexts(several.filter(F.col("m") > MOST_CLASSES)).mapInArrow(_windows(kind), "key long, context long, own long, n long, first long, window binary")
        each = stored(each, "windows")
        twice = stored(each.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window"), "twice")
        hit = each.filter("n = 1").join(twice, "window", "left_semi")
        partly = partly.union(hit.select(*same, "first", F.col("first").alias("last")))
    wholly = classes.filter("n > 1").select(*same, F.expr("own >> 16").alias("first"), F.expr("own & 65535").alias("last"))
    answers = stored(partly.union(wholly), "answers")
    place = F.shiftright("at", 32)
    own = members.select("rid", "at", "run", *same).join(answers, same)
    # Several anchors that follow each other are members of one class, which repeats wholly.
    end = place + (F.col("run") - 1) * (F.col("last") - F.col("first") + 1) - F.col("first") + kind.length
    own = own.select("rid", F.struct((place - F.col("last")).alias("a"), end.alias("b")).alias("s"))
    return texts, own.groupBy("rid").agg(F.collect_list("s").alias("spans"))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans [a, b) cover together."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]


def cleaned(docs: DataFrame, kind: Windows) -> DataFrame:
    """rid, n_removed, n_spans, kept_sha256 and kept of the documents that lose symbols."""
    import pyarrow as pa

    texts, found = spans(docs, kind)

    def run(batches):
        for b in batches:
            own = b.column("spans").to_pylist()
            for at, some in text_batches(b.column("text")):
                rows = []
                for t, s in zip(some, own[at : at + len(some)], strict=True):
                    a, e = merged(np.array([x["a"] for x in s]), np.array([x["b"] for x in s]))
                    rows.append((int((e - a).sum()), len(a), *kind.finish(t, a, e)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(at, len(some)), *columns], names=["rid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(found, "rid").select("rid", "text", "spans").mapInArrow(run, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
