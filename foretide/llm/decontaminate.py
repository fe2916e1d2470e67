"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A benchmark item and
a document that share a seed of ``TILE`` words are compared: running Karp-Rabin hashing finds the longest matches of
words that no tile covers yet, these become tiles, and so on with shorter matches down to ``TILE`` words. Tiles never
overlap, so a passage counts in whatever order its parts stand. A document is contaminated by an item when tiles cover
at least ``COVERAGE`` of the item's words.

The benchmark is the broadcast side, in blocks of at most ``BLOCK_BYTES`` of text whose size is checked; each block is
one pass over the documents. Documents are never shuffled.

Words are compared by 64-bit hashes. A match that a tile has cut is looked for anew before any
shorter one is taken, so each tile is the longest match that is left.

Defined cases: null and empty texts and items have no words and match nothing; an item shorter than a tile has to
stand whole; repetitive texts cost their length times the item's, compared as arrays; repeated rows are judged each by itself; extra columns are ignored or passed on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import text_batches
from foretide.llm.hashing import LOWER, NOT_ALNUM, run_hashes, sorted_member, word_bounds, word_hashes

TILE, COVERAGE, BLOCK_BYTES = 5, 0.6, 16 << 20


def words_of(text: bytes) -> np.ndarray:
    raw = LOWER[np.frombuffer(text, dtype=np.uint8)]
    return word_hashes(raw, *word_bounds(raw, NOT_ALNUM))


class Items:
    """A block of benchmark items and, for each seed length, the sorted seeds with the items that hold them."""

    def __init__(self, items: list[tuple[int, bytes]], tile: int) -> None:
        self.tile = tile
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                by_length.setdefault(min(tile, len(w)), []).append((np.unique(run_hashes(w, min(tile, len(w)))), k))
        self.seeds = {}
        for n, own in by_length.items():
            seeds = np.concatenate([s for s, _ in own])
            of = np.concatenate([np.full(len(s), k) for s, k in own])
            order = np.argsort(seeds, kind="stable")
            self.seeds[n] = (seeds[order], of[order])

    def candidates(self, words: np.ndarray) -> list[int]:
        found: set[int] = set()
        for n, (seeds, of) in self.seeds.items():
            runs = run_hashes(words, n)
            for hit in np.unique(runs[sorted_member(runs, seeds)]):
                found.update(of[np.searchsorted(seeds, hit) : np.searchsorted(seeds, hit, side="right")].tolist())
        return sorted(found)


#: Pairs of places that are looked at together.
PAIRS = 1 << 20


def matches(pattern: np.ndarray, text: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, search: int) -> np.ndarray:
    """Rows (length, start in the pattern, start in the text), longest first, of the runs of unmarked words, ``search``
    or longer, that agree and cannot be drawn out to the left."""
    heads, runs = run_hashes(pattern, search), run_hashes(text, search)
    if not len(heads) or not len(runs):
        return np.zeros((0, 3), np.int64)
    whole = lambda free: np.convolve(free, np.ones(search, int), "valid") == search
    i = np.flatnonzero(whole(free_p))
    i = i[np.argsort(heads[i], kind="stable")]
    j = np.flatnonzero(whole(free_t))
    low, high = (np.searchsorted(heads[i], runs[j], side=side) for side in ("left", "right"))
    j, low, n = j[high > low], low[high > low], (high - low)[high > low]
    # A word past either end, which is never free, stops every match.
    p, t, fp, ft = np.append(pattern, 0), np.append(text, 0), np.append(free_p, False), np.append(free_t, False)
    out, ends, first = [np.zeros((0, 3), np.int64)], np.cumsum(n), 0
    while first < len(j):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        some = slice(first, last)
        first = last
        y = np.repeat(j[some], n[some])
        x = i[np.repeat(low[some], n[some]) + np.arange(len(y)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])]
        longer = (x > 0) & (y > 0) & (p[x - 1] == t[y - 1]) & fp[x - 1] & ft[y - 1]
        x, y = x[~longer], y[~longer]
        size, alive = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(alive):
            u, v = x[alive] + size[alive], y[alive] + size[alive]
            alive = alive[(p[u] == t[v]) & fp[u] & ft[v]]
            size[alive] += 1
        out.append(np.stack((size, x, y), axis=1)[size >= search])
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in the pattern, start in the text) of each tile, longest matches first."""
    free_p, free_t, out = np.ones(len(pattern), bool), np.ones(len(text), bool), []
    search = max(least, min(len(pattern), 20))
    while True:
        found = matches(pattern, text, free_p, free_t, search)
        if len(found) and found[0, 0] > 2 * search:
            search = int(found[0, 0])
            continue
        for n, i, j in found.tolist():
            if not (free_p[i : i + n].all() and free_t[j : j + n].all()):
                break  # what a tile has left of this match may be longer than the next
            free_p[i : i + n] = free_t[j : j + n] = False
            out.append((n, i, j))
        if len(found):
            continue
        if search > 2 * least:
            search //= 2
        elif search > least:
            search = least
        else:
            return out


def contaminations(items: Items, text: bytes, coverage: float) -> list[tuple[int, float, int, int]]:
    """(item's number, coverage, tiles, words in tiles) for each item that the text covers."""
    words, out = words_of(text), []
    for k in items.candidates(words):
        pattern = items.words[k]
        found = tiles(pattern, words, min(items.tile, len(pattern)))
        covered = sum(n for n, _, _ in found)
        if covered >= coverage * len(pattern):
            out.append((k, covered / len(pattern), len(found), covered))
    return out


def blocks(benchmark: DataFrame, tile: int):
    """The benchmark as broadcast blocks of about BLOCK_BYTES at most; only its total size is asked for first."""
    sc = benchmark.sparkSession.sparkContext
    own = benchmark.select("item_id", "text").filter("text is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sc.broadcast(Items([(r["item_id"], r["text"].encode()) for r in part.collect()], tile))


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item that contaminates it: doc_id, item_id, coverage, tiles, tile_words."""
    import pyarrow as pa

    def scan(shared):
        def run(batches):
            for b in batches:
                ids = b.column("doc_id")
                for at, texts in text_batches(b.column("text")):
                    items, rows, out = shared.value, [], []
                    for i, t in enumerate(texts):
                        for k, share, n, words in contaminations(items, t, coverage):
                            rows.append(at + i)
                            out.append((items.ids[k], round(share, 4), n, words))
                    if rows:
                        columns = [list(c) for c in zip(*out, strict=True)]
                        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                            names=["doc_id", "item_id", "coverage", "tiles", "tile_words"],
                        )

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, coverage double, tiles long, tile_words long"
    own, out = docs.select("doc_id", "text"), None
    for shared in blocks(benchmark, tile):
        found = own.mapInArrow(scan(shared), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    import pyarrow as pa

    def scan(shared):
        def run(batches):
            for b in batches:
                keep = []
                for _, texts in text_batches(b.column("text")):
                    keep += [not contaminations(shared.value, t, coverage) for t in texts]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    for shared in blocks(benchmark, tile):
        docs = docs.mapInArrow(scan(shared), docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
