"""Ranked lexical search: the best documents of each item by range-maximum tables over posting lists.

The corpus is read once and written as parts: the postings of some thousand documents, term after term, each list by
document id. A part gets a sparse table of the place of the greatest impact in every run of 2^j postings. An item then
takes intervals of documents best first: an interval's bound is the sum, over the item's terms, of the greatest impact
in it; it is split at the document of greatest impact, which is scored, and what cannot reach the ten best so far is left.
The ten best are carried from part to part of a task; those of the tasks are ranked by a window.

Items come in blocks of about ``BLOCK_TERMS`` terms, by a hash of their row; what is sent to tasks is one block and the
counts of its distinct terms, whatever the size of the table. Each block reads the corpus once. Every item is compared
with all documents, and all documents count in N, L and df.

Defined cases: null and empty texts have no term, and an item without one has no rows. Equal scores go by document id,
null ids last; repeated documents each have a rank, repeated items each have their rows, a null item id stays. An empty table
gives an empty result. Texts of any length are read in pieces that end between words. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm import hashing
from foretide.llm.common import ascii_lower, numbered, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
BLOCK_TERMS = 1 << 18
#: Postings of a part, its documents times terms, and bytes of text that are cut into words at a time.
PART, CELLS, PIECE = 1 << 20, 1 << 29, 1 << 22
#: Intervals that an item splits at once, the best first.
AT_ONCE = 8
INDEX = "ids array<bigint>, n array<int>, terms array<int>, lengths array<int>, docs array<int>, tf array<int>, with_terms bigint, all_terms bigint"
LAST = np.iinfo(np.int64).max


class Vocabulary:
    """The distinct terms of a block: found by hash, confirmed byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        starts, ends = hashing.word_bounds(data, hashing.NOT_ALNUM)
        h = hashing.word_hashes(data, starts, ends)
        order = np.argsort(h, kind="stable")
        self.data, self.hash, self.number = data, h[order], order.astype(np.int32)
        self.start, self.size = starts[order], (ends - starts)[order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that are terms, their numbers)."""
        h = hashing.word_hashes(data, starts, ends)
        at = np.searchsorted(self.hash, h)
        hit = np.flatnonzero((at < len(self.hash)) & (self.hash[np.minimum(at, len(self.hash) - 1)] == h))
        words, numbers = [], []
        while len(hit):
            term = at[hit]
            size = np.where(self.size[term] == ends[hit] - starts[hit], self.size[term], 0)
            equal = np.zeros(len(hit), dtype=bool)
            for n in np.flatnonzero(np.bincount(size)):
                of = np.flatnonzero(size == n)
                for block in np.array_split(of, max(1, len(of) * int(n) >> 22)) if n else ():
                    step = np.arange(n)
                    equal[block] = (data[starts[hit[block]][:, None] + step] == self.data[self.start[term[block]][:, None] + step]).all(axis=1)
            words.append(hit[equal])
            numbers.append(self.number[term[equal]])
            # Terms of one hash stand next to each other: a word that was not this one may be the next.
            hit = hit[~equal]
            at[hit] += 1
            hit = hit[at[hit] < len(self.hash)]
            hit = hit[self.hash[at[hit]] == h[hit]]
        return (np.concatenate(words), np.concatenate(numbers)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes that end between words."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw):
            gaps = np.flatnonzero(hashing.NOT_ALNUM[np.frombuffer(raw[end : end + PIECE], dtype=np.uint8)])
            if len(gaps):
                end += int(gaps[0])
                break
            end += PIECE
        yield raw[at:end]
        at = end


class _Part:
    """The postings of some documents, gathered piece by piece."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.ids: list = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, docs: np.ndarray, texts: list[bytes]) -> None:
        """``docs``: the number in this part of each text; a document may come in several texts."""
        joined = b"\n".join(texts) + b"\n"
        data = hashing.LOWER[np.frombuffer(joined, dtype=np.uint8)]
        starts, ends = hashing.word_bounds(data, hashing.NOT_ALNUM)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        of = docs[np.searchsorted(begin, starts, side="right") - 1] if len(starts) else np.zeros(0, dtype=np.int64)
        self.n.append((docs, np.bincount(np.searchsorted(docs, of), minlength=len(docs))))
        words, terms = self.vocabulary.find(data, starts, ends)
        key, tf = np.unique(terms.astype(np.int64) << 32 | of[words], return_counts=True)
        self.found.append((key >> 32, key & 0xFFFFFFFF, tf))
        self.postings += len(key)

    def row(self):
        import pyarrow as pa

        total = np.zeros(len(self.ids), dtype=np.int64)
        for docs, n in self.n:
            np.add.at(total, docs, n)
        term, doc, tf = (np.concatenate(c) for c in zip(*self.found, strict=True))
        # Documents by id, nulls last; only those with a posting are kept.
        ids = np.array([LAST if i is None else i for i in self.ids], dtype=np.int64)
        null = np.array([i is None for i in self.ids], dtype=bool)
        used = np.unique(doc)
        order = used[np.lexsort((ids[used], null[used]))]
        place = np.zeros(len(ids), dtype=np.int64)
        place[order] = np.arange(len(order))
        key, at = np.unique(term << 32 | place[doc], return_inverse=True)
        counts = np.bincount(at, weights=tf, minlength=len(key)).astype(np.int64)
        terms, lengths = np.unique(key >> 32, return_counts=True)
        lists = [pa.array(ids[order], mask=null[order]), pa.array(total[order].astype(np.int32)), *[pa.array(x.astype(np.int32)) for x in (terms, lengths, key & 0xFFFFFFFF, counts)]]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        columns += [pa.array([int((total > 0).sum())], pa.int64()), pa.array([int(total.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "n", "terms", "lengths", "docs", "tf", "with_terms", "all_terms"])


def indexed(docs: DataFrame, terms: list[str], id_col: str, text_col: str, part: int = PART) -> DataFrame:
    """One row a part: its documents and the postings of ``terms`` in them."""

    def parts(batches):
        vocabulary = Vocabulary(terms)
        now = _Part(vocabulary)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id")
            numbers, held, size = [], [], 0
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                for piece in _pieces(raw):
                    if not numbers or numbers[-1] != len(now.ids):
                        numbers.append(len(now.ids))
                        held.append(piece)
                    else:  # a document's next piece comes in a round of its own, so that numbers rise
                        now.add(np.array(numbers), held)
                        numbers, held, size = [len(now.ids)], [piece], 0
                    size += len(piece)
                now.ids.append(ids[i].as_py())
                if size >= PIECE or i == batch.num_rows - 1 or len(now.ids) * len(terms) >= CELLS:
                    if numbers:
                        now.add(np.array(numbers), held)
                    numbers, held, size = [], [], 0
                    if now.postings >= part or len(now.ids) * len(terms) >= CELLS:
                        yield now.row()
                        now = _Part(vocabulary)
        if now.found:
            yield now.row()

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(parts, INDEX)


class _Items:
    """A block of items: the distinct terms of each, how often it names them, and the terms' weights."""

    def __init__(self, terms_of: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        flat = [np.unique(t, return_counts=True) for t in terms_of]
        self.count = len(flat)
        self.item = np.repeat(np.arange(len(flat)), [len(t) for t, _ in flat])
        self.term = np.concatenate([t for t, _ in flat]).astype(np.int64)
        self.times = np.concatenate([c for _, c in flat]).astype(np.int64)
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms


class _Best:
    """The best documents so far of each item."""

    def __init__(self, items: int, top: int) -> None:
        self.score = np.zeros((items, top), dtype=np.int64)
        self.id = np.full((items, top), LAST)
        self.null = np.ones((items, top), dtype=bool)
        self.top = top

    def open(self, item: np.ndarray, bound: np.ndarray, first_id: np.ndarray, first_null: np.ndarray) -> np.ndarray:
        """Which intervals may still hold one of the best: ``first_id`` is the least document of each."""
        least, last, null = self.score[item, -1], self.id[item, -1], self.null[item, -1]
        earlier = (first_null < null) | ((first_null == null) & (first_id < last))
        return (bound > least) | ((bound == least) & (bound > 0) & earlier)

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = (score > 0) & (score >= self.score[item, -1])
        item, score, ids, null = item[some], score[some], ids[some], null[some]
        if not len(item):
            return
        touched = np.unique(item)
        own = np.repeat(touched, self.top)
        item, score = np.concatenate((own, item)), np.concatenate((self.score[touched].ravel(), score))
        ids, null = np.concatenate((self.id[touched].ravel(), ids)), np.concatenate((self.null[touched].ravel(), null))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, touched)
        keep = order[(first[:, None] + np.arange(self.top)).ravel()]
        for mine, new in ((self.score, score), (self.id, ids), (self.null, null)):
            mine[touched] = new[keep].reshape(-1, self.top)


class _Tables:
    """The posting lists of a part with their range-maximum tables."""

    def __init__(self, row, items: _Items) -> None:
        # Only the element vectors of the row's lists are read.
        ids, n, terms, lengths, docs, tf = row
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        n, terms, lengths, docs, tf = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (n, terms, lengths, docs, tf))
        self.d = len(self.ids)
        slot = np.repeat(np.arange(len(terms)), lengths)
        self.doc, self.last = docs, max(len(docs) - 1, 0)
        # One bit a list and document, and before each word of bits the number of postings: a place is one count of bits.
        self.words = (self.d >> 6) + 1
        cell = slot * self.words + (docs >> 6)
        self.bits = np.zeros(len(terms) * self.words + 1, dtype=np.uint64)
        filled = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(docs):
            self.bits[cell[filled]] = np.bitwise_or.reduceat(np.uint64(1) << (docs & 63).astype(np.uint64), filled)
        self.before = np.zeros(len(self.bits), dtype=np.int32)
        self.before[1:] = np.cumsum(np.bitwise_count(self.bits[:-1]), dtype=np.int64)
        most = int(n.max(initial=0)) * items.n_docs * 75
        wide = n if most < 2**62 else n.astype(object)
        m = 25 + np.asarray((75 * wide * items.n_docs) // max(items.n_terms, 1), dtype=np.int64)
        self.impact = items.weights[terms[slot]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])) if len(docs) else docs
        tables, size, longest = [np.arange(len(docs), dtype=np.int32)], 1, int(lengths.max(initial=1))
        while size * 2 <= longest:
            old = tables[-1]
            a, b = old[: len(old) - size], old[size:]
            new = old.copy()  # places whose run leaves the list are never asked for
            new[: len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
            tables.append(new)
            size *= 2
        self.tables = np.stack(tables)
        self.level = np.zeros(longest + 1, dtype=np.int64)
        self.level[1:] = np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)
        # The items' terms that occur here.
        at = np.searchsorted(terms, items.term)
        here = (at < len(terms)) & (terms[np.minimum(at, max(len(terms) - 1, 0))] == items.term) if len(terms) else np.zeros(len(at), dtype=bool)
        self.base, self.times = at[here] * self.words, items.times[here]
        self.count = np.bincount(items.item[here], minlength=items.count)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def _terms(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval of each term, the term's place, where an interval's terms begin)."""
        count = self.count[item]
        of = np.repeat(np.arange(len(item)), count)
        start = np.concatenate(([0], np.cumsum(count)[:-1]))
        return of, self.first[item][of] + np.arange(len(of)) - start[of], start

    def _place(self, base: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many postings stand before ``doc`` in its list, counted from the part's first; whether it has one)."""
        cell, bit = base + (doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64)
        bits = self.bits[cell]
        return self.before[cell] + np.bitwise_count(bits & (bit - np.uint64(1))).astype(np.int64), (bits & bit) != 0

    def _greatest(self, left: np.ndarray, right: np.ndarray, of: np.ndarray, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval: the sum of the greatest impacts of its terms' postings left to right, and the document of the
        greatest of all."""
        some = right > left
        level = self.level[np.where(some, right - left, 1)]
        left = np.minimum(left, self.last)
        a, b = self.tables[level, left], self.tables[level, np.where(some, right - (1 << level), left)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        value = np.where(some, self.impact[at] * self.times[term], 0)
        best = np.flatnonzero(value == np.maximum.reduceat(value, start)[of])[::-1]
        split = np.zeros(len(start), dtype=np.int64)
        split[of[best]] = self.doc[at[best]]
        return np.add.reduceat(value, start), split

    def whole(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, split) of all documents of the part."""
        of, term, start = self._terms(item)
        base = self.base[term]
        return self._greatest(self.before[base].astype(np.int64), self.before[base + self.words].astype(np.int64), of, term, start)

    def split(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple:
        """(score of ``doc``; bound and split of lo to doc - 1; bound and split of doc + 1 to hi)."""
        of, term, start = self._terms(item)
        base = self.base[term]
        left, _ = self._place(base, lo[of])
        at, hit = self._place(base, doc[of])
        right, more = self._place(base, hi[of])
        score = np.add.reduceat(np.where(hit, self.impact[np.minimum(at, self.last)] * self.times[term], 0), start)
        return score, *self._greatest(left, at, of, term, start), *self._greatest(at + hit, right + more, of, term, start)

    def search(self, best: _Best, at_once: int = AT_ONCE) -> int:
        """Bring ``best`` up to date with this part; returns how many documents were scored."""
        item = np.flatnonzero(self.count)
        scored = 0
        if not len(item):
            return scored
        lo, hi = np.zeros(len(item), dtype=np.int64), np.full(len(item), self.d - 1)
        bound, split = self.whole(item)
        while True:
            open_ = best.open(item, bound, self.ids[lo], self.null[lo])
            item, lo, hi, bound, split = item[open_], lo[open_], hi[open_], bound[open_], split[open_]
            if not len(item):
                return scored
            order = np.lexsort((lo, -bound, item))
            rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            now, later = order[rank < at_once], order[rank >= at_once]
            score, *halves = self.split(item[now], lo[now], hi[now], split[now])
            best.offer(item[now], score, self.ids[split[now]], self.null[split[now]])
            scored += len(now)
            new = (
                np.concatenate((item[now], item[now])), np.concatenate((lo[now], split[now] + 1)), np.concatenate((split[now] - 1, hi[now])),
                np.concatenate((halves[0], halves[2])), np.concatenate((halves[1], halves[3])),
            )
            some = new[3] > 0
            item, lo, hi, bound, split = (np.concatenate((x[later], y[some])) for x, y in zip((item, lo, hi, bound, split), new, strict=True))


def _searched(index: DataFrame, items: _Items, top: int) -> DataFrame:
    """(item, id, score): the best of each item in each task's parts."""

    def search(batches):
        import pyarrow as pa

        best = _Best(items.count, top)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].values for c in ("ids", "n", "terms", "lengths", "docs", "tf")]
                if len(row[4]):
                    _Tables(row, items).search(best)
        item, place = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(best.id[item, place], mask=best.null[item, place]), pa.array(best.score[item, place])], names=["item", "id", "score"]
        )

    return index.mapInArrow(search, "item int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, part: int = PART) -> DataFrame:
    """(item, rank, document, score): the ``top`` best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"item {kind}, rank int, doc long, score long"
    terms = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(item_text), F.lit(""))), F.lit(f"({TERM})"), F.lit(1))
    cut, row = numbered(items.select(F.col(item_col).alias("item"), terms.alias("terms")).filter(F.size("terms") > 0), "items")
    total = cut.agg(F.sum(F.size("terms"))).first()[0]
    out = None
    for block in range(-(-(total or 0) // block_terms)):
        blocks = -(-total // block_terms)
        mine = cut.filter(F.pmod(F.xxhash64(row), F.lit(blocks)) == block).orderBy(row).collect()
        if not mine:
            continue
        words = sorted({w for r in mine for w in r["terms"]})
        number = {w: i for i, w in enumerate(words)}
        index = stored(indexed(docs, words, id_col, text_col, part), "index")
        df = np.zeros(len(words), dtype=np.int64)
        pairs = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("p")).groupBy("p.terms").agg(F.sum("p.lengths").alias("df"))
        for r in pairs.collect():  # one row a distinct term of the block
            df[r["terms"]] = r["df"]
        sums = index.agg(F.sum("with_terms"), F.sum("all_terms")).first()
        n_docs, n_terms = sums[0] or 0, sums[1] or 0
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        found = _searched(index, _Items([[number[w] for w in r["terms"]] for r in mine], weights, n_docs, n_terms), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(mine)], f"number int, name {kind}")
        found = found.join(names, F.col("item") == F.col("number")).select(F.col("name").alias("item"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc"), "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = rf"""
WITH lower_ AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM benchmark),
asked AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM items) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM lower_),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM lower_) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT rid, doc_id, 100 - 75 + ((75 * len(w) * n) // l) AS m FROM lower_, s WHERE len(w) > 0),
scored AS (SELECT iid, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM asked JOIN p USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN lower_ USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r JOIN items USING (iid) WHERE rank <= {TOP}"""
