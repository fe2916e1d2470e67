"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are grouped by bit blocks: two that differ in at most ``BITS`` of 64 bits agree in at least ``agree`` of
``agree + BITS`` blocks, so the groups of equal block choices hold every linked pair. In each group the fingerprints
are sorted by Gray rank, which puts those with few differences side by side, and a hierarchy is built over the order:
a node keeps the bits that all below it share. Two nodes are compared by their shared bits alone; the differences so
far prune whole groups, and when even all unshared bits could not exceed the bound, whole groups are linked at once.
Groups of which all members are linked already are not compared again, so a large group of near copies costs no more
than its size, and only a spanning forest of links leaves a task.

Defined cases: null and empty texts have fingerprint zero and link like others; null ids never become a component's
id unless it has no other; repeated rows share a fingerprint; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import numbered, stored, text_batches
from foretide.llm.graph import components
from foretide.llm.hashing import mix

WORDS, BITS, SEED = 4, 4, 42
#: Most fingerprints that a group should hold on average: sets how many blocks have to agree.
GROUP = 2048
#: Node pairs that are expanded at a time, and fingerprints that are indexed together.
FRONTIER, CHUNK, FANOUT = 50_000, 100_000, 4
#: Constants that further fingerprint words mix into the shingles' hashes.
MORE = np.random.default_rng(3).integers(0, 2**64, 31, dtype=np.uint64)


def fingerprint(text: bytes, n_words: int = WORDS, words_out: int = 1) -> np.ndarray:
    """Majority bits of the XXH64 of the text's word shingles, A-Z in lower case; further words of 64 bits come from
    further mixes of the same hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(words_out, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - n_words + 1)
    last = ends[min(n_words, len(words)) - 1 :]
    ones = np.zeros(64 * words_out, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        pieces = zip(starts[at : min(n, at + (1 << 14))].tolist(), last[at : at + (1 << 14)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in pieces], dtype=np.uint64)
        h = h[:, None] if words_out == 1 else np.stack([h, *(mix(h ^ m) for m in MORE[: words_out - 1])], axis=1)
        ones += column_sums(np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1, bitorder="little"))
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of a matrix of zeros and ones over its rows, 255 rows at a time in bytes."""
    whole = len(bits) // 255 * 255
    out = np.add.reduce(bits[whole:], axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, n_words: int = WORDS, words_out: int = 1, carried=("doc_id",)) -> DataFrame:
    """The carried columns and fp (64 bits as a signed long; w0, w1, ... where there are more words) of every row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [fingerprint(t, n_words, words_out) for _, texts in text_batches(b.column("text")) for t in texts]
            fp = np.array(out, dtype=np.uint64).reshape(-1, words_out).view(np.int64)
            own = [pa.array(np.ascontiguousarray(fp[:, i])) for i in range(words_out)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *own], names=[*carried, *names])

    names = ["fp"] if words_out == 1 else [f"w{i}" for i in range(words_out)]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} long" for c in names]
    return docs.select(*carried, "text").mapInArrow(run, ", ".join(kinds))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each row of 64-bit words in the reflected Gray code over all its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    for i in range(1, x.shape[1]):  # a word is passed through backwards after an odd number of ones
        x[:, i] ^= np.uint64(0) - (x[:, i - 1] & np.uint64(1))
    return x


def ones(x: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(x)
    return n[:, 0] if n.shape[1] == 1 else n.sum(axis=1, dtype=np.int64)


def block_masks(agree: int, bits: int = BITS) -> list[int]:
    """A mask for each choice of ``agree`` of ``agree + bits`` blocks of a 64-bit word."""
    n = agree + bits
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agree)]


def settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (smallest index of the component) after the links u-v have been added."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class GrayIndex:
    """Rows of fingerprint words sorted by group and Gray rank, with levels of nodes that keep the bits common to all
    below. ``label`` starts with the links between neighbours in the order."""

    def __init__(self, fps: np.ndarray, group: np.ndarray, bits: int) -> None:
        self.bits = bits
        rank = gray_rank(fps)
        self.order = order = np.lexsort((*(rank[:, i] for i in reversed(range(rank.shape[1]))), group))
        self.fps, group = fps[order], group[order]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        starts = np.flatnonzero(new)
        nth = np.arange(len(fps)) - np.repeat(starts, np.diff(np.append(starts, len(fps))))
        low = np.arange(len(fps))
        # (first fingerprint, one past the last, first child, one past the last, shared bits, their mask)
        self.levels = [(low, low + 1, low, low + 1, self.fps, np.full_like(self.fps, ~np.uint64(0)))]
        width = FANOUT
        while True:
            cut = np.flatnonzero(new | (nth % width == 0))
            end = np.append(cut[1:], len(fps))
            both, any_ = np.bitwise_and.reduceat(self.fps, cut), np.bitwise_or.reduceat(self.fps, cut)
            below = self.levels[-1][0]
            kids = np.searchsorted(below, cut), np.searchsorted(below, end)
            self.levels.append((cut, end, *kids, both, ~(both ^ any_)))
            if len(cut) == len(starts):
                break
            width *= FANOUT
        near = np.flatnonzero(~new[1:] & (ones(self.fps[1:] ^ self.fps[:-1]) <= bits))
        self.label = settle(low.copy(), near, near + 1)

    def join(self) -> np.ndarray:
        """Component labels under links of at most ``bits`` differences within a group."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            first, end, kid, kid_end, shared, mask = self.levels[level]
            if level:
                least, most = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
            else:
                least = most = self.label
            todo = ~((least[a] == most[b]) & (most[a] == least[b]))  # not all of one component
            a, b = a[todo], b[todo]
            common = mask[a] & mask[b]
            differ = ones((shared[a] ^ shared[b]) & common)
            keep = differ <= self.bits
            a, b, common, differ = a[keep], b[keep], common[keep], differ[keep]
            whole = differ + ones(~common) <= self.bits
            if whole.any():
                x, y = a[whole], b[whole]
                self.label = settle(self.label, *self._stars(first, end, x, y))
                a, b = a[~whole], b[~whole]
            if level == 0 or not len(a):
                continue
            na, nb = kid_end[a] - kid[a], kid_end[b] - kid[b]
            each = na * nb
            at = np.repeat(np.arange(len(a)), each)
            k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            i, j = kid[a][at] + k // nb[at], kid[b][at] + k % nb[at]
            half = (a[at] != b[at]) | (i <= j)
            stack.append((level - 1, i[half], j[half]))
        return self.label

    @staticmethod
    def _stars(first, end, x, y):
        """Links that join all fingerprints below x and y, every one to the first below x."""
        u, v = [], []
        for n in (x, y):
            size = end[n] - first[n]
            at = np.repeat(np.arange(len(n)), size)
            u.append(first[n][at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size))
            v.append(first[x][at])
        return np.concatenate(u), np.concatenate(v)


def _linked(names: list[str], bits: int, node: str):
    """Links of a spanning forest for each run of complete groups; rows come sorted by group."""
    import pyarrow as pa

    def flush(ids, choice, part, *words):
        new = np.concatenate(([True], (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])))
        index = GrayIndex(np.stack(words, axis=1).view(np.uint64), np.cumsum(new), bits)
        label = index.join()
        own = np.flatnonzero(label != np.arange(len(label)))
        ids = ids[index.order]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in (node, "choice", "part", *names)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= CHUNK:
                last = (held[1] == held[1][-1]) & (held[2] == held[2][-1])
                whole = int(np.argmax(last))  # the last group goes on
                if whole:
                    yield flush(*(x[:whole] for x in held))
                    held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)

    return run


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links among the fingerprints ``fp`` that connect all pairs of at most ``bits`` differences."""
    n = distinct.count()
    agree = 1
    while n / 2 ** (64 * agree / (agree + bits)) > GROUP and agree < 5:
        agree += 1
    choices = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for i, m in enumerate(block_masks(agree, bits))]
    keyed = distinct.select("fp", F.explode(F.array(*choices)).alias("k")).select("fp", "k.choice", "k.part")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(choices) // 2_000_000))
    keyed = keyed.repartition(parts, "choice", "part").sortWithinPartitions("choice", "part")
    return keyed.mapInArrow(_linked(["fp"], bits, "fp"), "a long, b long")


def near_groups(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of ``docs``."""
    rows = stored(fingerprints(docs, n_words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    labelled = distinct.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    own = labelled.join(least, "label").select("fp", "component_id")
    return rows.join(own, "fp").select("doc_id", "fp", "component_id")


#: Near copies: five-word shingles, WIDE fingerprint words, of which the first BANDED are cut into bands of BAND bits to
#: find candidates (BAND divides 64). Two texts of shingle similarity J differ in acos(2J / (1 + J)) / pi of their bits, 0.151 at J = 0.8;
#: FAR is that share and half a standard deviation of WIDE words.
COPY_WORDS, WIDE, BANDED, BAND, FAR = 5, 16, 8, 16, 0.151 + 0.0056


def near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of each group of near copies: five-word shingles, similarity 0.8 or more.

    A group is what links between wide fingerprints connect. Of a group the row with the smallest doc_id stays, nulls
    last, then the first read. The bands find a pair of similarity 0.8 with probability 0.91, of 0.9 with 0.997, for any
    number of rows: their width and number are fixed, and larger tables only have larger groups.

    Defined cases: null and empty texts are copies of each other; a text of fewer than five words is one shingle;
    repeated rows are copies; an empty table gives no rows; extra columns are passed on.
    """
    names = [f"w{i}" for i in range(WIDE)]
    docs, rid = numbered(docs, "copies")
    rows = stored(fingerprints(docs, COPY_WORDS, WIDE, (rid, "doc_id")), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(rid).alias("row")))
    # Equal fingerprints meet first, in partial aggregation; a large group of copies is one row from here on.
    distinct = stored(rows.groupBy(*names).agg(best.alias("best")).withColumn("node", F.col("best.row")), "distinct")
    n = distinct.count()
    bands = []
    for i in range(64 * BANDED // BAND):
        word, at = divmod(i * BAND, 64)
        value = F.shiftrightunsigned(f"w{word}", at).bitwiseAND(F.lit((1 << BAND) - 1))
        bands.append(F.struct(F.lit(i).alias("choice"), value.alias("part")))
    keyed = distinct.select("node", *names, F.explode(F.array(*bands)).alias("k")).select("node", "k.choice", "k.part", *names)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(bands) // 500_000))
    keyed = keyed.repartition(parts, "choice", "part").sortWithinPartitions("choice", "part")
    found = keyed.mapInArrow(_linked(names, round(FAR * 64 * WIDE), "node"), "a long, b long")
    found = components(found).withColumnRenamed("label", "group")
    groups = distinct.select("node", "best").join(found, "node", "left").groupBy(F.coalesce("group", "node")).agg(F.min("best").alias("best"))
    return docs.join(groups.select(F.col("best.row").alias(rid)), rid, "left_semi").drop(rid)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
