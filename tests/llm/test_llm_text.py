"""SimHash, substring dedups, decontamination, quality and token output against brute force."""

import collections
import hashlib
import random
import re
import time
import uuid
import zlib

import numpy as np
import xxhash
from llm.helpers import collected, frame, rows

from foretide.llm import decontaminate, graph, hashing, lz_dedup, mixing, quality, repeats, simhash, suffix_dedup, tokens
from foretide.llm.common import shared_dir

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, n):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_components(spark):
    data = rows(80)
    near = data[4][1].split()
    data += [(500 + i, " ".join(near[:i] + ["edit"] + near[i:]), *[None] * 11) for i in range(len(near))]
    got = collected(simhash.near_groups(frame(spark, data)))
    fps = [brute_fingerprint(r[1]) for r in data]
    roots = union([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], len(fps))
    least = {}
    for r, g in zip(data, roots, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = collections.Counter((r[0], f, least.get(g)) for r, f, g in zip(data, fps, roots, strict=True))
    assert want == collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got)
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(2)
    for words, bits in ((1, 4), (2, 20)):
        centre = rng.integers(0, 2**64, (6, words), dtype=np.uint64)
        fps = centre[rng.integers(0, 6, 500)]
        for _ in range(6 if words == 1 else 14):
            fps[np.arange(500), rng.integers(0, words, 500)] ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
        fps = np.unique(fps, axis=0)
        group = rng.integers(0, 2, len(fps))
        index = simhash.GrayIndex(fps, group, bits)
        label, own, g = index.join(), index.fps, np.sort(group)
        pairs = [(i, j) for i in range(len(own)) for j in range(i) if g[i] == g[j] and int(np.bitwise_count(own[i] ^ own[j]).sum()) <= bits]
        assert union(pairs, len(own)) == label.tolist()


def test_block_masks_hold_every_pair_within_the_bound():
    rng = random.Random(1)
    for agree in (1, 2, 3):
        masks = simhash.block_masks(agree)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(200, 201 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in collected(graph.components(spark.createDataFrame(edges, "a long, b long")))}
    roots = union(edges, 300)
    assert got == {n: roots[n] for e in edges if e[0] != e[1] for n in e}


def test_near_copies_leaves_one_of_each_group(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    data, group = [], {}
    for g in range(12):
        own = [rng.choice(words) for _ in range(300)]
        for c in range(4):
            copy = list(own)
            for _ in range(c):
                copy[rng.randrange(300)] = "edit"
            group[len(data)] = g
            data.append((len(data), " ".join(copy), *[None] * 11))
    data += [(None, data[0][1], *[None] * 11), (900, None, *[None] * 11), (901, "", *[None] * 11)]
    docs = frame(spark, data)
    out = simhash.near_copies(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in collected(out)]
    assert sorted(kept) == [4 * g for g in range(12)] + [900]


def brute_repeats(seqs, length):
    seen = collections.Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    marks = []
    for s in seqs:
        m = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                m[i : i + length] = [True] * length
        marks.append(m)
    return marks


def edited(n=14):
    """Copies with edits, passages at other places, periodic texts."""
    data, rng = rows(30), random.Random(8)
    base = " ".join(r[1] or "" for r in data)[:4000]
    for i in range(n):
        t = list(base[rng.randrange(500) : 3000 + rng.randrange(900)])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        data.append((2000 + i, "".join(t), *[None] * 11))
    data += [(3000, "ab" * 700, *[None] * 11), (3001, base[:399], *[None] * 11), (3002, base[100:500], *[None] * 11), (3003, "é" * 300, *[None] * 11)]
    return data


def test_suffix_dedup(spark):
    data = edited()
    got = collected(suffix_dedup.suffix_dedup(frame(spark, data)))
    texts = [(r[1] or "").encode() for r in data]
    want = collections.Counter()
    for r, t, m in zip(data, texts, brute_repeats(texts, 400), strict=True):
        kept = bytes(b for b, x in zip(t, m, strict=True) if not x)
        runs = sum(x and not (i and m[i - 1]) for i, x in enumerate(m))
        want[(r[0], len(t), sum(m), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert want == collections.Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got)
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of more than 50 words in two documents: what counts is their bytes, 400 at least."""
    rng = random.Random(11)
    fresh = iter(range(10**6))
    say = lambda n: "".join(f"{rng.choice('ghijkl')}{next(fresh):05d} " for _ in range(n // 7 + 1))[:n]
    data, want = [], {}
    for k, size in enumerate((371, 399, 400, 401, 700)):
        passage = say(size)
        assert len(passage.split()) > 50
        for i in (2 * k, 2 * k + 1):
            data.append((i, f"{say(300)}{i % 2}{passage}{'xy'[i % 2]}{say(300)}", *[None] * 11))
            want[i] = size if size >= 400 else 0
    assert {r["doc_id"]: r["n_removed"] for r in collected(suffix_dedup.suffix_dedup(frame(spark, data)))} == want


def test_keys_of_too_many_classes_are_counted_window_by_window(spark, monkeypatch):
    from foretide.llm import repeats

    docs = frame(spark, edited())
    for dedup in (suffix_dedup.suffix_dedup, lz_dedup.lz_dedup):
        want = sorted(map(str, collected(dedup(docs))))
        monkeypatch.setattr(repeats, "MOST_CLASSES", 3)
        assert sorted(map(str, collected(dedup(docs)))) == want
        monkeypatch.undo()


def test_deep_shallow_sorts_and_counts_common_bytes():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(90))) for _ in range(300)]
    strings += [s + b"x" for s in strings[:80]] + strings[:40] + [b"q" * 70 + s for s in strings[:60]]
    group = np.array([rng.randrange(3) for _ in strings])
    order, shared = suffix_dedup.deep_shallow(strings, group, 32)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == (-1 if group[order[k]] != group[order[k - 1]] else n)


def test_lz_dedup(spark):
    data = edited()
    got = collected(lz_dedup.lz_dedup(frame(spark, data)))
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data]
    want = collections.Counter()
    for r, t, m in zip(data, texts, brute_repeats(texts, 35), strict=True):
        kept = " ".join(w for w, x in zip(t, m, strict=True) if not x)
        want[(r[0], len(t), sum(m), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert want == collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got)
    assert lz_dedup.lz_dedup(frame(spark, [])).count() == 0


def test_near_copies_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """Pairs of similarity about 0.8, of which a count of four million fingerprints must not lose more than the true one."""
    rng = random.Random(8)
    data = []
    for i in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), 6):
            other[at] = f"v{rng.randrange(10**6)}"
        data += [(2 * i, " ".join(words), *[None] * 11), (2 * i + 1, " ".join(other), *[None] * 11)]
    docs = frame(spark, data)
    want = sorted(r["doc_id"] for r in collected(simhash.near_copies(docs)))
    count, calls = type(docs).count, []

    def many(df):
        calls.append(1)
        return 1 << 22 if len(calls) == 1 else count(df)

    monkeypatch.setattr(type(docs), "count", many)
    got = sorted(r["doc_id"] for r in collected(simhash.near_copies(docs)))
    assert calls and got == want and len(want) < 120


def test_greedy_string_tiling_takes_longest_matches_first():
    word = {w: i for i, w in enumerate("a b c d e f g h i j k l m n o p".split())}
    of = lambda s: np.array([word[w] for w in s.split()], dtype=np.uint64)
    assert decontaminate.tiles(of("a b c d e f g"), of("k a b c d e f g l"), 3) == [(7, 0, 1)]
    got = decontaminate.tiles(of("a b c d e f g h i j"), of("f g h i j k a b c d e"), 3)
    assert sorted(got) == [(5, 0, 6), (5, 5, 0)]
    assert decontaminate.tiles(of("a b c"), of("a b"), 3) == []
    # A passage that stands once covers the pattern's one place of it only.
    assert decontaminate.tiles(of("a b c a b c"), of("k a b c l"), 3) == [(3, 0, 1)]


def brute_tiles(p, t, least):
    """The longest common run of unmarked words, the first of equals, until none is long enough."""
    free_p, free_t, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free_p[i : i + n], free_t[j : j + n] = [False] * n, [False] * n
        out.append(best)


def test_tiling_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    for pairs in (1 << 20, 5):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        for letters, least in ((2, 3), (3, 2), (8, 1), (1, 3)):
            for _ in range(12):
                p, t = rng.integers(0, letters, rng.integers(1, 24)).astype(np.uint64), rng.integers(0, letters, rng.integers(1, 40)).astype(np.uint64)
                assert decontaminate.tiles(p, t, min(least, len(p))) == brute_tiles(p.tolist(), t.tolist(), min(least, len(p)))


def test_repetitive_texts_are_tiled_quickly():
    started = time.monotonic()
    assert sum(n for n, _, _ in decontaminate.tiles(np.zeros(200, np.uint64), np.zeros(8000, np.uint64), 5)) == 200
    assert sum(n for n, _, _ in decontaminate.tiles(np.tile(np.arange(3, dtype=np.uint64), 70), np.tile(np.array([0, 1, 2, 9], np.uint64), 2000), 3)) == 210
    assert time.monotonic() - started < 20


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(5)] + [(5, None), (6, ""), (7, "tiny item")]
    w = items[0][1].split()
    data = rows(20) + [
        (700, "x y " + items[1][1].upper() + ". z", *[None] * 11),
        (701, " ".join(w[20:] + ["between"] + w[:20]), *[None] * 11),  # reordered
        (702, " ".join(w[:12]), *[None] * 11),  # a third of an item
        (703, "a tiny, item here", *[None] * 11),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, data)
    got = {(r["doc_id"], r["item_id"]): r for r in collected(decontaminate.contaminated(docs, bench))}
    assert set(got) == {(700, 1), (701, 0), (703, 7)}
    assert got[701, 0]["tiles"] == 2 and got[701, 0]["coverage"] == 1.0
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(data) - 3
    none = bench.filter("item_id > 99")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.decontaminated(docs, none).count() == len(data)


def test_quality(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    data, marks = [], []
    for i in range(240):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        data.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", *[None] * 11))
        marks.append((i, 0 if bad else 1, 0))
    data += [(500, None, *[None] * 11), (501, "", *[None] * 11), (None, "abc def", *[None] * 11), (3, data[3][1], *[None] * 11)]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (9999, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, data)
    got = collected(quality.quality(docs, labels))
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held)
    good = quality.good(docs, labels)
    assert good.columns == docs.columns and good.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in collected(quality.quality(docs, labels.filter("doc_id < 0")))} == {0.5}


def test_votes_equal_brute_force():
    """Cosines with every labelled vector one by one, ties by place, votes by cosine."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Ab", "cd.", "EF!!", "gh", "ij,", "xx"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(90)]
    texts += [texts[3]] * 6 + [b"", b" \n"]
    labels = np.array([rng.randint(0, 1) for _ in range(60)])
    counts = quality.term_counts(texts)
    model = quality.fit(counts[:60], labels)
    vectors = quality.unit(quality.weighted(counts, model["weights"]) @ model["basis"])
    for v, got in zip(vectors, quality.score(model, counts), strict=True):
        cosine = [float(np.dot(v, k)) for k in model["known"]]
        near = sorted(range(60), key=lambda i: (-round(cosine[i] * 1e6), i))[: quality.NEIGHBOURS]
        votes = [max(cosine[i], 0.0) for i in near]
        want = sum(w * labels[i] for w, i in zip(votes, near, strict=True)) / sum(votes) if sum(votes) > 0 else labels.mean()
        assert abs(got - want) < 1e-4
    same = quality.neighbours(np.array([[0.5, 0.9, 0.5, 0.5, 0.1]]), 3)
    assert sorted(same[0].tolist()) == [0, 1, 2]


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = collected(quality.quality(docs, labels).filter("held_out").join(labels, "doc_id"))
    assert len(got) > 80
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    data = rows(40)
    data += [(800, "it's  two   spaces\n\n here 'll\t<|endoftext|>", *[None] * 11), (801, " lead and trail ", *[None] * 11), (802, "½Ⅷ 12३ _-_ \x85 \x1c", *[None] * 11)]
    out = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokens.write_tokens(frame(spark, data), tokens.tokenizer_path(), out, part_rows=20)
    got = sorted(collected(tokens.read_tokens(spark, out)), key=lambda r: r["start"])
    assert len(got) == len(data)
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    plain.encode_special_tokens = True
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    assert collections.Counter((r[0], tuple(ids(r[1]))) for r in data) == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got)
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    digest = {(r["start"]): r for r in collected(tokens.token_digests(spark, out))}
    for r in got:
        assert digest[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    empty = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokens.write_tokens(frame(spark, []), tokens.tokenizer_path(), empty)
    assert tokens.token_digests(spark, empty).count() == 0


def test_token_output_gives_added_tokens_their_ids(spark, tmp_path):
    """The query against an unmodified Tokenizer: an added token's content in a text is that token."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y ", "<|endoftext", "plain text", None, ""]
    frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert plain.token_to_id("<|endoftext|>") in plain.encode(texts[0], add_special_tokens=False).ids
    got = collected(tokens.op10_token_output(spark, str(tmp_path)))
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got) == want


def test_each_distinct_chunk_is_looked_up_once_for_many_texts():
    from tokenizers import Tokenizer

    class Counted(tokens.Chunks):
        n = 0

        def __getitem__(self, c):
            Counted.n += 1
            return super().__getitem__(c)

    rng = random.Random(3)
    bits = ["the", "it's", "12", "漢字", "é", "_-_", "\n", "\n", "  ", "\t", "\x1c", "\u3000", "\r\n", "!?", "<|endoftext|>", "😀", "\x00", *" " * 12]
    texts = ["", " ", "\n", "\n\n", " \n", "\n a", "a\n", "a "] + ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(400)]
    for added in (True, False):
        plain = Tokenizer.from_file(tokens.tokenizer_path())
        plain.encode_special_tokens = not added
        own = tokens.Encoder(tokens.tokenizer_path(), added)
        assert [x.tolist() for x in own.encode(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert own.encode([]) == []
    own.chunks = Counted(own.pieces, own.find)
    some = ["a few words\nof two lines"] * 500
    assert len({tuple(x.tolist()) for x in own.encode(some)}) == 1
    assert Counted.n < 50


def test_row_numbers_do_not_hang_on_how_files_are_split(spark, tmp_path):
    """Splits follow the executors that are alive: results made under one setting and read under another stay equal."""
    docs = frame(spark, rows(80), 4)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    for make in (suffix_dedup.suffix_dedup, lz_dedup.lz_dedup, simhash.near_copies, mixing.mixed):
        want = collections.Counter(map(str, collected(make(docs))))
        try:
            made = make(docs)
            spark.conf.set(name, "2000")
            assert collections.Counter(map(str, collected(made))) == want, make.__name__
        finally:
            spark.conf.set(name, before)


def test_periodic_texts_have_few_anchors(spark):
    for text in (b"a" * 50_000, b"ab" * 30_000, b"abcdefg " * 9_000):
        found = repeats.scan(suffix_dedup.BYTES.symbols(text), suffix_dedup.BYTES)
        assert sum(len(r[0]) for r in found) < 20 * len(found) and sum(int(r[3].sum()) for r in found) > 3000
    texts = ["a" * 900, "b" + "a" * 700 + "c", "ab" * 500, "xy" * 230, "abcdefg " * 60, "abcdefg " * 300 + "z" * 399, "z" * 400, "q" * 399]
    got = collected(suffix_dedup.suffix_dedup(frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)])))
    want = brute_repeats([t.encode() for t in texts], 400)
    assert [r["n_removed"] for r in sorted(got, key=lambda r: r["doc_id"])] == [sum(c) for c in want]


def test_long_words_differ_by_any_byte():
    a = b"x" * 70_000
    b = a[:68_000] + b"y" + a[68_001:]
    c = a[: 68_000 - 65_536] + b"y" + a[68_001 - 65_536 :]
    hashes = [int(hashing.word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in (a, b, c)]
    assert len(set(hashes)) == 3
