"""Ranked search, personal data and whitening against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.helpers import collected, frame, rows
from pyspark.sql import functions as F

from foretide.llm import lexical, pii, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute_search(docs, items, top=10):
    """(item, rank, score, document) of every item, as the contract says it."""
    words = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, all_terms = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    out = []
    for item, text in items:
        scored = []
        for d, w in words:
            if w:
                m = 100 - 75 + (75 * sum(w.values()) * n_docs) // all_terms
                score = 0
                for t in terms(text):
                    df = sum(t in x for _, x in words)
                    if w[t]:
                        score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * w[t]) // (1000 * w[t] + 8 * m))
                if score > 0:
                    scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, -s, None if null else d) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("part, block", [(lexical.PART, lexical.BLOCK_TERMS), (40, 60)])
def test_search_is_brute_force(spark, part, block):
    """Ties, repeats, null ids and texts, one part or many, one block of items or many."""
    data = rows(60)
    items = [(1, data[5][1]), (2, None), (None, "Ab gh"), (3, ""), (4, data[10][1][:200].upper()), (4, "é 漢字 x"), (5, " ".join([data[3][1]] * 3)), (6, "nowhere")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "row_number": F.lit(2), "terms": F.lit(3)})
    got = lexical.ranked(frame(spark, data), table, part=part, block_terms=block)
    want = brute_search([(r[0], r[1]) for r in data], items)
    assert sorted([(r["item"], r["rank"], r["score"], r["doc"]) for r in collected(got)], key=str) == want and len(want) > 30


def test_search_cuts_long_texts_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice((1, 5, 130)))) for _ in range(200)).encode()
    pieces = list(lexical._pieces(text))
    assert b"".join(pieces) == text and len(pieces) > 20
    assert [w for p in pieces for w in terms(p.decode())] == terms(text.decode())


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(frame(spark, []), items).count() == 0
    assert lexical.ranked(frame(spark), items.limit(0)).columns == ["item", "rank", "doc", "score"]
    assert lexical.ranked(frame(spark), items.limit(0)).count() == 0


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    """Every word gets the same hash: bytes decide."""
    from foretide.llm import hashing

    monkeypatch.setattr(hashing, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    names = ["ab", "abc", "b", "cd", "é"]
    data = np.frombuffer("cd x ab é abd abc b".encode(), dtype=np.uint8)
    starts, ends = hashing.word_bounds(data, hashing.NOT_ALNUM)
    words, numbers = lexical.Vocabulary(names).find(data, starts, ends)
    assert sorted(zip(words.tolist(), numbers.tolist(), strict=True)) == [(0, 3), (2, 0), (3, 4), (5, 1), (6, 2)]


def brute_base(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            keep = (
                k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                or k == 2 and 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
                or k == 3 and 9 <= len(digits) <= 15
            )
            if keep:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def test_base_spans_are_the_patterns():
    rng, seen = random.Random(7), 0
    bits = ["a@b.c", "@", ".", "x_@d", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0132", "+", "(", ")", " ", "-", "7", "12", "é", "%", "+4915112345678", "\n", "b.co"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text
        seen += len(brute_base(text))
    assert seen > 3000
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000) == []


def personal(n=1500, seed=5):
    """Texts with personal data in the patterns' forms and in others, and clean ones with numbers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    words = lambda k: " ".join(word() for _ in range(k))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            out.append((f"{words(9)} please call +1 ({num(3)}) {num(3)}-{num(4)} {words(6)}", None))
        elif kind == 1:
            out.append((f"{words(9)} contact {word()}.{num(2)}@{word()}.example.com {words(6)}", None))
        elif kind == 2:
            out.append((f"{words(9)} host {rng.randint(1, 254)}.{rng.randint(1, 254)}.0.{rng.randint(1, 254)} {words(6)}", None))
        elif kind == 3 and i % 50 == 3:
            head, mail = f"{words(9)} contact ", f"{word()}.{num(2)} [at] {word()} [dot] example [dot] com"
            out.append((f"{head}{mail} {words(6)}", (0, len(head), len(head) + len(mail))))
        elif kind == 4 and i % 50 == 4:
            head, phone = f"{words(9)} please call ", f"({num(3)}) {num(3)}-{num(4)}"
            out.append((f"{head}{phone} {words(6)}", (3, len(head), len(head) + len(phone))))
        else:
            out.append((f"{words(9)} since {rng.randint(1990, 2020)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} version {num(1)}.{num(2)}.{num(3)} {words(6)}", None))
    return out


def test_trees_add_what_the_patterns_miss_and_nothing_to_clean_texts(spark):
    data = personal()
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(data)], "doc_id long, text string, spans string")
    caught = wrong = 0
    for r in collected(pii.personal_data(docs)):
        text, extra = data[r["id"]]
        base = [tuple(s) for s in r["base"]]
        spans = [tuple(s) for s in r["spans"]]
        assert base == brute_base(text) and set(base) <= set(spans)
        more = set(spans) - set(base)
        caught += extra in more
        wrong += bool(more - {extra})
    hidden = sum(e is not None for _, e in data)
    assert hidden == 60 and caught >= 0.8 * hidden and wrong <= 0.01 * len(data)


def test_personal_data_of_awkward_rows(spark):
    data = rows(60)
    found = pii.personal_data(frame(spark, data))
    assert found.count() == len(data) and found.filter("size(spans) > 0").count() == 0
    assert pii.personal_data(frame(spark, [])).count() == 0
    text = F.lit("to é.b@c.de or +1 (415) 555-0132.")
    spans = F.expr("array(struct(0 as kind, 4 as start, 11 as stop), struct(3 as kind, 15 as start, 32 as stop))")
    assert spark.range(1).select(pii.redacted(text, spans)).first()[0] == "to é[EMAIL] or [PHONE]."


def vectors(spark, n=300, dim=20, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * np.linspace(2, 0.2, dim)
    data = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim) @ mix]) for i in range(n)]
    data += [(n, data[0][1]), (None, data[1][1]), (n + 1, None), (n + 2, [None] * dim), (n + 3, [math.nan] * dim), (n + 4, [math.inf] * dim), (n + 5, []), (n + 6, [1.0])]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "x": F.lit(2), "component": F.lit(3)})


@pytest.mark.parametrize("components", [16, 20, 40])
def test_whitening_is_the_dense_decomposition(spark, components):
    data, table = vectors(spark)
    got = collected(whitening.whitened(table, components))
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in data if v and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in xs}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array(n * fit - s, dtype=float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, 20)
    assert len(got) == len(xs) * k and {r["n"] for r in got} == {n} and n == 300
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    by = {}
    for i, x in xs:
        c = np.array([float(n * a - b) / n for a, b in zip(x, s, strict=True)])
        by.setdefault(i, []).append((sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), c @ u / np.sqrt(e)))
    sign = {}
    for r in got:
        deviation, w = by[r["vec_id"]][0]
        assert r["deviation"] == deviation
        j = r["component"] - 1
        assert abs(abs(w[j]) - abs(r["whitened"])) < 1e-8 and abs(r["explained"] / (e[j] / e.sum()) - 1) < 1e-10
        if abs(w[j]) > 1e-6:
            assert sign.setdefault(j, np.sign(w[j] * r["whitened"])) == np.sign(w[j] * r["whitened"])


def test_jacobi_davidson_of_clusters_and_deficient_matrices():
    rng = np.random.default_rng(4)
    for e in (np.r_[np.full(10, 5.0), np.linspace(4.999, 1, 90)], np.r_[9.0, 8.0, np.zeros(98)], np.zeros(100), np.r_[1e6, np.full(99, 1.0)], np.logspace(0, -9, 100)):
        q, _ = np.linalg.qr(rng.standard_normal((100, 100)))
        a = q * e @ q.T
        values, u = whitening.leading(lambda v, a=a: a @ v, 100, 16)
        assert np.allclose(values, np.sort(e)[::-1][:16], rtol=0, atol=1e-11 * max(e.max(), 1e-300)) and np.allclose(u.T @ u, np.eye(16), atol=1e-12)
        assert np.linalg.norm(a @ u - u * values, axis=0).max() <= 2.0**-38 * e.max()


def test_whitening_without_spread(spark):
    _, table = vectors(spark, 3, 4)
    assert whitening.whitened(table.filter("vec_id > 1000")).count() == 0
    one = collected(whitening.whitened(table.filter("vec_id in (0, 3)")))
    assert len(one) == 8 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in one)
    few = collected(whitening.whitened(table))
    assert {r["component"] for r in few if r["whitened"] is not None} == {1, 2} and few[0]["identity_error"] < 1e-10
    wide = spark.createDataFrame([(1, [2.0**45, 0.0]), (2, [-(2.0**45), 0.0]), (3, [2.0**60, 0.0])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["deviation"]) for r in collected(whitening.whitened(wide))} == {(1, None), (2, None)}
