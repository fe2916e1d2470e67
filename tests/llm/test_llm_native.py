"""Exact dedup, mixing, licences and sharding against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm.helpers import collected, frame, rows
from pyspark.sql import functions as F

from foretide.llm import exact_dedup, licences, mixing, sharding

WS = re.compile(r"[\x20\x09-\x0D]")


def test_exact_dedup(spark):
    data = rows()
    got = collected(exact_dedup.exact_dedup(frame(spark, data)))
    assert len(got) == len(data)
    groups = collections.defaultdict(list)
    for r in data:
        groups[WS.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] if r[0] is not None else 0))
    want = collections.Counter()
    for norm, members in groups.items():
        _, null, keep = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for m in members:
            want[(None if m[1] else m[2], None if null else keep, len(members), sha)] += 1
    assert want == collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_chunks_cover_the_text_and_settle_after_an_edit(spark):
    text = "".join(r[1] or "" for r in rows(400))
    both = frame(spark, [(1, text, *[None] * 11), (2, "zzz" + text, *[None] * 11)])
    a, b = [r["digests"] for r in sorted(collected(exact_dedup.chunked(both)), key=lambda r: r["doc_id"])]
    assert sum(d["len"] for d in a) == len(WS.sub("", text))
    assert len({d["sha"] for d in a} & {d["sha"] for d in map(lambda x: x, b)}) >= len(a) // 2


def water_fill(sizes, weights, most):
    total, target, open_ = sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(t for t in target if t is not None)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            return target
        for i in full:
            target[i] = most * sizes[i]
        open_ -= full
    return target


def test_mixing(spark):
    data = rows(300)
    docs = frame(spark, data)
    documents, draws = mixing.mix(docs)
    documents, draws = collected(documents), collected(draws)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.defaultdict(int)
    for r in data:
        by[r[3]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_fill([by[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    assert len(documents) == len(data)
    seen = collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in documents)
    assert seen == collections.Counter((r[0], size(r[1]), by[r[3]], round(want[r[3]], 6)) for r in data)
    rid = {r["rid"]: r for r in documents}
    taken = collections.Counter()
    for d in draws:
        taken[rid[d["rid"]]["source_size"]] += d["size"]
    target = {r["source_size"]: r["target"] for r in documents}
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(12, 0.01 * t), (s, t, taken[s])
    assert max(collections.Counter(d["rid"] for d in draws).values()) <= 3
    slots = collections.defaultdict(set)
    for d in draws:
        slots[d["out_shard"]].add(d["out_slot"])
    assert all(s == set(range(len(s))) for s in slots.values())
    again = collected(mixing.mix(docs)[1])
    assert sorted(map(str, again)) == sorted(map(str, draws))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == len(draws)


def test_mixed_rows_come_by_shard_and_slot(spark, tmp_path, monkeypatch):
    """Rows are written by shard and slot, also where a shard takes several tasks, and op6 has documents by first place."""
    data = [(i, *r[1:]) for i, r in enumerate(rows(300))]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    documents, draws = mixing.mix(docs)
    by_rid = {r["rid"]: r["doc_id"] for r in collected(documents)}
    want = [by_rid[d["rid"]] for d in sorted(collected(draws), key=lambda d: (d["out_shard"], d["out_slot"]))]
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    assert [r["doc_id"] for r in collected(mixing.mixed(docs))] == want
    mixing.mixed(docs).write.parquet(f"{tmp_path}/mixed")
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    assert [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()] == want and len(files) > 8
    got = collected(mixing.op6_mixing(spark, str(tmp_path)))
    first = list(dict.fromkeys(want))
    assert [r["doc_id"] for r in got][: len(first)] == first
    assert {r["doc_id"] for r in got[len(first) :]} == set(range(len(data))) - set(first)
    assert all(bool(r["copies"]) == (i < len(first)) for i, r in enumerate(got))


def test_targets_stop_at_three_times_the_source(spark):
    sizes = [5, 1000, 300, 0, 40]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in collected(mixing.targets(df))}
    want = water_fill(sizes, [5, 2, 1, 5, 2], 3)
    assert [round(got[f"s{i}"], 6) for i in range(5)] == [round(x, 6) for x in want]


def test_splitting_tree_is_exact_and_unbiased():
    quota = mixing.splitting_tree([100, 7, 0, 1000], 8, 3)
    assert quota.sum(axis=0).tolist() == [100, 7, 0, 1000] and (quota >= 0).all()
    assert max(quota.sum(axis=1)) - min(quota.sum(axis=1)) <= 2
    mean = np.mean([mixing.splitting_tree([80, 40], 4, s) for s in range(300)], axis=0)
    assert abs(mean - [[20, 10]] * 4).max() < 1


def test_mixing_of_nothing(spark):
    documents, draws = mixing.mix(frame(spark, []))
    assert documents.count() == draws.count() == 0


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_licence_scan(spark):
    lines = [
        "Released under the MIT License. mit license MIT-license", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "license", "mit", "general public license " * 3, "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "the mit x license", "été mit license", None, "", "under cc by sa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    data = rows(20) + [(1000 + i, t, *[None] * 11) for i, t in enumerate(lines)]
    got = collected(licences.licence_scan(frame(spark, data)))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = collections.Counter()
    for r in data:
        w = word.findall((r[1] or "").translate(lower))
        at = {label: places(w, p.split()) for p, label in licences.BASE.items()}
        all_ = sorted(x for v in at.values() for x in v)
        want[(r[0], len(w), len(all_), all_[0] if all_ else None, all_[-1] if all_ else None, ",".join(sorted(k for k, v in at.items() if v)))] += 1
    assert want == collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[1000] == ("mit", 1.0) and labels[1001] == ("apache", 1.0) and labels[1002][0] == "gpl"
    assert labels[1003] == ("cc-by-nc", 1.0) and labels[1007] == ("bsd", 1.0) and labels[1013][0] == "mit"
    assert labels[1008] == ("", 0.0) and labels[1012] == ("cc-by-sa", 4 / 7) and labels[1009] == ("mit", 0.5)
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_notices_with_changed_words_are_found_and_score_less(spark):
    """Which words are looked up follows the file, not what other files lack."""
    mit = next(t for label, t, _ in licences.NOTICES if label == "mit").split()
    changed = [w if w not in ("obtaining", "substantial") else "xx" for w in mit]
    texts = [" ".join(mit), "head " + " ".join(changed) + " tail", " ".join(mit[:20]), "Redistribution and use in source and binary forms are allowed", " ".join(reversed(mit))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in collected(licences.licence_scan(frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)])))}
    assert got[0] == ("mit", 1.0) and got[1] == ("mit", (len(mit) - 2) / len(mit)) and got[2][0] == "mit"
    assert got[3][0] == "bsd" and 0 < got[3][1] < 1 and got[4] == ("", 0.0)


@pytest.mark.parametrize("parts", [1, 4])
def test_sharding(spark, parts):
    data = rows(200)
    got = collected(sharding.shard(frame(spark, data, parts)))
    assert len(got) == len(data)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


@pytest.mark.parametrize("most", [100_000, 7])
def test_sharding_equals_a_plain_shuffle(spark, monkeypatch, most):
    """The same partitions, matrix and permutations dealt row by row."""
    monkeypatch.setattr(sharding, "RUN_ROWS", most)
    docs = frame(spark, rows(150), 4)
    rid = F.monotonically_increasing_id()
    ids = [tuple(r) for r in docs.select(rid, "doc_id", F.xxhash64(F.lit(21), rid)).collect()]
    parts = collections.defaultdict(list)
    for i, doc, h in ids:
        parts[i >> 33].append((i, doc, h))
    have = [len(parts[k]) for k in sorted(parts)]
    want = [len(ids) // 8 + (s < len(ids) % 8) for s in range(8)]
    matrix = sharding.communication_matrix(have, want, 20)
    shards = collections.defaultdict(list)
    for p, k in enumerate(sorted(parts)):
        order = np.random.default_rng([20, p]).permutation(have[p])
        to = [s for s, n in enumerate(matrix[p]) for _ in range(n)]
        for at, (i, doc, h) in enumerate(parts[k]):
            shards[to[order[at]]].append((i, doc, h))
    runs = max(1, -(-max(want) // most))
    run = lambda h: (h % (1 << 64) >> 33) * runs >> 31
    wanted = {(i, doc, s, n) for s, own in shards.items() for n, (i, doc, h) in enumerate(sorted(own, key=lambda x: (run(x[2]), x[2], x[0])))}
    got = {(doc, r["shard"], r["slot"]) for r in collected(sharding.shard(docs)) for doc in [r["doc_id"]]}
    assert got == {(doc, s, n) for _, doc, s, n in wanted} and len(got) == len(ids)


def test_sharded_rows_keep_their_columns(spark):
    docs = frame(spark, rows(60))
    out = sharding.sharded(docs)
    assert out.columns == [*docs.columns, "out_shard", "slot"]
    assert collections.Counter(map(str, collected(out.select(docs.columns)))) == collections.Counter(map(str, collected(docs)))
    assert out.select("out_shard", "slot").distinct().count() == docs.count()
    assert sharding.sharded(frame(spark, [])).count() == 0


def test_draws_past_the_range_follow_the_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((10, 3_000_000_000, 1_500_000_000), (2_000_000_000, 1_000_000_000, 30), (5_000_000_000, 5_000_000_000, 4_000_000_000)):
        got = np.array([sharding.draw(rng, good, bad, n) for _ in range(2000)], dtype=float)
        p, all_ = good / (good + bad), good + bad
        sd = (n * p * (1 - p) * (all_ - n) / (all_ - 1)) ** 0.5
        assert abs(got.mean() - n * p) < 5 * sd / 2000**0.5 and 0.9 < got.std() / sd < 1.1 and got.min() >= max(0, n - bad) and got.max() <= min(good, n)


def test_sharding_of_nothing(spark):
    assert sharding.shard(frame(spark, [])).count() == 0


def test_communication_matrix_has_exact_margins_and_the_hypergeometric_mean():
    have, want = [10, 0, 25, 5], [13, 13, 14]
    draws = np.array([sharding.communication_matrix(have, want, s) for s in range(400)])
    assert (draws.sum(axis=2) == have).all() and (draws.sum(axis=1) == want).all() and (draws >= 0).all()
    assert abs(draws.mean(axis=0) - np.outer(have, want) / 40).max() < 0.4


def test_stored_tables_can_be_cleared(spark):
    from foretide.llm import common

    common.clear(spark)
    df = common.stored(frame(spark), "t")
    assert df.count() == len(rows()) and df.columns == frame(spark).columns
    assert common.clear(spark) == 1 and common.clear(spark) == 0


@pytest.mark.parametrize("most", [100_000, 7])
def test_columns_of_the_operators_own_names_come_through(spark, monkeypatch, most):
    """Names that sharding and mixing use themselves, in any letter case, with the rows' own values."""
    monkeypatch.setattr(sharding, "RUN_ROWS", most)
    names = ["__block", "__run", "__nth", "__start", "row_number_shard", "row_number", "Block", "run", "nth", "start", "own_shard", "Slot", "out_shard", "out_slot", "rid", "before", "n"]
    docs = frame(spark, rows(60)).drop("shard")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names if c != "rid"})
    for out in (sharding.sharded(docs), mixing.mixed(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns
        for r in out.select(docs.columns).collect():
            assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in names if c != "rid")
    out = sharding.sharded(docs)
    assert len(out.columns) == len(docs.columns) + 2 and collections.Counter(map(str, collected(out.select(docs.columns)))) == collections.Counter(map(str, collected(docs)))


def test_the_sql_of_the_mix_counts_words_by_all_six_blanks(spark, tmp_path):
    import duckdb

    data = [(i, f"a{c}b{c}{c}c", "en", f"s{i % 2}", 3, *["?"] * 8) for i, c in enumerate(" \t\n\x0b\x0c\r\x1f\x85")] + [(8, None, "en", "s0", 0, *["?"] * 8)]
    frame(spark, data, 1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP6_SQL).fetchall()
    got = mixing.op6_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r["doc_id"]: r["size"] for r in got} == {**dict.fromkeys(range(6), 3), 6: 1, 7: 1, 8: 0}
