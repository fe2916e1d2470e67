"""Licence scan by a positional rare-token index, in DataFrame functions only.

The index maps each word of the licence templates to its postings: the templates that hold it and where. A file's own
licence words are weighed by their inverse document frequency over all scanned files; of each template the RARE words
that the file holds and that weigh most are looked up. Each place of such a word in the file, less its position in the
template, says where the template would begin; beginnings that two of the rare words share (one, if the file holds no
more) are kept, and the template's mandatory key phrase has to stand there word for word. The score is the share of the
template's words that stand in place, so notices with changed words are found, and score less.

Everything happens inside the row: no file is shuffled, and what is gathered is one count for each of the templates'
words. Files are cut into words once; those that do not hold all words of any phrase keep their counts only.

Base labels are found by their own phrases, each of which ends in ``license``.

Defined cases: null text counts as empty; a file without words has no places and no labels, ``first_word`` and
``last_word`` are null and the score is 0; repeated rows are scanned like others; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import ascii_lower, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, template, mandatory key phrase within it), all in lower-case words.
TEMPLATES = (
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "the apache license version 2"),
    ("apache", "you may not use this file except in compliance with the license", "use this file except in compliance"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
)
#: The wording of whole notices, as above.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
     "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
     "documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
     "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
     "gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     "for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
     "if a copy of the mpl was not distributed with this file"),
)
INDEXED = TEMPLATES + NOTICES
#: Words of a template that are looked up, and how many of them have to agree.
RARE, AGREE = 3, 2


def lower_words(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def index_rows() -> list[dict]:
    """Templates with their words and where their key phrase stands."""
    out = []
    for label, template, key in INDEXED:
        t, k = template.split(), key.split()
        out.append({"label": label, "words": t, "key_at": next(i for i in range(len(t)) if t[i : i + len(k)] == k), "key": k})
    return out


VOCABULARY = sorted({w for _, t, _ in INDEXED for w in t.split()})


def read_words(files: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per file: doc_id, n_words, the words of the templates that it holds, and all its words in order where it holds
    every word of some key phrase or base phrase: no other file can match, and few do. Stored, so that files are read
    and cut into words once for the counts and the look-ups."""
    cut = files.select(F.col(doc_id).alias("doc_id"), lower_words(F.col(text)).alias("all"))
    cut = cut.select("doc_id", "all", F.array_intersect("all", F.array(*map(F.lit, VOCABULARY))).alias("own"))
    phrases = dict.fromkeys([*(k for _, _, k in INDEXED), *BASE])
    may = [F.size(F.array_except(F.array(*map(F.lit, p.split())), F.col("own"))) == 0 for p in phrases]
    return stored(
        cut.select("doc_id", F.size("all").cast("long").alias("n_words"), "own", F.when(reduce(lambda a, b: a | b, may), F.col("all")).alias("w")), "licence-words"
    )


def rare_words(read: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every word of the templates, over all files."""
    hold = [F.count_if(F.array_contains("own", w)).alias(f"n{i}") for i, w in enumerate(VOCABULARY)]
    row = read.agg(F.count("*").alias("n"), *hold).first()
    return {w: math.log((1 + row["n"]) / (1 + row[f"n{i}"])) for i, w in enumerate(VOCABULARY)}


def places(words: Column, first: str) -> Column:
    """Positions of a word from 0."""
    return F.filter(F.transform(words, lambda x, i: F.when(x == first, i)), lambda i: i.isNotNull())


def stands(words: Column, start: Column, phrase: list[str] | Column) -> Column:
    """Whether the phrase's words stand from ``start`` on; false past either end."""
    phrase = F.array(*map(F.lit, phrase)) if isinstance(phrase, list) else phrase
    inside = (start >= 0) & (start + F.size(phrase) <= F.size(words))
    return F.when(inside, F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase).otherwise(False)


def phrase_places(words: Column, ends: Column, phrase: list[str]) -> Column:
    """Where the phrase starts, given where its last word stands."""
    starts = F.transform(ends, lambda e: e - (len(phrase) - 1))
    return F.filter(starts, lambda s: stands(words, s, phrase))


def template_matches(words: Column, own: Column, idf: dict[str, float]) -> Column:
    """array of struct(label, share): for each template of the index that stands in the file, the largest share of its
    words in place."""
    index = F.from_json(F.lit(json.dumps(index_rows())), "array<struct<label: string, words: array<string>, key_at: int, key: array<string>>>")
    weight = F.from_json(F.lit(json.dumps(idf)), "map<string, double>")
    # The file's licence words that some template may need, with their places: one pass over the file.
    hits = F.filter(F.transform(words, lambda x, i: F.when(x.isin(*VOCABULARY), F.struct(x.alias("word"), i.alias("at")))), lambda h: h.isNotNull())

    def of(template: Column, hits: Column) -> Column:
        postings = F.filter(F.transform(template["words"], lambda x, i: F.struct((-F.element_at(weight, x)).alias("w"), i.alias("i"), x.alias("word"))), lambda p: F.array_contains(own, p["word"]))
        rare = F.slice(F.array_sort(postings), 1, RARE)
        starts = lambda rare: F.flatten(F.transform(rare, lambda r: F.transform(F.filter(hits, lambda h: h["word"] == r["word"]), lambda h: h["at"] - r["i"])))
        agreed = lambda all_, rare: F.filter(F.array_distinct(all_), lambda s: (F.size(F.filter(all_, lambda q: q == s)) >= F.least(F.lit(AGREE), F.size(rare))) & stands(words, s + template["key_at"], template["key"]))
        share = lambda s: F.size(F.filter(F.transform(template["words"], lambda x, i: F.coalesce(F.get(words, s + i) == x, F.lit(False))), lambda ok: ok)) / F.size(template["words"])
        best = lambda rare: let(starts(rare), lambda all_: F.array_max(F.transform(agreed(all_, rare), share)))
        return F.struct(template["label"].alias("label"), let(rare, best).alias("share"))

    found = let(hits, lambda h: F.transform(index, lambda t: of(t, h)))
    return F.when(words.isNotNull(), F.filter(found, lambda x: x["share"].isNotNull())).otherwise(F.array().cast("array<struct<label: string, share: double>>"))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def licence_scan(files: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    read = read_words(files, text, doc_id)
    idf = rare_words(read)
    words, base = F.col("w"), read
    ends = F.when(F.array_contains(words, "license"), places(words, "license")).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("ends", ends)
    for phrase, label in BASE.items():
        base = base.withColumn(f"at_{label}", phrase_places(words, F.col("ends"), phrase.split()))
    base = base.withColumn("found", template_matches(words, F.col("own"), idf))
    at = F.concat(*[F.col(f"at_{x}") for x in BASE.values()])
    own = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, x) for x in BASE.values()]))
    more = F.transform("found", lambda x: x["label"])
    score = F.greatest(F.when(F.size(at) > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return base.select(
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, more))), ",").alias("labels"),
        score.alias("score"),
    )


def op9_licence_scan(spark, sf_dir: str) -> DataFrame:
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def scan_sql() -> str:
    """The same scan in DuckDB SQL: words as rows for the few words that a template's rarest one can be."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [f"({n}, '{r['label']}', {quoted(r['words'])}, {r['key_at']}, {quoted(r['key'])})" for n, r in enumerate(index_rows())]
    base = ",\n".join(
        f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {quoted(p.split())}) AS at_{label}" for p, label in BASE.items()
    )
    found = ", ".join(f"CASE WHEN len(at_{x}) > 0 THEN '{x}' END" for x in BASE.values())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) v(tid, label, words, key_at, key)),
v AS (SELECT DISTINCT unnest(words) AS word FROM t),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + (SELECT count(*) FROM d WHERE list_contains(w, word)))) AS idf FROM v),
p AS (SELECT tid, i, word FROM (SELECT tid, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM t)),
o AS (SELECT rid, word, at_ FROM (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS at_ FROM d) JOIN v USING (word)),
r AS (SELECT rid, tid, i, word, count(*) OVER (PARTITION BY rid, tid) AS n FROM (SELECT h.rid, p.tid, p.i, p.word, idf FROM (SELECT DISTINCT rid, word FROM o) h JOIN p USING (word) JOIN idf USING (word) QUALIFY row_number() OVER (PARTITION BY h.rid, p.tid ORDER BY idf DESC, p.i) <= {RARE})),
s AS (SELECT o.rid, r.tid, o.at_ - r.i AS s FROM o JOIN r ON o.rid = r.rid AND o.word = r.word GROUP BY ALL HAVING count(*) >= least({AGREE}, min(r.n))),
m AS (SELECT s.rid, s.tid, t.label, len(list_filter(range(0, len(t.words)), lambda i: s.s + i BETWEEN 0 AND len(d.w) - 1 AND d.w[s.s + i + 1] = t.words[i + 1])) / len(t.words) AS share
  FROM s JOIN t USING (tid) JOIN d USING (rid)
  WHERE s.s + key_at >= 0 AND s.s + key_at + len(key) <= len(d.w) AND d.w[s.s + key_at + 1:s.s + key_at + len(key)] = key),
g AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY rid),
b AS (SELECT rid, doc_id, len(w) AS n, {base} FROM d),
c AS (SELECT *, list_concat(list_concat({"), ".join(["at_mit, at_apache", "at_gpl"])}) AS places, list_filter([{found}], lambda x: x IS NOT NULL) AS own FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0 END, coalesce(share, 0)) AS score
FROM c LEFT JOIN g USING (rid)"""


OP9_SQL = scan_sql()
