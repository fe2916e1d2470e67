"""Small tables with every awkward row: nulls in any column, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *[T.StructField(c, T.StringType()) for c in ("rid", "key", "score", "shard", "fp", "block", "size", "own")],
    ]
)


def rows(n: int = 60, seed: int = 1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = sentence(90), []
    for i in range(n):
        text = sentence(rng.randint(1, 120))
        if i % 5 == 0:
            text = f"{sentence(20)} {passage}\n{sentence(15)}"
        if i % 7 == 0 and out:
            text = out[rng.randrange(len(out))][1] or ""
        if i % 11 == 0:
            text = text.upper() + "!! " + sentence(3)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (None, sentence(40)), (None, None)]
    out += [(n + 3, passage), (n + 3, passage), (n + 4, " ".join([sentence(200)] * 20)), (n + 5, "x" * 3000), (n + 6, "é ü 漢字 " * 150)]
    out += [(n + 7, passage.replace(" ", "  ")), (n + 8, passage + " ")]
    return [
        (i, t, None if k % 9 == 4 else "en", None if k % 13 == 5 else f"s{k % 4}", None if t is None else len(t), *["?"] * 8)
        for k, (i, t) in enumerate(out)
    ]


def frame(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).coalesce(parts)


def collected(df):
    return [r.asDict() for r in df.collect()]
