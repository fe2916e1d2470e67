"""Personal data: fixed base patterns, and spans that boosted trees add from overlapping candidates.

One pass over the texts finds the base spans and, with wide generators, everything of their kinds that may be meant: numbers
without a plus, with a trunk zero or split by dots, addresses that spell out @ and dot, card numbers in other groupings.
A candidate carries counts of its format and cues of the words around it, none of its characters. Spark's gradient boosted
trees learn from a bounded sample of the corpus: base spans and the same spans rewritten in place in a form that
the patterns miss are examples; dates, versions, prices and numbers of things put in the place of a span are
counter-examples. Candidates that the patterns refuse count as such too in a first fit; those that it finds about as likely as
examples may be personal data in another form, so the second fit leaves them out. Scores are calibrated on a held-out part by isotonic regression, each
kind's threshold is the least calibrated score of a half or more from which on the held-out precision is ``PRECISION``; a kind without one
adds nothing. Of overlapping candidates above it the likeliest stays, then the longest, then the first. Base spans
always stay, and candidates that overlap one add nothing.

Defined cases: a null text is an empty one. Repeated documents each have a row, null ids stay. Where the sample holds fewer
than ``LEAST`` base spans, nothing is learnt and nothing added. An empty table gives an empty one. Texts of any length are
read whole. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Documents that are learnt from at most, about, and candidates of each of them; base spans that are needed.
SAMPLE, EACH, LEAST = 6000, 20, 40
#: Held-out precision that a threshold has to reach, and held-out candidates above it at least.
PRECISION, ABOVE = 0.97, 15
TREES, DEPTH = 20, 4
#: A refused candidate is left out from the score that all but a twentieth of the examples reach, and from this one at least.
UNSURE = 0.25
#: Characters on either side whose words count as context.
AROUND = 32
SCAN = "id {kind}, base array<struct<kind:int,start:int,stop:int>>, more array<struct<kind:int,start:int,stop:int,features:array<double>>>, drawn long, examples array<struct<kind:int,label:int,features:array<double>>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators. A local part has at most 64 characters where @ is spelt out.
SPELT = re.compile(r"(?i)(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s(?:at|@)\s|(?<=[\w])\s?@\s?)")
SPELT_DOMAIN = re.compile(r"(?i)[a-z0-9-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\.)[a-z0-9-]{1,63}){1,8}")
NUMBER = re.compile(r"(?<![0-9])\(?[0-9]++\)?(?:[ .\-/]{1,2}\(?[0-9]++\)?){0,12}")
ANY = re.compile(r"[0-9@]| (?:at|AT|At) |[\[({] ?(?:at|AT)")
CUES = (
    re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|dial|ring|text me|whatsapp|sms|teléfono|telefon|téléphone|handy|rufnummer)\b"),
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cvv|tarjeta|carte|karte)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|address|login|ping|subnet|gateway)\b"),
    re.compile(r"(?i)\b(?:version|release|isbn|order|invoice|price|total|page|date|since|until|id|no|ref|section|chapter|year|v)\b[.:#]?"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with the run of characters before it that no earlier match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) that may be personal data; spans overlap."""
    for m in SPELT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        host = SPELT_DOMAIN.match(text, m.end()) if start < m.start() else None
        if host:
            yield 0, start, host.end()
    for m in NUMBER.finditer(text):
        start, end = m.span()
        if text[start] == "(" and ")" not in m[0]:
            start += 1
        if text[end - 1] == ")" and "(" not in m[0]:
            end -= 1
        digits = _digits(text[start:end])
        plus = start > 0 and text[start - 1] == "+"
        if 7 <= len(digits) <= 15:
            yield 3, start - plus, end
        if 12 <= len(digits) <= 19:
            yield 2, start, end
        parts = re.split(r"[ .\-/()]+", m[0].strip("()"))
        if len(parts) == 4 and all(len(p) <= 3 for p in parts):
            yield 1, start, end


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span as small numbers; no character of it as such."""
    s, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits, groups = _digits(s), re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    heads = [int(g[:6]) for g in groups] or [0]
    # Years, months and days in their places; a price or a share beside it.
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    small = len(groups) >= 3 and all(h <= 31 for h, n in zip(heads[1:3], sizes[1:3], strict=True) if n <= 2) and max(sizes[1:3]) <= 2
    before, after = left[-1:], right[:1]
    klass = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "$€£#%=:/" else 5
    host = re.findall(r"[a-z]+$", s.lower())
    out = [
        kind, min(len(s), 80), len(digits), min(len(groups), 12), min(sizes), max(sizes), sizes[0], sizes[-1], s.startswith("+"), s.startswith(("(", "0(")), s.startswith("0"),
        s.count(" "), s.count("."), s.count("-"), s.count("/"), s.count("("), luhn(digits) if digits else 0, max(heads) <= 255, year, small,
        "@" in s, bool(re.search(r"(?i)[\[({]\s?(?:at|dot)", s)), bool(re.search(r"(?i)\sdot\s", s)), len(host[0]) if host else 0, sum(c.isspace() for c in s.strip()),
        klass(before), klass(after), left[-2:-1].isdigit(),
    ]
    for cue in CUES:
        near = [m.end() for m in cue.finditer(left)]
        out.append(0 if not near else 1 + (len(left) - near[-1]) // 8)
        out.append(bool(cue.search(right)))
    return [float(x) for x in out]


def rewritten(kind: int, s: str, draw: int) -> tuple[str, str]:
    """(the span in a form that its pattern misses, something else that looks alike), chosen by ``draw``."""
    digits = _digits(s) or "2024"
    d = (digits * 16)[:16]
    if kind == 0:
        name, _, host = s.partition("@")
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" (at) ", " (dot) "))[draw % 5]
        return name + at + host.replace(".", dot), (f"{host.split('.')[0]} at {host}", f"{name} @ {d[:2]}")[draw % 2]
    if kind == 1:
        return s.replace(".", " . " if draw % 2 else "-"), (f"{int(d[0])}.{int(d[1])}.{int(d[2:4])}", f"{d[:3]}.{d[3:6]}.{d[6:9]},{d[9:11]}")[draw % 2]
    if kind == 2:
        return ("/".join if draw % 2 else ".".join)([d[i : i + 4] for i in range(0, 16, 4)]), f"978-{d[:1]}-{d[1:5]}-{d[5:9]}-{d[9]}" if draw % 2 else f"{d[:8]}{d[:4]}"
    n = (digits * 2)[-10:]
    forms = (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"00{digits[:2]} {n[:3]} {n[3:6]} {n[6:]}", f"0{n[:2]} {n[2:6]} {n[6:]}")
    year, month, day = 1970 + int(n[:2]) % 60, 1 + int(n[2:4]) % 12, 1 + int(n[4:6]) % 28
    others = (f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{n[:1]}.{n[1:3]}.{n[3:6]}.{n[6:]}", f"{n[:1]},{n[1:4]},{n[4:7]}", f"{year}{month:02}{day:02} {n[:2]}{n[2:4]}")
    return forms[draw % 5], others[draw // 5 % 5]


def _scan(batches, share: float):
    """Each text's base spans, its candidates, and, for ``share`` of the texts, what is learnt from it."""
    import pyarrow as pa

    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    candidate = pa.struct([*span, pa.field("features", pa.list_(pa.float64()))])
    example = pa.struct([("kind", pa.int32()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])
    for batch in batches:
        base_of, more_of, drawn_of, learnt_of = [], [], [], []
        texts = batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            base, more, drawn, learnt = [], [], 0, []
            if ANY.search(text):
                base = base_spans(text)
                taken = sorted((s, e) for _, s, e in base)
                merged: list[list[int]] = []
                for s, e in taken:
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at = 0
                for kind, s, e in sorted(set(proposals(text)), key=lambda c: (c[1], c[2], c[0])):
                    while at < len(merged) and merged[at][1] <= s:
                        at += 1
                    if at == len(merged) or merged[at][0] >= e:
                        more.append({"kind": kind, "start": s, "stop": e, "features": features(text, kind, s, e)})
                drawn = zlib.crc32(text.encode())
                if drawn < share * 2**32:
                    learnt = [{"kind": c["kind"], "label": -1, "features": c["features"]} for c in more[:: max(1, len(more) // EACH)]]
                    for j, (kind, s, e) in enumerate(base[:: max(1, len(base) // EACH)]):
                        learnt.append({"kind": kind, "label": 1, "features": features(text, kind, s, e)})
                        for label, form in zip((1, 0), rewritten(kind, text[s:e], drawn // 7 + j), strict=True):
                            put = text[max(0, s - 2 * AROUND) : s] + form + text[e : e + 2 * AROUND]
                            where = min(s, 2 * AROUND)
                            for k, a, b in set(proposals(put)):
                                if a < where + len(form) and where < b:
                                    hit = label and k == kind and a == where and b == where + len(form)
                                    learnt.append({"kind": k, "label": int(hit), "features": features(put, k, a, b)})
            base_of.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
            more_of.append(more)
            drawn_of.append(drawn)
            learnt_of.append(learnt)
        columns = [batch.column("id"), pa.array(base_of, pa.list_(span)), pa.array(more_of, pa.list_(candidate)), pa.array(drawn_of, pa.int64()), pa.array(learnt_of, pa.list_(example))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "base", "more", "drawn", "examples"])


def learnt(examples: DataFrame):
    """(boosted trees, isotonic calibration, threshold of each kind) of labelled examples, or None where there are too few
    of either label. A fifth of the texts is held out of the trees for the calibration."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    # The sample is bounded: one ordered partition, so that trees do not depend on how it was read.
    e = stored(examples.distinct().repartition(1).sortWithinPartitions("drawn", "kind", "label", "features"), "examples")
    counts = {r["label"]: r["count"] for r in e.groupBy((F.col("label") == 1).cast("int").alias("label")).count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < LEAST:
        return None
    e = e.withColumns({"x": array_to_vector("features"), "held": F.col("drawn") % 5 == 0, "y": (F.col("label") == 1).cast("double")})
    boosted = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=12)
    p = vector_to_array("probability")[1].alias("p")
    first = boosted.fit(e).transform(e).select("drawn", "held", "kind", "label", "y", "x", p)
    common = first.filter("label = 1").agg(F.expr("percentile(p, 0.05)")).first()[0]
    e = stored(first.filter((F.col("label") >= 0) | (F.col("p") < max(common, UNSURE))).drop("p"), "examples")
    trees = boosted.fit(e.filter("not held"))
    scored = stored(trees.transform(e.filter("held")).select("kind", F.col("y").alias("label"), p), "held")
    if scored.filter("label = 1").isEmpty():
        return None
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored)
    fine = calibration.transform(scored).groupBy("kind", F.round("prediction", 6).alias("c")).agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("c"))
    good = fine.withColumns({"h": F.sum("hits").over(above), "m": F.sum("n").over(above)}).filter((F.col("c") >= 0.5) & (F.col("m") >= ABOVE) & (F.col("h") >= PRECISION * F.col("m")))
    thresholds = {r["kind"]: r["c"] for r in good.groupBy("kind").agg(F.min("c").alias("c")).collect()}
    return trees, calibration, thresholds


def added(scan: DataFrame, model, row: str) -> DataFrame:
    """(row, spans) of the candidates that pass their kind's threshold and no likelier one overlaps."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    trees, calibration, thresholds = model
    c = scan.select(row, F.explode("more").alias("c")).select(row, "c.*").withColumn("x", array_to_vector("features"))
    c = trees.transform(c).select(row, "kind", "start", "stop", vector_to_array("probability")[1].alias("p"))
    c = calibration.transform(c)
    least = F.create_map(*[F.lit(v) for k, t in thresholds.items() for v in (k, t)])[F.col("kind")]
    c = c.filter(F.round("prediction", 6) >= least)
    # Overlapping candidates form runs; a run's best is kept, and the rest of the run competes no more.
    order = Window.partitionBy(row).orderBy("start", "stop", "kind")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("run", F.sum((F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")).over(order))
    c = c.withColumns({"best": F.row_number().over(Window.partitionBy(row, "run").orderBy(F.desc("p"), F.desc(F.col("stop") - F.col("start")), "start", "kind"))})
    return c.filter("best = 1").groupBy(row).agg(F.collect_list(F.struct("kind", "start", "stop")).alias("plus"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, base, spans): arrays of (kind number, start, stop) of each document, by start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    row = "row_number"
    scan = stored(frame.mapInArrow(lambda batches: _scan(batches, share), SCAN.format(kind=kind)).withColumn(row, F.monotonically_increasing_id()), "spans")
    examples = scan.filter(F.size("examples") > 0).select("drawn", F.explode("examples").alias("e")).select("drawn", "e.*")
    model = learnt(examples)
    if model is None or not model[2]:
        return scan.select("id", "base", F.col("base").alias("spans"))
    both = scan.select(row, "id", "base").join(added(scan.filter(F.size("more") > 0), model, row), row, "left")
    key = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("plus", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))), key))
    return both.select("id", "base", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def redacted(text: F.Column, spans: F.Column) -> F.Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first to start stands for all."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        new = x["start"] >= s["at"]
        put = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.when(new, put).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["stop"]).alias("at"))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0)))))


def listed(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
