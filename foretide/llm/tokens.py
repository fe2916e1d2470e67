"""Token-id output: documents as compressed frames of token ids under one trained zstandard dictionary.

Encoding runs once, where the text is read. A document's ids (16 bits each where the vocabulary fits, else 32) become
one zstandard frame of its own, made with a dictionary trained on a bounded sample of serialised id arrays, and only
frames move: by range of doc_id into the parts of the output. The output folder holds

* ``frames/part=K``  doc_id, frame, n_tokens, in ascending doc_id order within the part and from part to part;
* ``index``          doc_id, part, nth (place in the part), start (ids before it), n_tokens, dict_sha256;
* ``meta``           dictionary bytes, their SHA-256, bytes per id, end id, format version.

A document is read by its index row alone: one frame, the dictionary whose hash the index names, its offset. Parts are
written by Spark's committer, so a lost executor costs its tasks only.

Defined cases: null and empty texts have the end id only; null ids come first, and equal ids in the order of their
text's hash; an empty table gives an output of no frames; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from string import punctuation

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm.common import shared_dir, stored, text_batches

#: Documents whose ids train the dictionary (the least in the order of a hash of their id), the dictionary's size.
SAMPLE, DICT_BYTES, LEVEL = 500, 64 << 10, 3
#: Of a document in that sample: ids of a piece, and most pieces, taken evenly from its whole length.
PIECE_IDS, MOST_PIECES = 1024, 8
#: Documents and bytes of frames that a part of the output holds.
PART_ROWS, PART_BYTES = 25_000, 16 << 20
END_ID = 0
#: Chunks of text whose ids a worker remembers, some 100 MB.
CACHE = 500_000
#: Bytes of text whose chunks are told apart together.
TEXTS = 4 << 20
#: The pre-tokenizer's pattern (fixed value): pieces are encoded each by itself, which is what makes a cache exact.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def _byte_characters() -> dict[int, str]:
    """The visible character that a byte-level vocabulary writes for each byte: printable Latin-1 ones stand for
    themselves, all others follow from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_VISIBLE = _byte_characters()


class Pieces(dict):
    """Serialised ids of pieces of the pattern, encoded by the library's model when first looked up."""

    def __init__(self, tokenizer, kind: str) -> None:
        self.tokenize, self.kind = tokenizer.model.tokenize, kind

    def encode(self, p: str) -> bytes:
        # Of printable ASCII only the space is written by another character.
        plain = p.isascii() and p.isprintable()
        shown = p.replace(" ", _VISIBLE[32]) if plain else p.encode().decode("latin-1").translate(_VISIBLE)
        return array(self.kind, [x.id for x in self.tokenize(shown)]).tobytes()

    def __missing__(self, p: str) -> bytes:
        self[p] = ids = self.encode(p)
        return ids


class Chunks(dict):
    """Serialised ids of chunks: what stands between single spaces, with the space before it, or, where it begins with
    a line break, with that instead. A piece never reaches over the edge of a chunk that has no white space there; any
    other chunk has None, and the text is cut by the pattern as a whole."""

    def __init__(self, pieces: Pieces, find) -> None:
        self.pieces, self.find = pieces, find
        self.line = pieces["\n"]

    def __missing__(self, c: str) -> bytes | None:
        base = c.rstrip(punctuation)
        # Letters are one piece; letters and the signs that follow are two, of which the signs have no space before them.
        if base.isalpha():
            if len(base) == len(c):
                ids = self.pieces.encode(" " + c)
            else:
                ids = self[base] + self.pieces[c[len(base) :]]
        else:
            first = c[:1] == "\n"
            word = c[1:] if first else c
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            pieces = self.pieces
            ids = (self.line if first else b"") + b"".join([pieces[p] for p in self.find(word if first else " " + word)])
        self[c] = ids
        return ids


class Encoder:
    """The tokenizers library behind a cache of chunks: each distinct chunk is encoded once in a worker.

    With ``added`` the ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: where an added token's
    content stands in a text, it gets its own id. Without, special ones among them are plain text."""

    def __init__(self, path: str, added: bool = False) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4
        kind = "H" if self.width == 2 else "I"
        #: Only this pre-tokenizer is known to cut at the pattern; any other encodes whole texts.
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not conf.get("normalizer")
        self.find = regex.compile(PIECES).findall
        #: The model knows nothing of added tokens: texts that hold one go to the library as a whole.
        self.marks = [x["content"] for x in conf.get("added_tokens") or [] if added or not x.get("special")]
        self.end = array(kind, [END_ID]).tobytes()
        if self.by_piece:
            self.pieces = Pieces(self.tokenizer, kind)
            self.chunks = Chunks(self.pieces, self.find)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        kind = np.uint16 if self.width == 2 else np.uint32
        if not self.by_piece:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array([*e.ids, END_ID], dtype=kind) for e in found]
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHE:
                cache.clear()
        piece, out = self.pieces.__getitem__, []
        flat, starts, ends, whole = self._by_chunks(texts, kind)
        end = np.array([END_ID], dtype=kind)
        for t, a, b, known in zip(texts, starts.tolist(), ends.tolist(), whole.tolist(), strict=True):
            if any(m in t for m in self.marks):
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=kind)
            elif known:
                ids = flat[a:b]
            else:
                ids = np.frombuffer(b"".join(map(piece, self.find(t))), dtype=kind)
            out.append(np.concatenate((ids, end)))
        return out

    def _by_chunks(self, texts: list[str], kind) -> tuple[np.ndarray, ...]:
        """(ids of all texts one after the other, where each text's begin and end, which texts are whole in them: those
        without a chunk that has no ids of its own). Each distinct chunk of the texts is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # As if on a new line, whose id is left out again; the empty chunk before it is passed over.
        lines = pa.array(["\n" + t for t in texts], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        edges = cut.offsets.to_numpy().astype(np.int64)
        distinct = cut.values.dictionary_encode()
        # No chunk holds a space, so the distinct ones are read as one string and cut again.
        chunks = pa.ListArray.from_arrays(pa.array([0, len(distinct.dictionary)], pa.int32()), distinct.dictionary)
        chunks = pc.binary_join(chunks, pa.scalar(" ", pa.large_string()))[0].as_py()
        found = pa.array(map(self.chunks.__getitem__, chunks.split(" ")), pa.large_binary()).take(distinct.indices)
        _, places, raw = found.buffers()
        upto = np.frombuffer(places, dtype=np.int64)[: len(found) + 1] // self.width
        flat = np.frombuffer(raw, dtype=kind, count=upto[-1]) if upto[-1] else np.zeros(0, dtype=kind)
        failed = np.concatenate(([0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))))
        return flat, upto[edges[:-1]] + len(self.chunks.line) // self.width, upto[edges[1:]], failed[edges[1:]] == failed[edges[:-1] + 1]


def encoder(path: str, added: bool = False) -> Encoder:
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


def _ids(path: str, batch, added: bool, column: str = "text"):
    for at, texts in text_batches(batch.column(column), TEXTS):
        yield at, encoder(path, added).encode([t.decode("utf-8", "replace") for t in texts])


def spread(ids: np.ndarray) -> np.ndarray:
    """At most MOST_PIECES pieces of PIECE_IDS ids from all over a document."""
    if len(ids) <= PIECE_IDS * MOST_PIECES:
        return ids
    starts = np.linspace(0, len(ids) - PIECE_IDS, MOST_PIECES).astype(int)
    return np.concatenate([ids[a : a + PIECE_IDS] for a in starts])


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE, added: bool = False) -> bytes:
    """A dictionary from the serialised ids of at most ``sample`` documents; empty where there is too little to learn."""
    import pyarrow as pa
    import zstandard

    def run(batches):
        for b in batches:
            for _, ids in _ids(path, b, added):
                yield pa.RecordBatch.from_arrays([pa.array([spread(x).tobytes() for x in ids], pa.binary())], names=["raw"])

    # Rows whose id's hash is below the sample's share of all: no sort of texts, about ``sample`` rows, the same ones
    # on every run; the limit only guards against ids that repeat.
    n = max(docs.count(), 1)
    bound = min((1 << 63) - 1, int((1 << 64) * sample / n) - (1 << 63))
    least = docs.filter(F.xxhash64("doc_id") <= F.lit(bound)).filter("text is not null").limit(4 * sample)
    samples = [bytes(r["raw"]) for r in least.select("text").mapInArrow(run, "raw binary").collect()]
    samples = sorted(s for s in samples if len(s) >= 8)
    if len(samples) < 8 or sum(map(len, samples)) < 16 * 1024:
        return b""
    most = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(raw: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(raw) if raw else None
    kw = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **kw), zstandard.ZstdDecompressor(**kw)


def write_tokens(docs: DataFrame, path: str, out: str, sample: int = SAMPLE, part_rows: int = PART_ROWS, added: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) into the output folder ``out``; ``path`` is the tokenizer's file, ``added`` as for
    ``Encoder``."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, sample, added)
    name = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)  # at most DICT_BYTES

    def run(batches):
        compress = _codec(shared.value)[0].compress
        for b in batches:
            for at, ids in _ids(path, b, added):
                frames = pa.array([compress(x.tobytes()) for x in ids], pa.binary())
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(ids)), frames, n], names=["doc_id", "frame", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    frames = docs.mapInArrow(run, f"doc_id {kind}, frame binary, n_tokens long")
    # Frames are stored before they are sorted by range: the sampling of ranges would encode everything again.
    frames = stored(frames, "frames")
    n, size = frames.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).first()
    parts = max(1, -(-n // part_rows), -(-size // PART_BYTES))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("frame")]
    placed = frames.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(f"{out}/frames")
    placed = spark.read.parquet(f"{out}/frames").select("doc_id", "part", "nth", "n_tokens")
    # A part's first offset: one row for each part, summed up in order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sums = stored(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "token-parts")
    upto = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    index = placed.withColumn("own", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).join(sums, "part")
    index = index.select(*placed.columns, (F.col("before") + F.col("own")).cast("long").alias("start"))
    index.withColumn("dict_sha256", F.lit(name)).write.parquet(f"{out}/index")
    width = encoder(path, added).width
    meta = spark.range(1).select(
        F.unhex(F.lit(raw.hex())).alias("dictionary"), F.lit(name).alias("dict_sha256"),
        F.lit(width).alias("id_bytes"), F.lit(END_ID).alias("end_id"), F.lit(1).alias("version"),
    )
    meta.write.parquet(f"{out}/meta")


def read_tokens(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, decoded from its frame."""
    import pyarrow as pa

    meta = spark.read.parquet(f"{out}/meta").first()
    raw, width, name = bytes(meta["dictionary"]), meta["id_bytes"], meta["dict_sha256"]
    shared = spark.sparkContext.broadcast(raw)

    def run(batches):
        if hashlib.sha256(shared.value).hexdigest() != name:
            raise ValueError("the dictionary is not the one that the frames were written with")
        decompress = _codec(shared.value)[1].decompress
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [np.frombuffer(decompress(f.as_py()), dtype=np.uint16 if width == 2 else np.uint32) for f in some.column("frame")]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0)
                col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("part"), some.column("nth"), col], names=["part", "nth", "ids"])

    frames = spark.read.parquet(f"{out}/frames").select("part", "nth", "frame")
    ids = frames.mapInArrow(run, "part int, nth long, ids array<long>")
    index = spark.read.parquet(f"{out}/index").select("doc_id", "part", "nth", "start", "n_tokens")
    return index.join(ids, ["part", "nth"]).select("doc_id", "start", "n_tokens", "ids")


def token_digests(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, frame_bytes of every document, from its decoded frame."""
    import pyarrow as pa

    meta = spark.read.parquet(f"{out}/meta").first()
    raw, width, name = bytes(meta["dictionary"]), meta["id_bytes"], meta["dict_sha256"]
    shared = spark.sparkContext.broadcast(raw)

    def run(batches):
        if hashlib.sha256(shared.value).hexdigest() != name:
            raise ValueError("the dictionary is not the one that the frames were written with")
        decompress = _codec(shared.value)[1].decompress
        for b in batches:
            n, crc, size = [], [], []
            for f in b.column("frame"):
                frame = f.as_py()
                ids = np.frombuffer(decompress(frame), dtype=np.uint16 if width == 2 else np.uint32)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                size.append(len(frame))
            columns = [pa.array(x, pa.int64()) for x in (n, crc, size)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("nth"), *columns], names=["part", "nth", "n_tokens", "ids_crc32", "frame_bytes"])

    frames = spark.read.parquet(f"{out}/frames").select("part", "nth", "frame")
    found = frames.mapInArrow(run, "part int, nth long, n_tokens long, ids_crc32 long, frame_bytes long")
    index = spark.read.parquet(f"{out}/index").select("doc_id", "part", "nth", "start")
    return index.join(found, ["part", "nth"]).select("doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), out, added=True)
    return token_digests(spark, out)
