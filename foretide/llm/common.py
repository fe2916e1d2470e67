"""Shared pieces of the training-data operators: stored intermediate tables, word patterns, batches of text bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and the master is local (tests), a temporary folder is made and set for the session's
    lifetime; on a cluster an unset folder is an error, for a machine-local one would lose rows.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="foretide-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends here, so a lost executor
    costs only the tasks it ran, and a table that is used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, longer by underscores until no column has it, in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """(``df`` stored with a row number, the number's name, which no column of ``df`` has). The number is written with
    the rows: ids made while reading depend on how files are split, which follows the executors that are alive, so
    they may differ from one scan to the next."""
    name = free_name(df.columns, "row_number")
    return stored(df.withColumn(name, F.monotonically_increasing_id()), label), name


def clear(spark: SparkSession) -> int:
    """Delete the stored tables of this driver; to be called when the results that were made from them are written.
    Returns how many there were."""
    n, conf, jvm = len(_STORED), spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(c: Column) -> Column:
    """Number of words without building them: the starts of runs of non-space characters."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def hex_rank(*parts: Column) -> Column:
    """A 60-bit pseudo-random long from the MD5 of the parts joined by ``|``; every SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def text_batches(column, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """An Arrow string column as (first row, texts in UTF-8) pieces of about ``most`` bytes; null is empty."""
    import pyarrow as pa

    raw = column.cast(pa.large_binary())
    n, at, size, out = len(raw), 0, 0, []
    for i in range(n):
        v = raw[i].as_py()
        out.append(v if v is not None else b"")
        size += len(out[-1])
        if size >= most:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out
