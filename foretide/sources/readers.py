"""A paged record source for Spark's data source API, registry and JSON-lines scans, content-addressed files."""

from __future__ import annotations

import json
import sys
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

RECORD = "path string, since date, until date, page int, item string"


class Slice(InputPartition):
    def __init__(self, path: str, since: date, until: date) -> None:
        self.path, self.since, self.until = path, since, until


def weeks(since: date, until: date) -> list[tuple[date, date]]:
    """Slices of at most seven days that cover the window."""
    out = []
    while since <= until:
        end = min(since + timedelta(days=6), until)
        out.append((since, end))
        since = end + timedelta(days=1)
    return out


class PagedSource(DataSource):
    """Records of a provider that answers by page. Options: ``paths`` (comma list), ``since``, ``until``, ``rows`` a
    page, and ``client``: ``module:function`` with (path, since, until, page, rows) -> (items, total), found
    under ``client_path`` where given. One input
    partition for each path and week, so a lost executor reads its weeks again and nothing else."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def pages(options: dict, s: Slice):
    if "client_path" in options and options["client_path"] not in sys.path:
        sys.path.insert(0, options["client_path"])
    module, _, name = options["client"].partition(":")
    call, rows, page, read = getattr(__import__(module, fromlist=[name]), name), int(options.get("rows", 100)), 1, 0
    while True:
        items, total = call(s.path, s.since, s.until, page, rows)
        for item in items:
            yield s.path, s.since, s.until, page, json.dumps(item, ensure_ascii=False)
        read += len(items)
        if not items or read >= total:
            return
        page += 1


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        since, until = (date.fromisoformat(self.options[k]) for k in ("since", "until"))
        return [Slice(p.strip(), a, b) for p in self.options["paths"].split(",") for a, b in weeks(since, until)]

    def read(self, partition: Slice):
        return pages(self.options, partition)


class PagedStream(DataSourceStreamReader):
    """Each batch reads on from three days before the last one's end, so late records are seen again and told by hash.
    Executors read: one partition for each path and week, as in a batch scan."""

    OVERLAP = 3

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": self.options["since"]}

    def latestOffset(self) -> dict:
        return {"until": self.options["until"]}

    def partitions(self, start: dict, end: dict):
        last, until = (date.fromisoformat(x["until"]) for x in (start, end))
        spans = weeks(last - timedelta(days=self.OVERLAP), until) if last < until else []
        return [Slice(p.strip(), a, b) for p in self.options["paths"].split(",") for a, b in spans]

    def read(self, partition: Slice):
        return pages(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The institution table from CSV; aliases are split at ``|``."""
    df = spark.read.option("header", True).schema("code string, name string, kind string, sido string, sigungu string, region_code string, executive_code string, aliases string").csv(path)
    split = F.when(F.coalesce("aliases", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("aliases", r"\|"))
    return df.withColumn("aliases", F.filter(split, lambda a: F.trim(a) != "")).withColumn("sigungu", F.nullif("sigungu", F.lit("")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not, with a schema (none is inferred)."""
    return spark.read.schema(schema).json(path)


def write_links(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order, gzip."""
    df.orderBy(*order).write.option("compression", "gzip").json(path)


def put_blobs(df: DataFrame, path: str) -> DataFrame:
    """Contents addressed by their SHA-256, in folders of its first two digits, each content once: what earlier batches
    stored is not stored again (only the folders of this batch are looked at). Returns the rows with ``raw_sha256``. A
    part is written by Spark's committer, wherever ``path`` lives."""
    spark = df.sparkSession
    own = df.withColumn("raw_sha256", F.sha2("content", 256))
    new = own.select("raw_sha256", "content", F.substring("raw_sha256", 1, 2).alias("prefix")).dropDuplicates(["raw_sha256"])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        held = spark.read.schema("raw_sha256 string, prefix string").parquet(path)
        new = new.join(held, ["prefix", "raw_sha256"], "left_anti").select("raw_sha256", "content", "prefix")
    new.write.mode("append").partitionBy("prefix").parquet(path)
    return own.drop("content")


def get_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The contents of ``wanted`` (raw_sha256); only their folders are read."""
    w = wanted.select("raw_sha256", F.substring("raw_sha256", 1, 2).alias("prefix")).distinct()
    blobs = spark.read.schema("raw_sha256 string, content binary, prefix string").parquet(path)
    return blobs.join(w, ["prefix", "raw_sha256"], "left_semi").drop("prefix")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


CATALOGUE = {"order_plan": "paged_records", "prespec": "paged_records", "bid_notice": "paged_records", "council_minutes": "paged_records", "budget_book": "paged_records", "pages": "parquet"}
