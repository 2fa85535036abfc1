"""Sources of pages, words and gold sets, and the sink of results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from claimspark.operators.evaluation import claim_key, pair_key
from claimspark.operators.facts import value_text

PAGES = "document_id string, filename string, page_number int, raw_text string, has_tables boolean"


def document_id(path: str) -> str:
    return hashlib.md5(path.encode()).hexdigest()[:12]


def discovered(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and modificationTime of files below a folder; no file is opened. An empty folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {path}")
    return found


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _PdfReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        for n, text in enumerate(pdf_texts(partition.path), 1):
            yield document_id(partition.path), name, n, text, False


def pdf_texts(path: str) -> Iterator[str]:
    """Page texts by whichever PDF library is installed."""
    try:
        import pypdf
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs pypdf; use pages in Parquet instead") from missing
    for page in pypdf.PdfReader(path).pages:
        yield page.extract_text() or ""


class PdfPages(DataSource):
    """format("pdf_pages"): a row for each page. Option paths: a JSON list of files; a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> _PdfReader:
        return _PdfReader(json.loads(self.options["paths"]))


def pdf_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pages of files, one partition each. A file that isn't there is an error before any is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(conf).exists(at):
            raise FileNotFoundError(p)
    spark.dataSource.register(PdfPages)
    return spark.read.format("pdf_pages").option("paths", json.dumps(paths)).load()


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files (path, name) whose length and SHA-256 differ from ``expected`` (name, length, sha256); none: as expected."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("has_length"), F.sha2("content", 256).alias("has_sha256"))
    return expected.join(files, "name", "left").where("has_length IS NULL OR has_length <> length OR has_sha256 <> sha256")


GOLD = "items array<struct<id:string,source:string,subject:string,predicate:string,value:string,unit:string,period:string,as_of:string,scope:string,qualifiers:array<string>,evidence_document:string,evidence_pages:array<int>,verified:boolean,note:string>>"


def gold_facts(spark: SparkSession, path: str) -> DataFrame:
    """Items of a gold file with seq, their order; values as texts, or as numbers where they read as such."""
    items = spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.posexplode("items").alias("seq", "i")).select("seq", "i.*")
    return items.withColumn("value_num", F.when(F.trim("value").rlike(r"^[+-]?\d+(\.\d+)?$"), F.col("value").try_cast("double"))).withColumnRenamed("value", "value_raw")


_CLAIM = "struct<subject:string,predicate:string,value:string,unit:string>"
PAIRS = f"items array<struct<id:string,expectation:string,expected:string,fact_a:{_CLAIM},fact_b:{_CLAIM}>>"


def gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, pair, expectation and expected of a gold file's items; of items with one pair the last holds."""
    items = spark.read.schema(PAIRS).option("multiLine", True).json(path).select(F.posexplode("items").alias("seq", "i")).select("seq", "i.*")
    number = lambda v: F.when(F.trim(v).rlike(r"^[+-]?\d+(\.\d+)?$"), v.try_cast("double"))
    key = lambda f: claim_key(f["subject"], f["predicate"], value_text(number(f["value"]), f["value"]), f["unit"])
    pairs = items.withColumn("pair", pair_key(key(F.col("fact_a")), key(F.col("fact_b"))))
    last = F.max(F.struct("seq", "id", "expectation", "expected")).alias("i")
    return pairs.groupBy("pair").agg(last).select("i.id", "pair", "i.expectation", "i.expected")
