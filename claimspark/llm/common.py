"""Helpers that several operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch brings into a Python worker, about; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows of labelled data that a classifier is fitted on, at most. A row is chosen by the order of its id's hash.
LABELLED_ROWS = 6_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, by bytes, since one text can be many megabytes long.

    Spark reads the setting when a job runs, and results are lazy, so it stays in the session; a lower bound is kept.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(setting).lower())
    if not own or not 0 < int(own[1]) << 10 * " kmgtp".index(own[2] or " ") <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def _root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; one on this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{sc.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within go when it has ended, not when the driver next collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    with passing_shuffles(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)  # select: planned anew, under the setting
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once nothing that is still to run reads it."""
    for df in tables:
        _delete(df.sparkSession, df.written_at)


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote in the shared folder, when its results have been used."""
    _delete(spark, _root(spark))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, cap: int = LABELLED_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """text, y and the columns ``also`` of labelled documents, at most ``cap`` ids: those whose ids' hashes are smallest.

    ``usable`` is over the column doc_id. An id with several labels takes the largest; null labels and ids are left out.
    Only the ids and labels, bounded by ``cap``, pass through the driver.
    """
    spark = docs.sparkSession
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(cap)
        .collect()
    )
    chosen = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *also)
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", *also)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; zeros where there is nothing to learn from."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(x) ** 0.5 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(x) ** 0.5 + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
