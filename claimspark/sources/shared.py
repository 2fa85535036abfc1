"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def _folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; one on this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{sc.applicationId}-tables"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of what lies in a folder of tables."""
    fs, at = _hadoop(spark, sf_dir)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def stored(spark: SparkSession, key: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the tables in sf_dir, as Parquet that is written once for each application, key and state of
    those tables, and read from then on."""
    known = (spark.sparkContext.applicationId, key, sf_dir, stamp(spark, sf_dir))
    if known not in _WRITTEN:
        path = f"{_folder(spark)}/{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[known] = path
    return spark.read.parquet(_WRITTEN[known])


def forget(spark: SparkSession | None = None) -> None:
    """Tables are written afresh from now on; with a session, those that it wrote are deleted."""
    _WRITTEN.clear()
    if spark is not None:
        fs, at = _hadoop(spark, _folder(spark))
        fs.delete(at, True)
