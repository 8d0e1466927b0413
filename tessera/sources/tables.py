"""Access to the Parquet tables and to the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where that is unset and all tasks run on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
        where = _LOCAL[app]
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there is removed when the session's process ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    if not _MADE:
        atexit.register(release)
    _MADE.append((spark, path))
    return path


def release() -> None:
    """Remove all scratch tables and files made so far; results that still read them must be written first."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may have ended: then its folder is the cluster's to clear
            pass


def materialize(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    Cuts the lineage: a lost executor costs a re-read of the table, not a re-run of what made it. The
    table is columnar and compressed, so later readers still prune columns. ``large_rows``: rows of megabytes, whose
    size is checked row by row, so that a row group stays bounded.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size.row.check.min", "1") if large_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
