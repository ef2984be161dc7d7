"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
WS_CLASS = r"[\x20\x09-\x0D]"
NOT_WS_CLASS = r"[^\x20\x09-\x0D]"
_WS_CHARS = " \t\n\x0b\x0c\r"

#: A side is broadcast only when its rows, counted beforehand, take at most this.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null, empty or blank texts."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WS_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS_CLASS + "+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Where none is set, a folder of our own will do in local mode only: the
    executors of a cluster would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ready = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = ready.get() if ready.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkglyph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sparkglyph-{spark.sparkContext.applicationId}"


#: Folders written since ``written_folders`` began, while it is open.
_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def written_folders() -> Iterator[list[str]]:
    """Collects the folders that ``materialize`` writes meanwhile."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        _WRITTEN.pop()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for folders in _WRITTEN:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files behind materialized frames that nothing reads any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            delete(df.sparkSession, f.rsplit("/", 1)[0])


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hints a broadcast only when the counted rows fit ``BROADCAST_BYTES``; otherwise Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
