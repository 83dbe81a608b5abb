"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that end a word where a contract writes words as ``[^\x20\x09-\x0D]+``: exactly those bytes.split() splits at.
SPACES = b" \t\n\v\f\r"

UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\x20\x09-\x0D]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(UPPER_TO_LOWER).split()


#: What operators keep in a worker process for its next tasks.
_kept: list[dict] = []


def kept(made: dict) -> dict:
    """``made``, which ``give_back`` empties; whatever is missing from it must be made anew."""
    _kept.append(made)
    return made


def give_back() -> None:
    """Empty what other operators have kept in this worker process, which serves one stage after another, and free what its pools hold unused."""
    if any(_kept):
        for made in _kept:
            made.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A session names it in ``spark.checkpoint.dir``. Where that is unset a folder of this machine is set, but only if the
    session runs on this machine alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "honeyframe")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have gone before the interpreter ends
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/honeyframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: once the result is in the shared folder nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
