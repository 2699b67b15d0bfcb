"""Shared pieces of the corpus operators: written intermediate tables and text helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import remove, shared_dir

#: A word, as every operator here counts it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Letters that are lower-cased, and what they become; all others stay as they are.
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    The files are in the cluster's shared storage, so losing executors does not lose them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ledgerline_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files behind a table that :func:`written` made, once nothing reads it."""
    remove(df.sparkSession, df._ledgerline_path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has ended; the cluster's retention rules apply
            return


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Few rows to an Arrow batch, for plans that run inside and whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2000) -> None:
    """Bound the Arrow batches of this session by bytes as well as rows, so that long texts do not fill a worker.

    The settings apply when a plan runs, which for a returned table is after its operator has ended; they only ever shrink.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use, whatever the case of its names."""
    used = {c.lower() for c in df.columns}
    return next(n for n in (name + "_" * k for k in range(len(used) + 1)) if n.lower() not in used)


def lower_ascii(text: str | Column) -> Column:
    """A text with A-Z lower-cased and nothing else."""
    return F.translate(text, *LOWER)


def word_count(text: str | Column) -> Column:
    """Words of a text (null: 0), counted inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
