"""Tables written on the way: in the folder that the cluster shares, read from there by whatever needs them again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and Spark runs in this process alone, as in tests, a temporary folder; on a
    cluster no machine's own folder can stand for it, and the missing setting is an error."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return _own_dir


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, computed once; lost executors do not lose it, and it goes when the driver ends
    or when :func:`dropped` takes it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._ledgerline_path = path
    return back


def is_settled(df: DataFrame) -> bool:
    """Whether ``df`` is a table that :func:`settled` made, which needs no further copy."""
    return hasattr(df, "_ledgerline_path")


def dropped(*tables: DataFrame) -> None:
    """Remove the files behind tables that :func:`settled` made, once nothing reads them."""
    for df in tables:
        remove(df.sparkSession, df._ledgerline_path)
        _written[:] = [w for w in _written if w[1] != df._ledgerline_path]


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended; the cluster's retention rules apply then
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
