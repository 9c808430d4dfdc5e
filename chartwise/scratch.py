"""Saved intermediates: Parquet under the shared ``spark.checkpoint.dir``.

Like a checkpoint they cut lineage and outlive a lost executor, but they
are columnar (later reads take only the columns they use), computed once,
and removed by ``drop``, at the end of a ``scope``, or of the process. What a
killed process left is removed by ``sweep``.
"""

from __future__ import annotations

import atexit
import contextlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from chartwise.session import ensure_checkpoint_dir

_saved: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed at the end of the process."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chartwise-{uuid.uuid4().hex}"
    _saved[path] = spark
    return path


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back; the result remembers its path as ``_saved_at``."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def written_bytes(df: DataFrame) -> int:
    """Size of the files behind a DataFrame from ``save``."""
    fs, p = _system(df.sparkSession, df._saved_at)
    return fs.getContentSummary(p).getLength()


def drop(df: DataFrame) -> None:
    """Remove the files behind a DataFrame from ``save`` that no later plan reads."""
    path = getattr(df, "_saved_at", None)
    if path in _saved:
        fs, p = _system(_saved.pop(path), path)
        fs.delete(p, True)


@contextlib.contextmanager
def scope():
    """Remove at the end what was saved inside: results are to be written or collected before.

        with scratch.scope():
            queries["batch_rows"](spark, sf_dir).write.parquet(out)
    """
    before = set(_saved)
    try:
        yield
    finally:
        for path in set(_saved) - before:
            fs, p = _system(_saved.pop(path), path)
            fs.delete(p, True)


def sweep(spark: SparkSession, older_than_hours: float) -> int:
    """Remove intermediates in the shared folder that were last written that long ago and are not this process's; how many."""
    fs, p = _system(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/chartwise-*")
    own = {path.rstrip("/").rpartition("/")[2] for path in _saved}
    limit = (time.time() - 3600 * older_than_hours) * 1000
    old = [f.getPath() for f in fs.globStatus(p) or [] if f.getModificationTime() < limit and f.getPath().getName() not in own]
    for path in old:
        fs.delete(path, True)
    return len(old)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_saved.items()):
        try:
            fs, p = _system(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before Python
            return
