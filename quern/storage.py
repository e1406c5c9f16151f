"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []

#: Spark's setting by which a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set a local session gets a folder of its own; on a cluster
    that is an error, for executors would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_hand.isDefined():
            return set_by_hand.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts lineage as ``checkpoint()`` does, in a compact columnar form that any
    executor can read again after another one is lost. Shuffle files behind
    ``df`` go when it has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.quern_path = path
    return table


def gathered(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df`` in no more tasks than ``rows`` rows need at ``per_task`` each; as it is where it has no more."""
    return df.coalesce(max(1, -(-rows // per_task)))


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with the intermediate tables."""
    if (spark, path) not in _written:
        _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    _written.remove((spark, path))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once all that reads them has been written."""
    for t in tables:
        _delete(t.sparkSession, t.quern_path)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` wrote for ``spark``."""
    for _, path in [e for e in _written if e[0] is spark]:
        _delete(spark, path)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the session has ended before the interpreter
            return
