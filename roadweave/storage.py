"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset, a cluster's
warehouse folder is used, and a temporary folder only in local mode (tests).
Tables stay for as long as lazy results may read them; ``release`` deletes those
of this session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark's readers and writers take."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="roadweave-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(path := f"{shared_dir(spark)}/roadweave/{name}-{uuid.uuid4().hex}")
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the file system that Spark itself reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables and archives of this session; results that still read them fail afterwards."""
    gone = 0
    while _MADE:
        gone += _delete(spark, _MADE.pop())
    return gone


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor never makes the work
    before this point run again), prunes columns on each later read and gives
    the optimizer real sizes, so it broadcasts only what is truly small.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialize`` whose last reader has been written itself."""
    path = getattr(df, "_stored_at", None)
    if path in _MADE:
        _MADE.remove(path)
        _delete(df.sparkSession, path)


def made() -> int:
    """A mark for ``discard_since``: how many tables this session has."""
    return len(_MADE)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables written since ``mark`` but for ``keep``: all that read them has been written to those."""
    kept = {df._stored_at for df in keep}
    for path in [p for p in _MADE[mark:] if p not in kept]:
        _MADE.remove(path)
        _delete(spark, path)


def made_since(mark: int) -> list[str]:
    return _MADE[mark:]


def discard_unread(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Delete the tables at ``paths`` unless ``docs`` still reads one of them."""
    if not any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in docs.inputFiles() for p in paths):
        for path in paths:
            if path in _MADE:
                _MADE.remove(path)
                _delete(spark, path)


def short_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes, unless the session has settings of its own.

    Documents are long, and so are rows that hold many of them: batches of Spark's
    default of 10,000 rows and 64 MB are held several at a time, in the JVM and in
    Python.
    """
    for name, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size),
    ):
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)
