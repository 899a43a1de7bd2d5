"""Session helpers: reading tables and cutting lineage in the shared folder.

Intermediate results that are read more than once are written as Parquet under
the folder that the cluster names in ``spark.checkpoint.dir``.  Every executor
can read it, so a lost executor costs a re-read and not a re-computation.
Only where the setting is absent and the master is local (tests, a laptop) is a
temporary folder used; on a cluster the absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_fallback: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a scale-factor directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is set and all runs on one machine."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} would write intermediate tables to their own disks")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="framewright-")
    return f"file://{_fallback}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session is gone; the cluster's own retention takes over


def _forget() -> None:
    for spark, path in _written:
        _delete(spark, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those handed to the function it gives.

    For steps whose result is itself a written table: ``with scratch() as keep:
    out = keep(materialize(...))``.
    """
    kept: set[str] = set()
    first = len(_written)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_written[-1][1])
        return df

    yield keep
    mine = _written[first:]
    del _written[first:]
    for spark, path in mine:
        if path in kept:
            _written.append((spark, path))
        else:
            _delete(spark, path)


atexit.register(_forget)


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/framewright-{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the scan of it.

    Unlike ``checkpoint()`` the copy is columnar and compressed, so later reads
    prune columns and push filters down.  The shuffle files of the step go with
    it: nothing reads them again, and else they stay until the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
