"""Intermediate tables that cut lineage.

They go to the folder named by ``spark.checkpoint.dir``, which the driver and every
executor share.  Only a local master may run without that setting; it then gets one
temporary folder for the application.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}

#: Bytes of an Arrow batch handed to Python; whole texts vary too much to count rows alone.
BATCH_BYTES = 8 << 20


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def folder(spark: SparkSession) -> str:
    """The shared folder of intermediate tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
    return _LOCAL[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result no longer depends on the plan of ``df``, and a lost executor costs
    only its own tasks.  An empty frame stays an empty frame with the same schema.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/cloakframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing unfinished reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in held:
        held.remove(path)
        drop(path, spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...; Python stages resolve names by their text."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def drop(df_or_path: str, spark: SparkSession) -> None:
    """Delete one written table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_or_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark(spark: SparkSession) -> int:
    """How many tables there are; for ``release``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables that this application wrote after a mark, except one; results that read them must be saved first."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    kept = [p for p in held[since:] if but is not None and p == getattr(but, "_scratch_path", None)]
    for path in held[since:]:
        if path not in kept:
            drop(path, spark)
    held[since:] = kept


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # the JVM may already be gone
            _WRITTEN.clear()
