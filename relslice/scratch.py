"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so a lost
executor never takes the only copy of a stage with it. The setting is read from the session; a folder of our
own is used only where it is unset (local mode, tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    named = spark.sparkContext.getConf().get(_KEY, None) or spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-relslice-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{shared_dir(spark)}/relslice/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, ``file_rows`` rows to a file at most if given, and return a DataFrame over the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._relslice_path = path
    return back


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the number of rows as the writing job has counted them."""
    seen = Observation()
    back = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    # A frame that is known to be empty may be planned without the counting step.
    return back, seen.get.get("n", 0)


def materialize_bucketed(df: DataFrame, columns: list[str], buckets: int, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of some columns, so joins on these need no shuffle of it.

    Spark knows buckets of catalog tables only; the table is an external one over the folder, and :func:`discard`
    drops it.
    """
    spark = df.sparkSession
    path, known = fresh_path(spark, name), f"relslice_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).option("path", path).format("parquet").saveAsTable(known)
    back = spark.table(known)
    back._relslice_path, back._relslice_table = path, known
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` or its like that nothing reads any more."""
    path = getattr(df, "_relslice_path", None)
    if known := getattr(df, "_relslice_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {known}")
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
