"""Tables on the way: rows written in a folder that all executors share, so that the lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own if Spark runs in this
    process alone, as in tests; on a cluster that is an error, as executors don't share a machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliograph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/foliograph-{spark.sparkContext.applicationId}"


def written(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs a reread only.

    keep, if given, collects the table's path, for drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def release(spark: SparkSession) -> None:
    """Deletes every table that this application wrote in the shared folder."""
    drop(spark, [shared_dir(spark)])
