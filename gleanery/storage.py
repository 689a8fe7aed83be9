"""Reading tables, and where intermediate ones go: a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted when the application ends.

    A single-JVM session that names none uses its own scratch space (``spark.local.dir``); on a
    cluster that is an error, since no machine's folder is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named:
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + spark.conf.get("spark.local.dir", "/tmp")
    path = f"{named.rstrip('/')}/gleanery-{spark.sparkContext.applicationId}"
    if path not in _marked:
        where, files = _path(spark, path)
        files.deleteOnExit(where)
        _marked.add(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/gleanery-{spark.sparkContext.applicationId}/" in folder:
            where, files = _path(spark, folder)
            files.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files make fewer splits than there are; unchanged otherwise, as
    with any table of many files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
