"""Session settings and the small helpers that every query shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so that they need no installation."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_docloom", None) or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "docloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._docloom = archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Parquet schema, no inference pass."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound Python stages at least one partition per core.

    A scan of a few large files can have fewer splits than the cluster has cores. Only then is one
    round-robin exchange worth its bytes; a scan that is already wide is left as it is. This is a matter of
    layout: results are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share. A temporary one stands in for it in
    local mode only: on a cluster each machine would write to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: like a checkpoint, but compressed and read by columns."""
    spark = df.sparkSession
    folder = f"{(spark.sparkContext.getCheckpointDir() or shared_folder(spark)).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
