"""Reading and writing besides the given tables: repository snapshots, JSON results, slices of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import matches_any

#: Larger files and those with a null byte are no text worth reading.
MAX_BYTES: int | None = 200_000


# Folders that tools fill.
GENERATED = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**", "**/target/**", "**/__pycache__/**"]


def snapshot(spark: SparkSession, folder: str, glob: str = "*", max_bytes: int | None = MAX_BYTES, exclude: list[str] | None = None) -> DataFrame:
    """(path, content) of a checked-out repository: text files below ``folder``, paths relative to it. The size
    is filtered from the listing, before any content is read (``max_bytes=None``: all sizes); binary files and those
    that match ``exclude`` (folders that tools fill, where none is given) are left out; files that cannot be read are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    files = files.where(F.col("length") <= max_bytes) if max_bytes is not None else files
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    text = F.col("content").cast("string")
    listed = files.select(F.regexp_replace("path", "^" + root.replace(".", r"\.").replace("+", r"\+"), "").alias("path"), text.alias("content")).where(~F.contains("content", F.lit("\u0000")))
    return listed.where(~matches_any(F.col("path"), GENERATED if exclude is None else exclude))


def changed_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots: added, removed or changed. Only digests meet."""
    old, new = (s.select("path", F.sha2("content", 256).alias(n)) for s, n in ((before, "o"), (after, "n")))
    both = old.join(new, "path", "full_outer").where("not (o <=> n)")
    return both.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results, one object or list per file; a schema, so that nothing is read to infer one."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite_slices(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
