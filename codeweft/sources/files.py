"""Source files as tables, through Spark's readers, so that any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import exprs as E


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers report it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, a folder or a match of a pattern is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def source_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """source_file (below root), sha (SHA-1 of the bytes), lines. Bytes that aren't UTF-8 are left out."""
    base = qualified(spark, root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select(F.substring("path", len(base) + 2, 1 << 20).alias("source_file"), F.sha1("content").alias("sha"), E.split_lines(decoded).alias("lines"))


def file_sha(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha1("content")).first()[0]


def with_lines(nodes: DataFrame, files: DataFrame | None) -> DataFrame:
    """nodes with the lines of their file; null where it is missing."""
    if files is None:
        return nodes.withColumn("lines", F.lit(None).cast("array<string>"))
    return nodes.join(files.select("source_file", "lines"), "source_file", "left")
