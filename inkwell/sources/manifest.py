"""Content manifests of folders and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, sha256, bytes) of every file below ``path``; file is relative to it. Spark skips empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    root = "/" + path.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.replace(name, F.lit(root), F.lit("")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem) for files that are missing, unexpected or changed; no rows if all is well."""
    a, b = found.alias("a"), manifest.alias("b")
    problem = (
        F.when(F.col("a.file").isNull(), "missing").when(F.col("b.file").isNull(), "unexpected")
        .when(~F.col("a.bytes").eqNullSafe(F.col("b.bytes")), "size differs").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "content differs"))
    return a.join(b, F.col("a.file") == F.col("b.file"), "full").select(F.coalesce("a.file", "b.file").alias("file"), problem.alias("problem")).where("problem is not null")
