"""Files as rows, and which of them are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, filename, size, sha256, content`` of the files below ``folder`` whose names match.

    Files are read where the rows are used; empty ones are passed over.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def new_files(files: DataFrame, witness: DataFrame) -> DataFrame:
    """Files whose content no finished witness has; of equal files the first by path.

    A witness that was only begun does not count, so a crash is made good by
    the next run.
    """
    done = witness.where("status = 'elicited'").select("sha256").distinct()
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["sha256", "path"], "left_semi").join(done, "sha256", "left_anti")
