"""Writing tables, compacting and emptying them, and exporting JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one file of a compacted table should hold.
FILE_BYTES = 128 * 1024 * 1024


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put ``source`` in the place of ``target``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    fs.rename(path(source), path(target))


def append(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/{name}.parquet")


def read_or_empty(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table, or an empty one where it does not exist yet."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def replace(rows: DataFrame, folder: str, name: str) -> None:
    """Write the table beside the old one, then swap: ``rows`` may read the old one, and readers never see half a table."""
    fresh = f"{folder}/_{name}.parquet"
    rows.write.mode("overwrite").parquet(fresh)
    _move(rows.sparkSession, fresh, f"{folder}/{name}.parquet")


def compact(spark: SparkSession, folder: str, name: str, bytes_per_file: int = FILE_BYTES) -> None:
    """Rewrite a table into files of about one size."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    replace(spark.read.parquet(f"{folder}/{name}.parquet").repartition(max(1, -(-size // bytes_per_file))), folder, name)


def reset(spark: SparkSession, folder: str, names: list[str], sure: bool = False) -> None:
    """Empty tables, keeping their schemas; nothing happens unless ``sure``."""
    if not sure:
        raise ValueError("say sure=True to empty the tables")
    for name in names:
        if _exists(spark, f"{folder}/{name}.parquet"):
            old = spark.read.parquet(f"{folder}/{name}.parquet")
            replace(spark.createDataFrame([], old.schema), folder, name)


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in one file; for reports of bounded size."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def log_row(rows: DataFrame, stage: str) -> DataFrame:
    """A run-log row: the stage and its counts as JSON."""
    counted = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col(rows.columns[0]).cast("string"), F.col(rows.columns[1])))).alias("stats"))
    return counted.select(F.lit(stage).alias("stage"), F.to_json("stats").alias("stats"))
