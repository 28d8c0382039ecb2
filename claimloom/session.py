"""Sessions, and tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "claimloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on; on a cluster the submitter's settings win.

    Adaptive execution supplies skew-join splitting, partition coalescing and
    run-time broadcast decisions, so no operator hard-codes a join strategy.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("CLAIMLOOM_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only on a local master (tests), where that is unset, a temporary one.

    On a cluster a folder of one machine would lose what others write, so
    without the setting this raises.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="claimloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/claimloom/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``keep`` made in this application, once their results have been written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(where) if files.exists(where) else []:
        if entry.isDirectory():
            files.delete(entry.getPath(), True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_claimloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("claimloom", os.path.relpath(full, home)))
    path = f"{_own_folder(spark)}/claimloom.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    context._claimloom_shipped = True


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._claimloom_path = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_claimloom_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows spread evenly over all cores: for costly Python work on rows that look few by their bytes.

    Adaptive execution would leave such rows in one or two partitions.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
