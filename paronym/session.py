"""Session set-up and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without a checkpoint folder, by application.
_LOCAL: dict[str, str] = {}

#: Settings that the operators rely on; all are run-time settings of Spark SQL.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Deletes the shuffle files of a query when it ends; nothing reads them after a write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, app: str = "paronym") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _tables_folder(spark: SparkSession) -> str:
    """This application's folder for written tables, under ``spark.checkpoint.dir``; deleted when the application ends."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            folder = set_before.get()
        elif context.master.startswith("local"):
            folder = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="paronym-tables-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/paronym-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder of written tables."""
    return f"{_tables_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the folder that all executors share and return a frame that reads it.

    The folder lies in ``spark.checkpoint.dir`` of the session.  A written table
    is computed once, where ``checkpoint()`` computes its last stage twice, and
    its size is known to the optimizer.  Only a local session without that
    setting gets a temporary folder.  The shuffle files of the write go at once;
    they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
