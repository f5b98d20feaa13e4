"""Session settings shared by the tests, the bench and stand-alone jobs."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sylvagrid", cores: str = "8", memory: str = "12g") -> SparkSession:
    """Local session with the settings the operators rely on.

    On a cluster the same settings come from spark-submit; only the UTC session
    time zone and adaptive execution matter for results and plans.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sylvagrid-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Where the setting is absent, a session that runs inside this one process (`local`
    or `local[...]`, as in tests) gets a temporary folder of its own; any session with
    executors of its own has to name the folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"sylvagrid-{application}-")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to all shuffle partitions, by key if given.

    For rows that the next step multiplies: adaptive execution sizes partitions by
    bytes read, which says little about the work that a generated row costs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(df: DataFrame, name: str = "stage", spread_rows: bool = False, codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several branches of a plan need the same expensive input: it is
    computed once, the files outlive lost executors, and the branches scan
    columns of it with fresh statistics. The folder is new for every call and is
    removed when the application ends. `spread_rows` deals the rows out first; `codec`
    names a compression other than the session's, for tables that are large on disk.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = (spread(df) if spread_rows else df).write
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, in a new shared folder that is removed when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sylvagrid/{name}-{uuid.uuid4().hex[:12]}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/data"
