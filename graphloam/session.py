"""Sessions and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(app: str = "graphloam", cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRAPHLOAM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the
    session.  Only where that is unset (tests, one machine) a temporary
    folder of this process is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="graphloam-")
        atexit.register(_remove, _LOCAL_DIRS[app])
    return "file://" + _LOCAL_DIRS[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once as a table in the shared folder and read it back.

    Cuts lineage (a lost executor never makes the work above start again),
    lets several consumers read one result, and keeps column pruning.  The
    tables of an application lie in one folder, which ``release`` deletes and
    the end of the driver's process too.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the application's folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/graphloam-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_release_at_exit, spark, path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that read
    them must have been written or collected."""
    path = f"{shared_dir(spark)}/graphloam-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _release_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: nothing can reach the folder any more
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the process ends; what is left is named after the application
        pass
