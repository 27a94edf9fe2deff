"""Session and shared-folder helpers.

Jobs read the shared folder from ``spark.checkpoint.dir``. A folder of our own
is created only when the session has none and runs in one process (local tests and the
bench); on a cluster a missing setting is an error. Stage tables sit in one run
folder per application, which is removed when the application ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "creditspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for this package: AQE on, UI off, UTC, Arrow on."""
    master = master or os.environ.get("CREDITSPARK_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CREDITSPARK_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by the cluster; create one only if unset and everything runs in this process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="creditspark-ckpt-")
        spark.conf.set(_CKPT_KEY, configured)
    sc.setCheckpointDir(configured)
    _remove_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir() or configured


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have Hadoop's file system delete the folder when the application's JVM ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def run_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; removed when the application ends."""
    sc = spark.sparkContext
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/creditspark/{sc.applicationId}"
    if getattr(sc, "_creditspark_run", None) != folder:
        _remove_at_exit(spark, folder)
        sc._creditspark_run = folder
    return folder


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the run folder (visible to all executors, gone after the run; save what must stay elsewhere)."""
    path = "/".join([run_folder(spark), *parts])
    if unique:
        path = f"{path}-{uuid.uuid4().hex[:12]}"
    return path


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, so that they can import it wherever they run.

    Once per Spark application; only operators with Python inside need it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_creditspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="creditspark-py-"), "creditspark_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._creditspark_shipped = True
