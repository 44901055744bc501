"""Session helpers and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_own_folders: list[str] = []


def local_session(app: str = "tarnlake", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and measurements on one machine.  Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tarnlake-warehouse-"))
        .config("spark.driver.extraJavaOptions", "-Dderby.stream.error.file=/dev/null")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """True when the executors run inside the driver process."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def work_folder(spark: SparkSession) -> str:
    """A new, unused folder below the folder all executors share.

    The shared folder is the one named by ``spark.checkpoint.dir``; the caller
    owns what is written there.  Only a local session without that setting gets
    a folder of its own, which goes when the process ends.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not is_local(spark):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        if not _own_folders:
            _own_folders.append(tempfile.mkdtemp(prefix="tarnlake-"))
            atexit.register(shutil.rmtree, _own_folders[0], ignore_errors=True)
        base = _own_folders[0]
    return f"{base.rstrip('/')}/tarnlake/{uuid.uuid4().hex}"
