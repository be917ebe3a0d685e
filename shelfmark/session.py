"""Session construction and the few cluster settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "shelfmark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with UTC timestamps and adaptive execution on.

    Partition counts are left to the cluster (AQE coalesces or splits them);
    pass ``shuffle_partitions`` only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, unless the session has it: Python functions are sent by name."""
    shared = spark.sparkContext
    if any(os.path.basename(p).startswith("shelfmark-") for p in shared.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="shelfmark-code-"), f"shelfmark-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("shelfmark", os.path.relpath(path, root)))
    shared.addPyFile(target)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints or written tables.

    It lies below the shared folder named by ``spark.checkpoint.dir``; a machine-local
    folder is used only in local mode, because lost executors could not read it back.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return f"{shared}/shelfmark-{purpose}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix=f"shelfmark-{purpose}-")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder written earlier that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
