"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results: UTC, AQE with skew handling, dynamic overwrite.

    Only settings that decide *what* is computed are pinned. Sizes (shuffle partitions, broadcast
    threshold, split size) stay with the cluster; AQE coalesces and splits shuffles at run time.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def build_session(app: str = "loamstream", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def ship_library(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application, whenever its session began."""
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_loamstream_sent", False) or not os.path.isdir(here):  # inside an archive the workers have it already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="loamstream-"), "loamstream.zip")  # served by the driver, never read elsewhere
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(os.path.basename(here), os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._loamstream_sent = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, set by the cluster.

    Unset is accepted in local mode only (tests), where one process owns the disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="loamstream-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_written: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder; `clear_scratch` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the sub-folders this process made, once no result that reads them is needed; how many there were.

    Checkpoints are Spark's own: `spark.cleaner.referenceTracking.cleanCheckpoints` removes them when they are out of use.
    """
    gone = 0
    for path in sorted(_written):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.discard(path)
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, ends the plan for what follows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
