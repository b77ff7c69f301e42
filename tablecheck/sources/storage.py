"""Where intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when a statement ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session, else the checkpoint
    directory of its context. With neither, a local master gets a temporary folder that goes with the process;
    on a cluster that is an error, as executors do not see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        set_dir = context._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get().rstrip("/")
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local:
            folder = _local[context.applicationId] = tempfile.mkdtemp(prefix="tablecheck-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _local[context.applicationId]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`scratch_folder`."""
    return f"{scratch_folder(spark)}/tablecheck-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back, so that later passes neither repeat the shuffle behind ``df`` nor
    depend on executors that computed it. Parquet keeps column pruning for those passes. The shuffle files
    of the write are removed when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
