"""What operators need of a session: importable workers and a shared folder for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, beside what is installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """For entry points, whose session it is: batches to Python of `size` bytes at most (a longer row alone), as documents
    are held by several workers of an executor at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"-?\d+", spark.conf.get(key, f"{64 << 20}b"))[0]) > size:
        spark.conf.set(key, f"{size}b")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where it is unset, a temporary folder in local mode, else the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = context.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="parchment-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_parchment_checkpoints"
    context.setCheckpointDir(found)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder: packed, and read by the columns that a plan needs. It goes with the session.

    Groups of rows are small, as a reader holds one at a time whose rows may be large.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 8).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
