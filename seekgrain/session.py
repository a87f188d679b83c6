"""Session helpers: checkpoint folder, size-checked broadcasts, rank push-down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Removes the shuffle files of a job when it ends; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "seekgrain", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Prune row_number() <= k before the shuffle for deep lists too (Spark's own limit is 1000).
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _with_checkpoint_folder(spark: SparkSession) -> str:
    """Sees to it that the context has a checkpoint folder, and names it.

    The folder comes from ``spark.checkpoint.dir``. Only a local master, which has no other
    machine to share with, gets a temporary one when none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="seekgrain-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on shared storage so that a lost executor costs no recomputation."""
    _with_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table beside the checkpoints: for wide or large tables, of which later steps
    read only the columns they use. The shuffle files that the table was made from go as soon as it stands.
    """
    spark = df.sparkSession
    path = f"{_with_checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def hint_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    """Hint a broadcast of a table whose bound has been checked upstream."""
    return F.broadcast(df) if bounded else df


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows
