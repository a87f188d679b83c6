"""Helpers of the training-data operators: shared tables, components, word patterns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a counted table may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Removes the shuffle files of a job when it ends; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own temporary one only for a local master without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="seekgrain-shared-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``written``; the shuffle files that the table was made from go as soon as it stands."""
    conf = df.sparkSession.conf
    was = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return written(df)
    finally:
        conf.set(SHUFFLE_CLEANUP, was)


def dropped(*tables: DataFrame) -> None:
    """Remove ``written`` tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def counted_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written table only when its counted rows stay within ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def giving_back(run):
    """``run`` over Arrow batches; at the end of a task the worker, which later tasks use again, gives free memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def remainder_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 marks a held-out row."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(remainder_of_id(name) == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(a, b)``, for every node that is not its own.

    Alternating large and small stars: every node hands its neighbours to the smallest one it knows
    until only stars are left, in a logarithmic number of rounds. Each round is a table in the shared
    folder, minima are combined before the shuffle, and a hub's edges stay splittable rows.
    """
    pairs = written(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    mark = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(least, "b")
        small = met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        pairs = written(small)
        was, mark = mark, _mark(pairs)
        if was == mark:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
