"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the innermost ``scratch`` block.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # a table near the default 10 MB holds enough rows that one task building its hash table is slower than a shuffle
        .config("spark.sql.autoBroadcastJoinThreshold", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Let Spark split a skewed join even where that costs one more shuffle afterwards.

    Without it a hot order stays in one task when its group-by could reuse the
    join's partitioning.
    """
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the folder of the ``scratch`` block it is asked in."""
    base = _scratch.get() or shared_folder(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables between passes, deleted when the block ends, also by an error.

    Save what is to stay elsewhere before the block ends: a result that still has
    to read such a table cannot leave it. Threads take part if they run in a copy
    of this thread's context.
    """
    path = scratch_path(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it from there.

    Later passes do not recompute it, read only the columns they need, and see
    the same rows even if executors are lost in between.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
