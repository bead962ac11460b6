"""Session helpers: lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; fall back to a local one only if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and start a new lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Remove the files of a frame that ``cut_lineage`` made and that nothing reads any more.

    Spark removes them itself only when the driver collects its garbage, and only if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name`` for a helper column, lengthened until no column of ``taken`` has it (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def bucket(df: DataFrame, key: str, *, tasks_of: int | None = None, per: int = 512) -> Column:
    """A number that deals the values of ``key`` out over buckets of about ``per`` values.

    The number of buckets follows from the number of values, so that a bucket's
    group keeps its size as the table grows; ``tasks_of`` sets it instead.
    """
    if tasks_of is None:
        values = df.agg(F.approx_count_distinct(key)).first()[0] or 0
        tasks_of = max(64, -(-values // per))
    return F.floor(F.pmod(F.xxhash64(key), F.lit(1 << 30)) / ((1 << 30) / tasks_of))
