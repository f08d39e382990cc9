"""Written intermediates: tables in a folder that all executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: How many times the bytes of its files a table takes in memory: keys that count up take a third of a byte a row by Spark's share of the file, and 40 bytes in a join.
IN_MEMORY = 128.0

_own_dirs: dict[str, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder of the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _own_dirs[context.applicationId]


def sized(spark: SparkSession) -> None:
    """From now on the session sizes file scans by their rows in memory, unless its owner has set a factor.

    By the size of its files alone, a table of ten million keys is broadcast and fills the driver. What turns out small as it is read is broadcast by adaptive execution.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) == 1.0:
        spark.conf.set(factor, str(IN_MEMORY))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the store that holds it; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that :func:`written` writes inside the block, in this thread; it is removed when the block ends, so no DataFrame over it may outlive the block."""
    folder = f"{work_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        remove(spark, folder)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once and read back; its schema is known, so no job looks for one in the files. ``path`` names a place of the caller's own, which no scratch block removes."""
    path = path or f"{_scratch.get() or work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_any(df: DataFrame, name: str, condition: Column | bool = True) -> tuple[DataFrame, bool]:
    """``df`` written and read back, and whether a row met the condition, which the write itself observes."""
    seen = Observation()
    met = F.lit(condition) if isinstance(condition, bool) else condition
    table = written(df.observe(seen, F.count_if(met).alias("n")), name)
    return table, bool(seen.get["n"])
