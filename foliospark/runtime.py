"""What a run needs from its cluster: the package on executors, and tables in a folder that all can see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application, for functions that run in Python there.

    Also bounds the bytes of an Arrow batch, unless the session does: 10,000 long texts are much for one worker. The setting holds for the session.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if getattr(ship, "app", None) == app:
        return
    ship.app = app
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foliospark-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}-src", "zip", f"{folder}/tree"))


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers are kept between tasks, beside a JVM that grows."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(scratch_dir, "own"):
        scratch_dir.own = tempfile.TemporaryDirectory(prefix="foliospark-")
        atexit.register(scratch_dir.own.cleanup)
    return f"file://{scratch_dir.own.name}"


#: Scratch tables that this process has written and not removed.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends, or before by ``Scratch``."""
    path = f"{scratch_dir(spark)}/foliospark-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _WRITTEN.append(path)
    return path


class Scratch:
    """Scratch tables of a step: ``end`` removes those written since it began, but for the given ones.

    To be called when the given tables are written and nothing else of the step is read any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.begun = spark, len(_WRITTEN)

    def end(self, *keep: DataFrame) -> None:
        kept = {getattr(df, "scratch_path", None) for df in keep}
        for path in [p for p in _WRITTEN[self.begun :] if p not in kept]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            _WRITTEN.remove(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage once, and survives a lost executor.

    Unlike checkpoint(), a narrow plan runs once.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
