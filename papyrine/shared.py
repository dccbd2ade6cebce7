"""The shared folder of a cluster, and tables kept there between the steps of a job."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
_MADE: ContextVar[list[str] | None] = ContextVar("papyrine-made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a folder of
    this machine is taken if master and executors are this one process, as in tests; on any other master that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyrine-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/papyrine/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/papyrine/" in folder:
            _delete(spark, folder)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths that are made inside, for :func:`sweep`."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def sweep(spark: SparkSession, made: list[str], needed: DataFrame) -> None:
    """Delete what is at the paths, but for what ``needed`` reads."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in needed.inputFiles()}
    for path in [p for p in made if p.rsplit("/", 1)[-1] not in read]:
        _delete(spark, path)
        made.remove(path)
