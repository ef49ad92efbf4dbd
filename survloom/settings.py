"""Session-level choices shared by the operators."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Rows that one task may hold in memory as one group (see operators.concordance).
GROUP_ROWS = 1 << 16

_kept: list[DataFrame] = []


class Scope:
    """The staged folders and kept frames of one job; see :func:`scope`."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []
        self.folders: list[str] = []


_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Own what the operators called inside keep and stage, and drop it at the end.

    Write a job's results before the scope ends: frames that read its folders cannot be
    read after it. Scopes may be nested; each drops its own.
    """
    mine = Scope()
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        for frame in mine.frames:
            frame.unpersist()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in mine.folders:
            path = hadoop.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a fresh temporary
    folder, which is remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="survloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    For expensive inputs of loops (cross-fitting, Newton steps): losing an
    executor then costs a file read, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    owner = _scope.get()
    if owner is not None:
        owner.folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that the caller reads more than once; see :func:`release`.

    Lost blocks are recomputed from the lineage, so this is safe on executors
    that come and go.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    owner = _scope.get()
    (_kept if owner is None else owner.frames).append(df)
    return df


def release() -> None:
    """Drop everything :func:`keep` holds outside scopes. Results stay valid, they recompute."""
    while _kept:
        _kept.pop().unpersist()


def bucket_count(spark: SparkSession) -> int:
    """Ranges for ordered work: two per shuffle partition, so AQE can pack them."""
    return max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
