"""What the training-data operators share: tables, the shared folder, Arrow batches.

Python stages stream Arrow batches of at most ``BATCH_ROWS`` rows, so the memory of
a worker follows the longest rows of one batch and never the size of a partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

BATCH_ROWS = 1000
_OWN: dict[str, str] = {}
_HELD: dict[str, Callable[[], None]] = {}
_SCRATCH: list[list[str]] = []


def release_others(name: str, release: Callable[[], None]) -> None:
    """Workers are used again: what one operator holds goes when another begins."""
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = release


def arrow_session(df: DataFrame) -> SparkSession:
    """The session, ready for ``mapInArrow`` in batches of ``BATCH_ROWS``."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that Spark alone needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set."""
    if set_by_cluster := spark.conf.get("spark.checkpoint.dir", None):
        return set_by_cluster
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    return _OWN.setdefault("dir", tempfile.mkdtemp(prefix="loomspark-"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs the tasks it ran, never the stages before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for held in _SCRATCH[-1:]:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside go at the end; what outlives it is written after."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for p in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` a result that outlives the scratch tables around it."""
    _SCRATCH.append([])
    try:
        return materialize(df, name)
    finally:
        _SCRATCH.pop()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` of a function of one batch, over batches of bounded size."""
    arrow_session(df)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)
