"""Tables that outlive the loss of executors: Parquet in the folder that all of them share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (a model, centers, ids) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes, as Parquet has them, of the rows that a task reads to send them all through a shuffle: it may hold them until it
#: ends, as rows that are about ten times as large.
SPLIT_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local folder that is then set, if all tasks run on this machine;
    else ValueError, as each executor would write to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_staged: list[tuple[object, object]] = []


def _clear() -> None:
    for fs, path in _staged:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone at exit
            return


def written(df: DataFrame, copies: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts its lineage and outlives the loss of any executor.

    With ``copies``, row groups are small enough for ``splits``. Tables go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", SPLIT_BYTES // copies) if copies else df.write).parquet(path)
    if not _staged:
        atexit.register(_clear)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _staged.append((jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def splits(spark: SparkSession, copies: int = 1) -> Iterator[None]:
    """Actions inside read at most SPLIT_BYTES a task, or a part of that where each row is sent ``copies`` times. Spark takes
    the size of splits from the session only, which has its own again afterwards."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, min(SPLIT_BYTES // copies, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """As ``written``, in ``n`` buckets by ``key``, so that grouping by it moves no row. It has an entry in the session's catalog
    while the driver's Python runs."""
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{name}"
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    if not _staged:
        atexit.register(_clear)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _staged.append((jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath))
    return spark.table(name)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` (BROADCAST_ROWS) rows; ``df`` must be cheap to count."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
