"""Helpers that depend on the running session: table paths, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df parted by keys into as many partitions as shuffles have, which adaptive execution leaves as they are: for
    groups whose work, not whose bytes, must be spread."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders of the tables that this process has written, with their sessions.
_WRITTEN: list[tuple[str, SparkSession]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises df as a table in the shared checkpoint folder, so that several consumers read the columns they need
    of it instead of computing it again, and the loss of an executor costs nothing. forget() removes it."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append((folder, spark))
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget() -> None:
    """Removes the tables that cut_lineage has written; for when no DataFrame made from them is needed any more.
    Runs by itself when the process ends."""
    while _WRITTEN:
        folder, spark = _WRITTEN.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder is the cluster's to clean
            continue


atexit.register(forget)


#: Bytes that a broadcast may take.
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only where a scan proves at most max_rows rows and max_bytes bytes; the join shuffles otherwise."""
    width = F.octet_length(F.to_json(F.struct("*"))) + 16 * len(df.columns)
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


@contextmanager
def quick_building() -> Iterator[None]:
    """Large plans are built without a call site for each expression, which takes several calls to the JVM apiece."""
    from pyspark.errors import utils

    before = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = before
