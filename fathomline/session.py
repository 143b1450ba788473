"""Session set-up and the two ways this library cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fathomline", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` of the session is used where it is set. Where it
    is unset, a local session gets a temporary folder; on a cluster that would
    lose data with the machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(spark.sparkContext, "_fathomline_folder", None)
    if folder is None:
        keep = tempfile.TemporaryDirectory(prefix="fathomline-")
        folder = f"file://{keep.name}"
        spark.sparkContext._fathomline_keep, spark.sparkContext._fathomline_folder = keep, folder
    return folder


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows dealt out over the cores where it has less than half as many splits, as of one file of one row group.

    For what costs much more for each row than moving it. A large table has
    more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


_written: list[tuple[SparkSession, str]] = []


def _forget(since: int = 0) -> None:
    """Delete the tables written after the first ``since``."""
    gone, _written[since:] = _written[since:], []
    for spark, path in gone:
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that :func:`cut` writes inside the block are deleted at its end; results must be written or collected in it.

    Without such a block they stay until the driver ends, as a lazy result may
    still read them.
    """
    since = len(_written)
    try:
        yield
    finally:
        _forget(since)


atexit.register(_forget)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends in a replicated, columnar table, so later passes prune
    columns and a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
