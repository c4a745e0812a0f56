"""Reading the input tables, and tables an operator writes for itself."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``; only the columns a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is read in fewer partitions than there are, else as it is.

    For work that is heavy for each row, on inputs of a few row groups; a large
    input has more partitions than cores and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder of this machine is taken.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already gone; the cluster's own cleaning takes over
        pass


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write for themselves inside the block are removed at its end, when their results have been used."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table into the shared folder and read again.

    Cuts the lineage so that a lost executor costs a re-read, and lets several
    consumers use the result of one expensive pass.  The table is removed at the end
    of the surrounding :func:`scratch`, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is.

    Spark then picks a shuffled join for what is too large.  Meant for narrow
    rows whose count is cheap; the count is the checked size.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or ``ValueError`` naming the missing columns in sorted order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
