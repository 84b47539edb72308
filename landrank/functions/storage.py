"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Where that is unset, a local session gets a folder of its own; on a
    cluster this is an error, since a machine-local folder would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="landrank-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Lists of the paths that are stored while they are open, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, the same for all later reads.

    No mark of success is written, which nothing reads: where Hadoop's native library is missing, each local file costs the
    JVM two processes (``chmod`` of file and checksums).
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    df.write.options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or file, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is stored within it.

    For work whose results have by then been written; what comes out of it unwritten would read tables that are gone.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            removed(spark, path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever the working folder.

    A cluster whose nodes do not share that path gets the package with the job (``--py-files``).
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
