"""What the operators of this folder share: tables in the shared folder, Arrow passes, batches of bounded size.

Identity of rows.  ``doc_id`` may be null or repeated, so operators that must tell rows apart name them by file and place
in the file (``placed``), which every later read of the files sees again, even if an executor is lost.  Rows that do not
come straight from files are first written to the shared folder.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import importable, shared_folder, stored

__all__ = [
    "arrow_pass", "bounded_batches", "carried", "field_of", "handed_on", "id_and_text", "importable", "placed", "shared_folder", "stored", "table", "texts_of",
]

#: Rows and bytes of one Arrow batch; with these a Python worker holds some tens of MB whatever the partition's size.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches in rows and bytes, so that long texts do not pile up in a worker.

    The settings hold when a plan runs, after the operator has returned it, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, and freed text would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it does without
        pass


#: What a worker process keeps from task to task, as functions that let go of it, and the pass that it is at.
_kept: list = []
_pass: list[str] = [""]


def keeps(let_go) -> None:
    """Registers a cache of a worker process; it lasts while the worker is at one pass."""
    _kept.append(let_go)


def entered(name: str) -> None:
    """A worker begins a task of a pass: what it kept for another goes, since workers outlive stages."""
    if _pass[0] != name:
        _pass[0] = name
        for let_go in _kept:
            let_go()
        give_back()


def arrow_pass(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches; a worker gives back what its batches took when the task ends."""
    bounded_batches(df.sparkSession)
    importable(df.sparkSession)
    name = f"{function.__module__}.{function.__qualname__}"

    def run(batches):
        entered(name)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, at: int):
    """The texts of a column as str, null as empty, one at a time."""
    for value in batch.column(at):
        yield value.as_py() or ""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra ones, whatever their names, neither clash nor move."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


PLACE = ["__file", "__row"]


def carried(docs: DataFrame) -> DataFrame:
    """One column ``row``, a struct of the caller's columns under names of our own: whatever theirs are, none clashes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).select(F.struct(*names).alias("row"))


def field_of(docs: DataFrame, name: str) -> str:
    """The field of ``row`` that holds the caller's column ``name``."""
    exact = [i for i, c in enumerate(docs.columns) if c == name]
    alike = exact or [i for i, c in enumerate(docs.columns) if c.lower() == name]
    if not alike:
        raise ValueError(f"documents have no column {name}")
    return f"c{alike[0]}"


def handed_on(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The caller's columns again, from ``row``."""
    return found.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def plain_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file, the same in every run: a scan, perhaps with columns or rows left out."""
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") or not plan.deterministic():
            return False
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
    return True


def placed(docs: DataFrame) -> DataFrame:
    """``row`` (as ``carried``) with ``__file`` (hash of the file's path) and ``__row`` (place in it), which name a row.

    Places are taken from plain scans only; what comes of joins, generators or random choices is stored first, since
    there several rows may stand at one place, or other rows in the next run.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]

    def at(plain: DataFrame) -> DataFrame:
        meta = plain.metadataColumn("_metadata")
        return plain.select(F.struct(*names).alias("row"), F.xxhash64(meta.getField("file_path")).alias("__file"), meta.getField("row_index").alias("__row"))

    plain = docs.toDF(*names)
    if plain_scan(docs):
        try:
            return at(plain)
        except AnalysisException:  # files of a format that does not number its rows
            pass
    return at(stored(plain, "documents"))
