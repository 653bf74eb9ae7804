"""Shared helpers: the shared folder, written tables and input columns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder is made and set as the checkpoint
    folder; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="loam-shared-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by the columns of
    ``partition`` (the last ones), and read it back. ``compression``: the session's by default.

    This cuts the lineage at a table that outlives any executor. Whoever has written
    what follows from it may ``release`` it.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nobody reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t._loam_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever kind of store that is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory back when its partition is done,
    since Python workers live on from stage to stage."""

    def freeing(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return freeing


#: Bytes of a batch that goes to a Python worker, and Spark's own bound.
BATCH_BYTES, _SPARKS = 16 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what travels to Python workers at once, which executors hold outside their heap, for
    the rest of the session; a bound that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, str(_SPARKS)).rstrip("b") in (str(_SPARKS), "64m"):
        spark.conf.set(key, str(BATCH_BYTES))


def text_hash(text: str = "text") -> Column:
    """With the id it tells rows apart; equal in all rows whose text is null."""
    return F.xxhash64(F.col(text).cast("string"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` long, ``text_hash`` and ``row``, a struct of all columns, so that no
    column of ``docs`` clashes with one of ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` long and ``text`` string, whatever else ``docs`` holds.

    Rows whose doc_id is null have no identity and are left out; a null text
    stays null.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def texts_with_hash(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``text`` of the rows that have an id."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))


#: Rows of a few numbers each up to which one side of a join is broadcast, after a count.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if a count proves that it is small."""
    return F.broadcast(df) if is_small(df) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
