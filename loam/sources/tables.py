"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without one, as in tests, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loam-tables-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """``df`` as a Parquet table, in folders by ``partition``, read back.

    What follows reads the table, whoever of the executors is lost; a filter on a
    partition column reads its folders alone. ``dropped`` deletes it.
    """
    path = f"{shared_folder(df.sparkSession)}/loam/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    order = [f for f in df.schema if f.name not in partition] + [f for f in df.schema if f.name in partition]
    out = df.sparkSession.read.schema(type(df.schema)(order)).parquet(path)
    out._loam_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    for t in tables:
        sc = t.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(t._loam_path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
