"""Structured Streaming flows: incremental sync, sessions, usage windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import dedup
from loam.sources import tables


FILE = "path string, modificationTime timestamp, length long, content binary"


def incremental_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder: path, sha256, length, content."""
    raw = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime", "content")


def first_copies(rows: DataFrame) -> DataFrame:
    """Of rows of equal sha256 the one with the least path."""
    others = [c for c in rows.columns if c != "sha256"]
    return rows.groupBy("sha256").agg(F.min_by(F.struct(*others), "path").alias("r")).select("sha256", "r.*").select(rows.columns)


def _seen(spark: SparkSession, registry_path: str, schema: str, n: int) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(registry_path).where(F.col("batch") < n).select("sha256").distinct()
    except Exception as e:  # the first run has no registry yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "sha256 string")


def sync_once(files: DataFrame, registry_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], registry_schema: str = "sha256 string, path string, batch long") -> None:
    """One scheduled run over what is new: contents that the registry (a table of
    hashes) has go, of equal ones in a run the least path stays, the rest go to ``sink``.

    A batch that runs again after a failure finds its own rows of the registry under
    its number and does not take them for seen. What is fresh is found once and written;
    the sink and the registry read that table.
    """
    spark = files.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        fresh = tables.written(first_copies(rows.join(_seen(spark, registry_path, registry_schema, n), "sha256", "left_anti")), "sync-batch")
        sink(fresh, n)
        fresh.select("sha256", "path", F.lit(n).cast("long").alias("batch")).write.mode("append").parquet(registry_path)
        tables.dropped(fresh)

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


UPLOADS = "sha256 string, path string, name string, extension string, content_type string, size_bytes long, content binary, metadata map<string,string>, tags array<string>"
REJECTED = "path string, name string, sha256 string, reject_reason string"


def sync_changes(changes: DataFrame, folder: str, checkpoint: str, base_dir: str, allowed: list[str], max_bytes: int) -> None:
    """One run over a stream of remote changes: those that pass the sync filters go to
    ``folder``/uploads, once for each content, the others with their reason to
    ``folder``/rejected, and the hashes to ``folder``/registry.

    A batch writes each of the three below its number and overwrites what an earlier try of
    the same batch left; the registry, written last, counts for later batches alone. So a run
    that was killed anywhere goes on without loss or doubles.
    """
    spark = changes.sparkSession
    uploads, rejected, registry = (f"{folder}/{name}" for name in ("uploads", "rejected", "registry"))

    def batch(rows: DataFrame, n: int) -> None:
        seen = _seen(spark, registry, "sha256 string, batch long", n)
        judged = tables.written(dedup.sync_rejections(rows, seen, base_dir, allowed, max_bytes), "sync-judged")
        own = f"batch={n}"
        meta = {"item_id": "item_id", "etag": "etag", "url": "url", "extension": "extension", "target_directory": "target_directory"}
        entries = F.map_filter(F.create_map(*(x for k, c in meta.items() for x in (F.lit(k), F.col(c))), F.lit("modified"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")), lambda k, v: v.isNotNull())
        tags = F.array(F.lit("source:remote"), F.concat(F.lit("site:"), "site"), F.concat(F.lit("dir:"), "target_directory"))
        kinds = F.create_map(*(F.lit(x) for pair in dedup.MEDIA_TYPES.items() for x in pair))
        good = first_copies(judged.where("reject_reason is null")).select("sha256", "path", "name", "extension", F.try_element_at(kinds, F.col("extension")).alias("content_type"), "size_bytes", "content", entries.alias("metadata"), tags.alias("tags"))
        good.write.mode("overwrite").parquet(f"{uploads}/{own}")
        judged.where("reject_reason is not null").select("path", "name", "sha256", F.coalesce("error", "reject_reason").alias("reject_reason")).write.mode("overwrite").parquet(f"{rejected}/{own}")
        spark.read.schema(UPLOADS).parquet(f"{uploads}/{own}").select("sha256", "path").write.mode("overwrite").parquet(f"{registry}/{own}")
        tables.dropped(judged)

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_updates(events: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Last seen of each session, for an update-mode sink."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("events"))


def usage_windows(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Interactions and value by window and type; rows later than ``late`` are let go."""
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
