"""Hash dedup, appends to the vector table, and probes of registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key all stay.

    The least row of a key is an aggregate with map-side partial results, so a key
    that a third of the rows share costs one row a task.
    """
    names = rows.columns
    ordered = [*order, *(c for c in names if c not in order and c != key)]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*ordered)).alias("row"))
    return kept.select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in names)).unionByName(rows.where(F.col(key).isNull()))


def upsert(batch: DataFrame, target: DataFrame, key: str = "hash_norm", order: list[str] | None = None, dedupe: bool = True) -> DataFrame:
    """The rows to append: first of each hash, and no hash that the target has."""
    if not dedupe:
        return batch
    fresh = first_of_each(batch, key, order or [])
    return fresh.join(target.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(batch.columns)


def upsert_counts(batch: DataFrame, target: DataFrame, key: str = "hash_norm", order: list[str] | None = None, dry_run: bool = False) -> DataFrame:
    """inserted, skipped. A dry run inserts none and skips all that have a hash."""
    total = batch.agg(F.count("*").alias("total"), F.count(key).alias("hashed"))
    if dry_run:
        return total.select(F.lit(0).cast("long").alias("inserted"), F.col("hashed").alias("skipped"))
    done = upsert(batch, target, key, order).agg(F.count("*").alias("inserted"))
    return total.crossJoin(F.broadcast(done)).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"))


def unseen(entries: DataFrame, registry: DataFrame, key: str = "sha256") -> DataFrame:
    return entries.join(registry.select(key).distinct(), key, "left_anti")


# Media types by file extension.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "md": "text/markdown",
}


def sync_rejections(entries: DataFrame, registry: DataFrame, base_dir: str, allowed: list[str], max_bytes: int) -> DataFrame:
    """Adds ``reject_reason``: the first test that an entry fails, or null.

    ``entries``: download_success, path, exists, extension, size_bytes, sha256.
    Extensions are looked up as media types before they meet the allow-list.
    """
    media = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    marked = entries.withColumn("_media", F.try_element_at(media, F.lower(F.ltrim(F.col("extension"), F.lit(".")))))
    seen = registry.select("sha256").distinct().withColumn("_seen", F.lit(True))
    joined = marked.join(seen, "sha256", "left")
    inside = F.col("path").startswith(base_dir.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    reason = (
        F.when(~F.coalesce("download_success", F.lit(False)), "download_failed")
        .when(F.coalesce("path", F.lit("")) == "", "missing_path")
        .when(~inside, "outside_base_dir")
        .when(~F.coalesce("exists", F.lit(False)), "file_not_found")
        .when(F.col("_media").isNull(), "extension_not_allowed")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(F.col("_seen"), "duplicate")
        .when(~F.col("_media").isin(*allowed), "type_not_allowed")
    )
    return joined.withColumn("reject_reason", reason).drop("_media", "_seen")


def parent_links(chunks: DataFrame) -> DataFrame:
    """Chunk ids of parents: a figure's parent_idx is the local_idx of a chunk of its
    document; where several have it, the last counts."""
    owner = chunks.groupBy("doc_id", F.col("local_idx").alias("parent_idx")).agg(F.max_by("chunk_id", "chunk_seq").alias("parent_chunk_id"))
    return chunks.join(owner, ["doc_id", "parent_idx"], "left")


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known, key, "left_anti")


def conflicting(jobs: DataFrame, wanted: DataFrame, ids: str = "upload_ids") -> DataFrame:
    """Active jobs that hold an upload which is wanted (upload_id)."""
    active = jobs.where(F.lower("status").isin("queued", "running"))
    return active.withColumn("upload_id", F.explode(ids)).join(wanted, "upload_id", "left_semi").drop("upload_id").distinct()


def mean_pool(parts: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The mean of each item's vectors, element by element, not normalised anew."""
    each = parts.select(*keys, F.posexplode(vector).alias("at", "value"))
    mean = each.groupBy(*keys, "at").agg(F.avg("value").alias("value"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(vector))


def latest_state(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key (ties: the greatest row)."""
    others = [c for c in rows.columns if c not in (key, ts)]
    last = rows.groupBy(key).agg(F.max(F.struct(ts, *others)).alias("row"))
    return last.select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in rows.columns))


def with_next_ids(rows: DataFrame, current: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Ids after the table's largest; ``rows`` is one request's, so its order is small."""
    top = current.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.row_number().over(Window.orderBy(order))).drop("_top")
