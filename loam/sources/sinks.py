"""Vector tables, alias views, exports and generated manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import sanitize
from loam.operators.dedup import upsert
from loam.sources.manifest import sniffed_type

EXPORT = ["id", "created_at", "user_id", "session_id", "session_short", "rating", "category", "question", "answer_preview", "comment", "mode", "client", "ui_version"]


def ensure_table(spark: SparkSession, name: str, schema: str, dim: int | None) -> None:
    """Create the table, or require that its vectors have the dimension."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet TBLPROPERTIES ('dim' = '{dim or 0}')")
        return
    fields = {f.name: f.dataType.simpleString() for f in spark.table(name).schema}
    if not fields.get("embedding", "").startswith("array<"):
        raise ValueError(f"{name}: embedding is no vector")
    held = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'dim'").collect()
    if dim and held and held[0]["value"] not in ("0", str(dim)):
        raise ValueError(f"{name}: has dimension {held[0]['value']}, not {dim}")


def append_vectors(rows: DataFrame, name: str, dim: int, order: list[str], dedupe: bool = True) -> None:
    """Append rows whose vectors have the dimension, new hashes alone."""
    spark = rows.sparkSession
    target = spark.table(name)
    fresh = upsert(rows.where(F.size("embedding") == dim), target, "hash_norm", order, dedupe)
    fresh.select(target.columns).write.mode("append").insertInto(name)


def swap_alias(spark: SparkSession, alias: str, table: str) -> None:
    """Point the alias at a table; refuse to replace anything but a view."""
    if spark.catalog.tableExists(alias) and spark.catalog.getTable(alias).tableType not in ("VIEW", "TEMPORARY"):
        raise ValueError(f"{alias} exists and is no view")
    spark.sql(f"CREATE OR REPLACE VIEW {alias} AS SELECT id, text, to_json(metadata) AS metadata, embedding FROM {table}")


def swap_alias_after(spark: SparkSession, alias: str, table: str, ensured: int, wanted: bool = True, dry_run: bool = False, evaluate: Callable[[], None] | None = None) -> bool:
    """The last step of an ingest: the evaluation, which still reads the old table through
    the alias, then the swap, where it is wanted and a table was ensured. Says whether
    the alias moved."""
    if evaluate is not None:
        evaluate()
    if dry_run or not wanted or not ensured:
        return False
    swap_alias(spark, alias, table)
    return True


def export_csv(rows: DataFrame, path: str) -> None:
    """The fixed columns as CSV with a header, each file in UTF-8 with its mark."""
    first, *others = EXPORT
    marked = rows.select(F.col(first).alias("\ufeff" + first), *others)
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def dual_write(primary: Callable[[DataFrame], None], secondary: Callable[[DataFrame], None], log: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the second write may fail without failing the first."""

    def write(batch: DataFrame, _: int) -> None:
        primary(batch)
        try:
            secondary(batch)
        except Exception as e:  # noqa: BLE001  by contract the second copy is best effort
            log(f"secondary write failed: {e}")

    return write


def generated_manifest(uploads: DataFrame, job: dict) -> DataFrame:
    """One manifest entry an upload: tags of both, the job's language unless auto."""
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.lit(job.get("tags") or []).cast("array<string>"))))
    lang = F.col("lang") if job.get("lang", "auto") == "auto" else F.lit(job["lang"])
    return uploads.select("path", F.col("upload_id").alias("doc_id"), F.lit(job.get("profile")).alias("profile"), tags.alias("tags"), lang.alias("lang"), F.lit(job.get("priority")).cast("int").alias("priority"))


def parse_tags(raw):
    """Tags from a JSON array or a comma-separated text."""
    listed = F.from_json(raw, "array<string>")
    parts = F.when(F.trim(raw).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(raw, ","))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def append_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Append the named columns as CSV parts, each with its header."""
    rows.select(*columns).write.mode("append").option("header", True).csv(path)


def replace_snapshot(rows: DataFrame, path: str) -> None:
    """A table kept as one JSON snapshot. The new one is written beside the old, then a
    pointer file is put in place by a rename, so readers see the old or the new one."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{version}")
    files, Path = _store(spark, path)
    fresh, pointer = Path(f"{path}/_{version}"), Path(f"{path}/_current")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    old = _current(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
    options[0] = context.Options.Rename.OVERWRITE
    context.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(pointer), options)
    if old:
        # the last but one stays for readers that have begun
        for status in files.listStatus(Path(path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in (old, version):
                files.delete(status.getPath(), True)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot's rows; none before the first one."""
    version = _current(spark, path)
    return spark.read.schema(schema).json(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def _store(spark: SparkSession, path: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def _current(spark: SparkSession, path: str) -> str | None:
    files, Path = _store(spark, path)
    pointer = Path(f"{path}/_current")
    if not files.exists(pointer):
        return None
    return bytes(files.open(pointer).readAllBytes()).decode()


def append_feedback(rows: DataFrame, table: str) -> None:
    """Feedback as rows of a table: the comment redacted, metadata as JSON text."""
    safe = sanitize.sanitize(rows, "comment").withColumn("comment", F.col("sanitized")).drop("sanitized", "redactions")
    target = rows.sparkSession.table(table)
    ready = safe.withColumn("metadata_json", F.to_json("metadata")).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    ready.select(target.columns).write.mode("append").insertInto(table)


def append_usage(rows: DataFrame, table: str) -> None:
    """Logins or interactions as rows of their table; columns that are not given are null."""
    target = rows.sparkSession.table(table)
    given = {c.lower() for c in rows.columns}
    rows.select(*(F.col(f.name) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema)).write.mode("append").insertInto(table)


def staged_uploads(files: DataFrame, allowed: list[str], largest: int, root: str = "staging") -> tuple[DataFrame, DataFrame]:
    """Uploads that may be stored, with their place, checksum and type, and those refused.

    files: name, content, source, tags, lang, at (the time). Names lose folders and signs;
    the place is root/year/month/day/id/name. Refused are empty, too large, and
    types that are not allowed.
    """
    base = F.regexp_extract(F.replace("name", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    clean = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")
    rows = files.withColumns({"filename": F.when(F.regexp_replace(clean, r"[._]", "") == "", "upload").otherwise(clean), "upload_id": F.uuid(), "size_bytes": F.coalesce(F.length("content"), F.lit(0)).cast("long")})
    rows = rows.withColumn("content_type", F.lower(sniffed_type(F.col("content"), F.col("filename"))))
    reason = F.when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > largest, "too large").when(~F.coalesce(F.col("content_type"), F.lit("")).isin([a.lower() for a in allowed]), "type not allowed")
    rows = rows.withColumn("reason", reason)
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("auto"))))
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("manual-upload"))
    good = rows.where("reason is null").select(
        "upload_id", "filename", "size_bytes", "content_type", source.alias("source"), parse_tags(F.coalesce("tags", F.lit(""))).alias("tags"), F.when(lang.isin("auto", "es", "en", "pt"), lang).otherwise("auto").alias("lang_hint"),
        F.concat_ws("/", F.lit(root), F.date_format("at", "yyyy/MM/dd"), "upload_id", "filename").alias("storage_path"), F.sha2("content", 256).alias("checksum_sha256"), "at", "content",
    )
    return good, rows.where("reason is not null").select("name", "size_bytes", "content_type", "reason")


def figure_files(figures: DataFrame, put: Callable[[str, bytes], None]) -> DataFrame:
    """Hand each figure's bytes to ``put`` (a writer for the store in use) inside the
    tasks; returns path, sha256 and length. ``put`` must give the same file when a
    task runs twice. figures: doc_id, n, extension, content."""
    schema = "path string, sha256 string, length long"
    named = figures.select(F.format_string("%s/img_%03d.%s", "doc_id", "n", "extension").alias("path"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("length"), "content")

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                put(path, bytes(content))
            yield frame[["path", "sha256", "length"]]

    return named.mapInPandas(run, schema)
