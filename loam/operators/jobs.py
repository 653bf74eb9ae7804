"""Ingest jobs: checks before one starts, its states, counters and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states that may follow each state.
NEXT = {None: {"queued"}, "queued": {"running", "failed"}, "running": {"succeeded", "failed"}, "succeeded": set(), "failed": set()}


def next_state(now: str | None, wanted: str) -> str:
    if wanted not in NEXT.get(now, set()):
        raise ValueError(f"a job cannot go from {now} to {wanted}")
    return wanted


def resolve_profile(wanted: str | None, configured: list[str], builtin: list[str], active: str | None = None) -> str:
    """The wanted profile if it is known; else the active, the first configured, or the
    first built-in one."""
    known = [*configured, *builtin]
    if wanted:
        if wanted not in known:
            raise ValueError(f"unknown profile {wanted}")
        return wanted
    if active in known:
        return active
    if not known:
        raise ValueError("no profile is configured")
    return known[0]


def log_tail(log: DataFrame, job: str = "job_id", order: str = "line_no", n: int = 40) -> DataFrame:
    """The last lines of each job: array of lines, in order. Tasks keep no more than
    that many of a job's lines before the shuffle's merge."""
    from pyspark.sql import Window

    w = Window.partitionBy(job).orderBy(F.desc(order))
    last = log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]).alias("tail"))


def parsed_summary(line: Column) -> Column:
    """struct<docs, chunks, inserted, skipped> of a summary line, or null."""
    value = lambda k: F.nullif(F.regexp_extract(line, rf"\b{k}=(\d+)", 1), F.lit("")).cast("long")
    complete = line.contains("docs=") & line.contains("chunks=") & line.contains("inserted=")
    return F.when(complete, F.struct(*(value(k).alias(k) for k in ("docs", "chunks", "inserted", "skipped"))))


def metrics(jobs: DataFrame) -> DataFrame:
    """Duration and chunks a second of jobs (started_at, finished_at, chunks_total)."""
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    seconds = seconds / 1e6
    rate = F.when(seconds > 0, F.round(F.col("chunks_total") / seconds, 3)).otherwise(0.0)
    return jobs.withColumn("duration_sec", F.round(seconds, 3)).withColumn("throughput_chunks_per_s", rate)


def section_ranges(prefixes: DataFrame, keys: list[str], order: str, prefix: str = "prefix") -> DataFrame:
    """The first and last different prefix of each group, as ``first-last``."""
    per = prefixes.where(F.col(prefix).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, prefix))), lambda x: x[prefix])).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    return per.select(*keys, F.when(F.size("p") > 1, F.concat(first, F.lit("-"), last)).otherwise(first).alias("section_range"))
