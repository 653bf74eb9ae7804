"""Feedback, users and usage: filters, pages, derived columns and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import strip_ws, truncated

METADATA = "question string, answer_preview string, mode string, message_id string, client string, ui_version string"


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; filters come before it, so their totals are whole."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit is 1 to 100, offset 0 or more")
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def page_info(total: int, limit: int, offset: int) -> dict:
    return {"total": total, "has_prev": offset > 0, "has_next": offset + limit < total}


def filter_feedback(rows: DataFrame, user_id: int | None = None, category: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Equal user and category, created_at from and to (both ends count); a date
    that cannot be read is no filter."""
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    for bound, low in ((since, True), (until, False)):
        if bound:
            at = F.try_to_timestamp(F.lit(bound))
            test = F.col("created_at") >= at if low else F.col("created_at") <= at
            rows = rows.where(at.isNull() | test)
    return rows


def filter_users(rows: DataFrame, email: str | None = None, status: str | None = None) -> DataFrame:
    if email:
        rows = rows.where(F.lower("email").contains(email.lower()))
    return rows.where(F.col("status") == status) if status else rows


def login(rows: DataFrame, email: str) -> DataFrame:
    return rows.where((F.lower("email") == email.lower()) & ~F.col("status").isin("suspended", "deleted"))


def rating_sign(c: Column) -> Column:
    """+1, -1 or null for the spellings of a rating."""
    low = F.lower(F.trim(c.cast("string")))
    number = low.try_cast("double")
    return F.when(low.isin("like", "+1", "1", "positive"), 1).when(low.isin("dislike", "-1", "negative"), -1).when(low.isin("all", ""), F.lit(None)).when(number > 0, 1).when(number < 0, -1)


def derive_feedback(rows: DataFrame) -> DataFrame:
    """What the feedback table shows of each row (id, user_id, session_id, rating,
    comment, metadata_json, created_at); unreadable metadata is flagged."""
    raw = F.coalesce("metadata_json", F.lit(""))
    parsed = F.from_json(raw, METADATA)
    text = lambda c: strip_ws(F.coalesce(c, F.lit("")))
    rows = rows.withColumn("_m", parsed).withColumn("metadata_error", (strip_ws(raw) != "") & F.expr("try_parse_json(metadata_json)").isNull())
    rows = rows.withColumns({c: text(F.col(f"_m.{c}")) for c in ("question", "answer_preview", "message_id", "client", "ui_version")})
    mode = text(F.col("_m.mode"))
    rows = rows.withColumn("mode", F.when(mode == "", "n/a").otherwise(mode)).withColumn("mode_normalized", F.lower("mode"))
    tag = F.when((F.col("client") != "") & (F.col("ui_version") != ""), F.concat_ws("@", "client", "ui_version")).when(F.col("client") != "", F.col("client")).when(F.col("ui_version") != "", F.concat(F.lit("@"), F.col("ui_version"))).otherwise("")
    liked = F.coalesce(F.col("rating").cast("string").isin("1", "+1", "like"), F.lit(False))
    user = F.coalesce(F.nullif(F.col("user_id").cast("string"), F.lit("")), F.lit("anonymous"))
    short = F.substring(F.coalesce("session_id", F.lit("")), 1, 8)
    comment = text(F.col("comment"))
    one_line = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    question, answer = truncated(one_line(F.col("question")), 60), truncated(one_line(F.col("answer_preview")), 80)
    return rows.withColumns(
        {
            "client_tag": tag,
            "rating_label": F.when(liked, "like").otherwise("dislike"),
            "session_short": short,
            "user_display": F.when(short != "", F.concat_ws(" | ", user, short)).otherwise(user),
            "comment": comment,
            "comment_truncated": truncated(comment),
            "question_truncated": truncated(F.col("question")),
            "qa_preview": F.concat_ws(" | ", F.nullif(question, F.lit("")), F.nullif(answer, F.lit(""))),
            "search_blob": F.lower(F.concat_ws(" ", "question", comment)),
        }
    ).drop("_m")


def filter_derived(rows: DataFrame, rating: str | None = None, mode: str | None = None, user: str | None = None, search: str | None = None) -> DataFrame:
    if rating:
        rows = rows.where(F.col("rating_label") == rating)
    if mode:
        none = ("n/a", "na", "")
        rows = rows.where(F.col("mode_normalized").isin(*none) if mode.lower() in none else F.col("mode_normalized") == mode.lower())
    if user:
        both = F.concat_ws("\n", F.col("user_id").cast("string"), "session_id")
        rows = rows.where(F.lower(both).contains(user.lower()))
    return rows.where(F.col("search_blob").contains(search.lower())) if search else rows


def feedback_kpis(derived: DataFrame) -> DataFrame:
    """Likes, dislikes, their percentages and the counts of modes; zeros if empty."""
    none = F.col("mode_normalized").isin("n/a", "na", "")
    out = derived.agg(
        F.count_if(F.col("rating_label") == "like").alias("likes"),
        F.count_if(F.col("rating_label") == "dislike").alias("dislikes"),
        *(F.count_if(F.col("mode_normalized") == m).alias(f"mode_{m}") for m in ("rag", "hybrid", "fallback")),
        F.count_if(none).alias("mode_none"),
    )
    total = F.col("likes") + F.col("dislikes")
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0))
    return out.withColumn("like_pct", share("likes")).withColumn("dislike_pct", share("dislikes"))


def merge_users(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot after changes: new keys are added, given (non-null) columns set."""
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in changes.columns else F.col(f"a.{c}").alias(c) for c in current.columns))


def soft_delete(users: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return users.join(gone, key, "left").withColumn("status", F.when(F.col("_gone"), "suspended").otherwise(F.col("status"))).select(users.columns)


def hard_delete(users: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return users.join(ids.select(key).distinct(), key, "left_anti").select(users.columns)


def checked_users(users: DataFrame) -> DataFrame:
    """The snapshot; an error where two rows have one e-mail, whatever its case."""
    twice = duplicate_emails(users).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['email']} is taken")
    return users


def latest_runs(runs: DataFrame, n: int = 10, started: str = "started_at") -> DataFrame:
    """The sync runs that started last."""
    return runs.orderBy(F.col(started).desc_nulls_last()).limit(n)


def sync_started(ids: DataFrame, at: Column) -> DataFrame:
    """The first state of runs (sync_id)."""
    return ids.select("sync_id", F.lit("running").alias("status"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"), at.alias("changed_at"))


def sync_finished(states: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """The last state of runs that have a result (sync_id, error; null: success)."""
    running = states.where("status = 'running'").select("sync_id", "started_at")
    done = running.join(results, "sync_id")
    return done.select("sync_id", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "started_at", at.alias("finished_at"), "error", at.alias("changed_at"))


def duplicate_emails(users: DataFrame) -> DataFrame:
    return users.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("n")).where("n > 1")


def sessions(events: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """One row a session: first and last seen, events, the first client."""
    return events.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("events"))


def usage_daily(events: DataFrame, ts: str = "ts", mode: str = "mode") -> DataFrame:
    day = F.date_trunc("day", ts)
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("interactions"), F.countDistinct("user_id").alias("users"), F.count_if(F.col(mode) == "fallback").alias("fallbacks")).withColumn("fallback_rate", F.col("fallbacks") / F.col("interactions"))


def usage_rollup(events: DataFrame, first: str, second: str, value: str) -> DataFrame:
    return events.rollup(first, second).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("level"))


def latency_trend(events: DataFrame, key: str, ts: str, value: str, tie: str, width: int = 7) -> DataFrame:
    """Each event with its change from the one before and a running mean."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return events.withColumn("change", F.col(value) - F.lag(value).over(w)).withColumn("running_mean", F.avg(value).over(w.rowsBetween(-(width - 1), 0)))


def keyset_page(rows: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after a row, without counting past the ones before it."""
    if after is not None:
        rows = rows.where((F.col(ts) < F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def throughput(chunks: Column, seconds: Column) -> Column:
    return F.round(F.try_divide(chunks.cast("double"), seconds), 3)
