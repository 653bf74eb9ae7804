"""Scalars over maps, dates, ids, paths and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaid(low: Column, high: Column) -> Column:
    """A map with the entries of both; where both have a key, that of ``high``."""
    none = F.create_map().cast("map<string,string>")
    low, high = F.coalesce(low, none), F.coalesce(high, none)
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def incremented(counts: Column, key: Column, by: int = 1) -> Column:
    """A map of counters with one of them raised."""
    now = F.coalesce(F.try_element_at(counts, key), F.lit(0)) + by
    return F.map_concat(F.map_filter(counts, lambda k, _: k != key), F.create_map(key, now.cast("int")))


def json_map(c: Column) -> Column:
    """A JSON object's entries as texts; what is no object has none."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded half away from zero; what rounds to zero keeps its sign, as SQL's round of
    doubles has it and Spark's, which goes through decimals, has not."""
    return F.signum(c) * (F.round(F.abs(c) * 10.0**digits, 0) / 10.0**digits)


def utc_seconds(at: Column) -> Column:
    """A time as ISO text in UTC, whole seconds."""
    return F.date_format(F.date_trunc("second", F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone())), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_utc(c: Column) -> Column:
    """ISO text, with or without Z, as a time; what cannot be read is null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def job_id(at: Column) -> Column:
    """``emb-`` with the day and six random hexadecimal digits: differs at each call."""
    return F.concat_ws("-", F.lit("emb"), F.date_format(at, "yyyyMMdd"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def normal_path(c: Column) -> Column:
    """A percent-decoded path without ``.``, ``..`` and empty parts; ``..`` stops at the root."""
    parts = F.split(F.replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), F.lit("\\"), F.lit("/")), "/")
    start = F.array().cast("array<string>")
    step = lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(p.isin("", "."), s).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(parts, start, step), "/")


def newest_first(c: Column) -> Column:
    """Order of texts of times, the last first; null counts as empty, so last of all."""
    return F.coalesce(c.cast("string"), F.lit("")).desc()
