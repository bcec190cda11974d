"""Windows and sessions over the events table (the same functions serve streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.queries import query
from loam.session import read
from loam.sources import files
from loam.streaming import ingest


@query("""select event_type, time_bucket(interval 1 hour, ts) as start, count(*)::bigint as n, round(avg(value), 6) as mean from events group by all""")
def hourly_windows(spark, d):
    """Tumbling windows of an hour."""
    x = ingest.windowed(read(spark, d, "events"), "ts", "value", "event_type")
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*)::bigint as n from s group by user_id, s"""
)
def user_sessions(spark, d):
    """Sessions of users, closed by half an hour without an event."""
    x = ingest.sessions(read(spark, d, "events"), "ts", "user_id")
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_id, list_filter(list_transform(string_split(event_type || ', b c ,,' || user_id, ','), lambda x: trim(x)), lambda x: x <> '') as prompts from events")
def inline_prompts(spark, d):
    """Prompts given as one line of comma-separated values."""
    return read(spark, d, "events").select("event_id", files.parse_prompts(F.concat("event_type", F.lit(", b c ,,"), F.col("user_id").cast("string"))).alias("prompts"))
