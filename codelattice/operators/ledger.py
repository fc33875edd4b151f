"""Ledgers of metrics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(events: DataFrame) -> DataFrame:
    """Events per day and type."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def deltas(ledger: DataFrame) -> DataFrame:
    """The change of each type against the day before it in the ledger; null on its first day."""
    order = Window.partitionBy("event_type").orderBy("day")
    return ledger.select("day", "event_type", "n", (F.col("n") - F.lag("n").over(order)).alias("delta"))


def spend(events: DataFrame) -> DataFrame:
    """Tokens and cost per event type."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    return events.groupBy(F.col("event_type").alias("model")).agg(F.sum(tokens).alias("tokens"), F.round(F.sum(F.col("value").cast("decimal(38,6)")), 2).cast("double").alias("usd"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width)["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def latest(events: DataFrame) -> DataFrame:
    """Last write wins: the newest event of each user, ties to the larger id."""
    newest = F.max(F.struct("ts", "event_id", "event_type")).alias("__last")
    return events.groupBy("user_id").agg(newest).select("user_id", "__last.ts", "__last.event_id", "__last.event_type")


def sliding(events: DataFrame, width: str = "1 hour", every: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, every)["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of one user's events without a pause of `gap`."""
    found = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last_ts"))
    return found.select("user_id", "start", "last_ts", "n")


def first_of_hour(events: DataFrame) -> DataFrame:
    """One event, of the smallest id, per user, type and hour."""
    return events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.min("event_id").alias("event_id"))
