"""Change logs of managed collections: batch and streaming reads, subscriptions by pattern, replay, stream joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, type string, collection string, at long, count long, document string, data string, commit long"


def pattern(column: Column, subscription: str) -> Column:
    """Whether an event's type matches: exactly, by a * at either end or inside, or by a regular expression in slashes."""
    if len(subscription) > 1 and subscription[0] == subscription[-1] == "/":
        return column.rlike(subscription[1:-1])
    if "*" not in subscription:
        return column == subscription
    return column.rlike("^" + ".*".join(re.escape(p) for p in subscription.split("*")) + "$")


def changes(spark: SparkSession, path: str, subscription: str = "*", after: int | str | None = None) -> DataFrame:
    """All changes of a collection, from a cursor on: a time in nanoseconds or the id of the last event seen."""
    df = spark.read.schema(SCHEMA).json(f"{path}/commits")
    return _chosen(df, subscription, after)


def change_stream(spark: SparkSession, path: str, subscription: str = "*", after: int | str | None = None) -> DataFrame:
    """The same as a stream; each commit's changes come in one file, so in one batch."""
    return _chosen(spark.readStream.schema(SCHEMA).json(f"{path}/commits"), subscription, after)


def _chosen(df: DataFrame, subscription: str, after: int | str | None) -> DataFrame:
    df = df.where(F.col("id").isNotNull())  # a commit's first line is its state
    df = df.where(pattern(F.col("type"), subscription))
    if after is not None:  # ids are ordered by time
        df = df.where(F.col("at") > after if isinstance(after, int) else F.col("id") > after)
    return df


def join_stream(stream: DataFrame, static: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """A stream joined to a table, row by row as it comes; inner and left need no state."""
    if stream.isStreaming and how not in ("inner", "left"):
        raise ValueError("a stream joins a table by inner or left join")
    return stream.join(static, on, how)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows by event-time window and keys, with a bound for late rows. Beyond the reference's operators."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
