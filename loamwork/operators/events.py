"""Ordered events: streaks, progress, observations, summaries, levels, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def streaks(events: DataFrame, keys: list[str], order: str, signature: Column, resets: Column) -> DataFrame:
    """Add streak: how often the row's signature has come since the last row that resets; that row is of the new epoch."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    laid = events.withColumn("epoch", F.sum(F.when(resets, 1).otherwise(0)).over(w)).withColumn("signature", signature)
    n = F.row_number().over(Window.partitionBy(*keys, "epoch", "signature").orderBy(order))
    return laid.withColumn("streak", n.cast("long")).drop("epoch", "signature")


def stagnation(events: DataFrame, keys: list[str], order: str, progressed: Column) -> DataFrame:
    """Add stagnant: rows without progress in a run up to this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    laid = events.withColumn("epoch", F.sum(F.when(progressed, 1).otherwise(0)).over(w))
    n = F.sum(F.when(progressed, 0).otherwise(1)).over(Window.partitionBy(*keys, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("stagnant", n.cast("long")).drop("epoch")


def progress_faults(events: DataFrame, keys: list[str], order: str, percent: Column, terminal: Column) -> DataFrame:
    """Rows whose percentage falls, or that come behind a terminal row: with decreased and late."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.max(F.when(terminal, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    laid = events.withColumn("decreased", F.coalesce(percent < F.lag(percent).over(w), F.lit(False))).withColumn("late", F.coalesce(before == 1, F.lit(False)))
    return laid.filter("decreased or late")


def scaled(percent: Column, start: float, end: float) -> Column:
    """A child's 0 to 100 within the parent's start to end."""
    return F.lit(start) + percent * (end - start) / 100


def last_rows(events: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def summaries(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, event, value, ts) -> a row an operation: events, errors, last error, duration in ms, distinct kinds."""
    error = F.when(F.col("event") == "error", F.col("seq"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event") == "error").alias("n_errors"), F.max(error).alias("last_error"), F.max_by("value", error).alias("last_error_value"),
        F.greatest(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).cast("long"), F.max(F.floor("value")).cast("long")).alias("duration_ms"), F.count_distinct("event").alias("n_kinds"),
    )


def first_wins(events: DataFrame, keys: list[str], value: str, order: str, most: int) -> DataFrame:
    """Each key's distinct values by first appearance, the first `most`."""
    first = events.groupBy(*keys, value).agg(F.min(order).alias("at"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return first.withColumn("place", n.cast("long")).filter(F.col("place") <= most).drop("at")


def threshold(components: DataFrame, levels: DataFrame) -> DataFrame:
    """(component) and (prefix, level): the level of the longest dotted prefix; '' is the root's.

    Prefixes join by equality: each component is laid out by its own ancestors, never by comparing all with all.
    """
    parts = F.split("component", r"\.")
    own = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), ".")))
    laid = components.select("component", F.explode(own).alias("prefix"))
    return laid.join(levels, "prefix").groupBy("component").agg(F.max_by("level", F.length("prefix")).alias("level"))


def precedence(layers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source): the first layer that is set."""
    value = F.coalesce(*(c for _, c in layers))
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in layers))
    return value, source


def duration_ms(start: Column, end: Column) -> Column:
    """Between two ISO-8601 strings; 0 if one is none, or the end comes first."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return F.greatest(F.lit(0), F.coalesce(((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long"), F.lit(0)))
