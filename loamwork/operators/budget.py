"""Four ways to keep to a budget in order, and how they differ once something does not fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, keys: list[str], order: list[str], size: str, name: str = "running") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(size).over(w))


def fail_point(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Groups whose total exceeds the limit, with the first row that does: the whole group fails there."""
    over = running(df, keys, order, size).filter(F.col("running") > limit)
    return over.groupBy(*keys).agg(F.min_by(order[-1], F.struct(*order)).alias("fails_at"), F.min_by("running", F.struct(*order)).alias("total"))


def prefix(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Rows before the first that overflows; sizes must not be negative."""
    return running(df, keys, order, size).filter(F.col("running") <= limit).drop("running")


def page(df: DataFrame, keys: list[str], order: list[str], size: str, offset: int, rows: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+rows in order, less those at the end that would overflow the limit."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = df.withColumn("_n", n).filter(F.col("_n").between(offset + 1, offset + rows))
    return prefix(cut, keys, ["_n"], size, limit).drop("_n")


def greedy(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int, pinned: str | None = None) -> DataFrame:
    """df with taken: each row is taken if it still fits, and skipped if not, so that later smaller rows may fit.

    Pinned rows are always taken and count. What is left after a row depends on all before it in its group, so each
    task streams its sorted groups and holds one number; a group of any size takes no more memory.
    """
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, 0
        for batch in batches:
            cols = [batch.column(names.index(k)).to_pylist() for k in keys]
            sizes = batch.column(names.index(size)).to_pylist()
            pins = batch.column(names.index(pinned)).to_pylist() if pinned else [False] * batch.num_rows
            taken = []
            for key, n, pin in zip(zip(*cols, strict=True), sizes, pins, strict=True):
                if key != group:
                    group, used = key, 0
                fits = bool(pin) or used + n <= limit
                used += n if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[*names, "taken"])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{fields}, taken boolean")


def halvings(need: Column, limit: int) -> Column:
    """How often a size must be halved, rounding down, to fit."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(need.alias("n"), F.lit(0).alias("k")), lambda a, _: F.when(a["n"] > limit, F.struct(F.floor(a["n"] / 2).alias("n"), (a["k"] + 1).alias("k"))).otherwise(a))["k"].cast("long")


def greedy_all(df: DataFrame, order: list[Column], size: str, limit: int, at_once: int = 10_000) -> DataFrame:
    """The rows of a whole table that greedy() would take in this order, which must tell all rows apart; no row is pinned.

    What is left only shrinks, so a row that doesn't fit now never will: each round asks for the first `at_once` rows behind
    the last one seen that still fit, which every task cuts to as many, and folds those. Empty rows always fit and need no
    fold. What comes to the driver is `at_once` rows a round; taken rows are `limit` at most.
    """
    spark = df.sparkSession
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    waiting = df.filter(F.col(size) > 0).select("*", place.alias("_place"))
    left, seen, taken = limit, None, []
    while left > 0:
        fits = waiting.filter(F.col(size) <= left)
        if seen is not None:
            fits = fits.filter(F.col("_place") > F.struct(*(F.lit(v).alias(f"o{k}") for k, v in enumerate(seen))))
        rows = fits.orderBy("_place").limit(at_once).collect()
        for r in rows:
            if r[size] <= left:
                left -= r[size]
                taken.append(tuple(r)[:-1])
        if len(rows) < at_once:
            break
        seen = tuple(rows[-1]["_place"])
    return df.filter(F.col(size) == 0).union(spark.createDataFrame(taken, df.schema))
