"""Comparison of a recorded index with the current files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME = ("sha256", "size_bytes", "language")


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in SAME:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def added(manifest: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(manifest.select("path"), "path", "left_anti")


def deleted(manifest: DataFrame, current: DataFrame) -> DataFrame:
    return manifest.join(current.select("path"), "path", "left_anti")


def compared(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of both with changed: null-safe difference of hash, size or language."""
    return manifest.alias("m").join(current.alias("c"), F.col("m.path") == F.col("c.path")).select("c.*", (~_same("m", "c")).alias("changed"))


def status(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """path and added, deleted, changed or unchanged, by one full outer join."""
    both = manifest.alias("m").join(current.alias("c"), F.col("m.path") == F.col("c.path"), "full_outer")
    label = F.when(F.col("m.path").isNull(), "added").when(F.col("c.path").isNull(), "deleted").when(_same("m", "c"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("m.path", "c.path").alias("path"), label.alias("status"))


def stale(manifest: DataFrame, current: DataFrame, analyzer: str, same_build: bool = True) -> DataFrame:
    """Manifest states of files still there whose build, source or analyzer is not the expected one."""
    both = manifest.alias("m").join(current.alias("c"), F.col("m.path") == F.col("c.path"))
    why = F.when(F.lit(not same_build), "build").when(~_same("m", "c"), "source").when(F.col("m.analyzer") != analyzer, "analyzer")
    return both.select("m.path", why.alias("reason")).filter("reason is not null")


def reuse(manifest: DataFrame, current: DataFrame, analyzer: str) -> DataFrame:
    """Each current file: reused if source and analyzer agree and its record is whole, else extracted."""
    both = current.alias("c").join(manifest.alias("m"), F.col("m.path") == F.col("c.path"), "left")
    keep = F.col("m.path").isNotNull() & _same("m", "c") & (F.col("m.analyzer") == analyzer) & (F.col("m.status") == "complete")
    return both.select("c.path", F.when(keep, "reused").otherwise("extracted").alias("action"))


def first_reusable(current: DataFrame, manifests: list[DataFrame]) -> DataFrame:
    """Each current file with the place (from 0) of the first manifest that has its very state; null if none has."""
    from functools import reduce

    ranked = reduce(DataFrame.unionByName, (m.select("path", *SAME, F.lit(i).cast("long").alias("place")) for i, m in enumerate(manifests)))
    both = current.alias("c").join(ranked.alias("m"), (F.col("m.path") == F.col("c.path")) & _same("m", "c"), "left")
    return both.groupBy(F.col("c.path").alias("path")).agg(F.min("m.place").alias("place"))


def ordered_digest(rows: DataFrame, path: str, record: Column) -> DataFrame:
    """One row: SHA-256 of the JSON list of all records in path order.

    The digest runs over the whole list, which no split can shorten: executors sort ranges of paths, and the driver streams
    their records through one running hash, a part at a time. No rows: the digest of an empty list.
    """
    digest, first = hashlib.sha256(b"["), True
    for r in rows.select(record.alias("record"), F.col(path).alias("o")).orderBy("o").select("record").toLocalIterator(prefetchPartitions=True):
        digest.update(("" if first else ",").encode() + r["record"].encode())
        first = False
    digest.update(b"]")
    return rows.sparkSession.createDataFrame([(digest.hexdigest(),)], "digest string")


def statistics(states: DataFrame) -> DataFrame:
    """One row: files, bytes, and counts by record status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return states.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("n_bytes"), count("complete"), count("partial"), count("failed"))
