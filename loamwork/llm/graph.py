"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.store import Held, materialise


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its component, with path halving."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, reduced to a star for each of its local components."""
    found = union_find((a, b) for batch in batches for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True))
    rows = [(x, r) for x, r in found.items() if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    several = edges.groupBy("a").count().filter("count > 1").select("a")
    onward = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
    return several.union(onward).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, component long), component the smallest node reachable.

    Partitions first shrink to star forests by union-find (memory bounded by the partition), then large-star and
    small-star steps alternate (Kiveris et al. 2014) until nothing changes; every step is a group-by minimum and a
    join, so a hub is spread by AQE. Nulls and self loops are ignored; no edges give no rows. Each round's edges are
    a table in the shared folder, so a lost executor costs one round at most. Rounds are about the logarithm of the
    longest path between forests; every one that changes an edge brings it nearer its root, so they come to an end.
    """
    edges = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).filter("a <> b")
    edges = materialise(edges.mapInArrow(_forest, "a long, b long"), "forest")
    while not _settled(edges):
        with Held() as hold:
            both = edges.union(edges.select("b", "a"))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = hold(large.filter("a <> b").distinct())
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            edges = materialise(small.filter("a <> b").distinct(), "round")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
