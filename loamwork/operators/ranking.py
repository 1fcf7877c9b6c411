"""Global ordering without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.operators.cut import cut

_ROWS = (1 << 33) - 1


def global_row_number(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Add the 1-based place in the order, ascending, which must tell all rows apart.

    Rows are dealt out by ranges of the whole order, sorted within their part and written once with their place in it; the
    parts' sizes, a row a part, give each part's offset. Ranges follow the rows, so no group of them falls to one task, however
    many share a score or a folder. A plain row_number over all rows would sort them in one task.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = cut(df.select("*", *(c.alias(k) for k, c in zip(keys, order, strict=True))))
    at = F.monotonically_increasing_id()
    placed = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit(_ROWS)).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")
