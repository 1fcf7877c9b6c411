"""Where intermediate tables go, and joins whose broadcast side has a measured size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes that may be broadcast; anything larger is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bounds on the Arrow batches that Python workers get, so that long texts don't pile up.
ARROW_ROWS, ARROW_BYTES = 2_000, 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local one only where it is unset and all tasks
    run in the driver's own process; elsewhere that is an error, since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamwork-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/loamwork-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there, lost executors or not."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Held:
    """Tables kept on the executors' disks for several readers, with their lineage, until the `with` block ends.

    For tables that are a step or two behind a written one: what a lost executor held is computed anew from there. They
    spare the shared folder their files, and the executors a process for each file's permissions. Nothing that is read
    after the block may depend on them but through a written table, and held tables don't stand on held ones for many
    steps: every plan over them repeats theirs on the driver.
    """

    def __enter__(self) -> Held:
        self.tables: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def __exit__(self, *_) -> None:
        for df in self.tables:
            df.unpersist()


def prepare(spark: SparkSession) -> None:
    """Ready the session for Python stages: batch bounds, unless it has its own, and a worker path to this package."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))
    home = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment
    if home not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(x for x in (held.get("PYTHONPATH", ""), home) if x)


def _bytes(x: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about: lengths of strings and of what arrays hold, eight for anything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            held = F.aggregate(x, F.lit(0).cast("long"), lambda total, y: total + _bytes(y, kind.elementType))
        else:
            held = F.size(x).cast("long") * 8
        return F.greatest(F.coalesce(held, F.lit(0).cast("long")), F.lit(0).cast("long")) + 16
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(x), T.ArrayType(kind.keyType)) + _bytes(F.map_values(x), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_bytes(x[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a broadcast holds for a row, about."""
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24).cast("long"))


def measured(df: DataFrame) -> int:
    """Bytes of all rows of a materialised table as a broadcast holds them, summed where the rows lie."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def bounded(df: DataFrame) -> DataFrame:
    """df marked for a broadcast if its measured bytes fit BROADCAST_BYTES, else for a sort-merge join."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df.hint("merge")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join, with `right` (a materialised table) broadcast only if it is measured to fit BROADCAST_BYTES."""
    return left.join(bounded(right), on, how)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
