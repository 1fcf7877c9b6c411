"""Publication of an index: staged tables become an immutable generation, then a pointer names it."""

from __future__ import annotations

import json
import os
import secrets
import shutil
import socket
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_atomic(path: str, data: bytes, force: bool = False) -> None:
    """A temporary sibling, flushed, then linked (an existing file stays) or, with force, put in its place."""
    target = Path(path)
    held = target.with_name(f".{target.name}.{secrets.token_hex(6)}")
    try:
        with open(held, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if force:
            os.replace(held, target)
        else:
            os.link(held, target)
    finally:
        held.unlink(missing_ok=True)


class Locked(RuntimeError):
    pass


@contextmanager
def writer_lock(root: str, recover: bool = False) -> Iterator[None]:
    """One writer at a time. A lock whose process on this host is gone is taken over only if asked to."""
    path = Path(root, "lock")
    path.parent.mkdir(parents=True, exist_ok=True)
    mine = json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "nonce": secrets.token_hex(8)}).encode()
    try:
        write_atomic(str(path), mine)
    except FileExistsError:
        owner = json.loads(path.read_bytes())
        gone = owner["host"] == socket.gethostname() and not os.path.exists(f"/proc/{owner['pid']}")
        if not (recover and gone):
            raise Locked(f"held by process {owner['pid']} on {owner['host']}") from None
        write_atomic(str(path), mine, force=True)
    try:
        yield
    finally:
        if path.exists() and path.read_bytes() == mine:
            path.unlink()


def _rows_digest(df: DataFrame) -> str:
    """Of a table whatever the order of its rows: the number of rows and sums of halves of their hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(20,0)"))
    got = df.select(part(1).alias("a"), part(13).alias("b"), F.count("*").alias("n")).first()
    return f"{got['n']}:{got['a'] or 0}:{got['b'] or 0}"


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write the tables into a stage, read them back and compare digests, move the stage to generations/<id>, and only
    then swap the pointer; whatever fails before leaves the old generation in place. The id is a hash of the content."""
    import hashlib

    with writer_lock(root):
        stage = Path(root, "staging", secrets.token_hex(8))
        digests = {}
        for name, df in sorted(tables.items()):
            df.write.parquet(f"file://{stage}/{name}" if stage.is_absolute() else f"{stage}/{name}")
            digests[name] = _rows_digest(df.sparkSession.read.parquet(f"{stage}/{name}"))
        identity = hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()[:32]
        final = Path(root, "generations", identity)
        if final.exists():
            shutil.rmtree(stage)
        else:
            write_atomic(f"{stage}/manifest.json", json.dumps({"schema_version": 1, "generation_id": identity, "tables": digests}, sort_keys=True).encode())
            final.parent.mkdir(parents=True, exist_ok=True)
            os.rename(stage, final)
        write_atomic(str(Path(root, "current")), identity.encode(), force=True)
        return identity


def load(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    """A table of the current, or a named, generation; its digest is checked against the manifest."""
    identity = generation or Path(root, "current").read_text()
    manifest = json.loads(Path(root, "generations", identity, "manifest.json").read_bytes())
    df = spark.read.parquet(f"{root}/generations/{identity}/{name}")
    if manifest["generation_id"] != identity or manifest["tables"][name] != _rows_digest(df):
        raise ValueError(f"generation {identity} is not what its manifest says")
    return df


def clean(root: str, keep_current: bool = True) -> list[str]:
    """Remove stages and generations, but the current one."""
    current = Path(root, "current").read_text() if keep_current and Path(root, "current").exists() else None
    shutil.rmtree(Path(root, "staging"), ignore_errors=True)
    gone = [p.name for p in Path(root, "generations").glob("*") if p.name != current]
    for name in gone:
        shutil.rmtree(Path(root, "generations", name))
    if not keep_current:
        Path(root, "current").unlink(missing_ok=True)
    return sorted(gone)


def append_summary(root: str, summary: dict) -> bool:
    """One canonical JSON file an operation; a failure to write is told, not raised."""
    try:
        Path(root, "runs").mkdir(parents=True, exist_ok=True)
        write_atomic(str(Path(root, "runs", f"{summary['operation_id']}.json")), json.dumps(summary, sort_keys=True).encode(), force=True)
    except (OSError, KeyError, TypeError):
        return False
    return True
