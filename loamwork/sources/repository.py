"""A source tree as relations: files, ignored and skipped, and their verified texts."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import fixed, paths, text
from loamwork.operators.select import ignore_rules, ignored

ENTRY = "path string, is_symlink boolean, size_bytes long"


def validate_root(root: str) -> Path:
    path = Path(root)
    if not path.exists():
        raise FileNotFoundError(root)
    if not path.is_dir():
        raise NotADirectoryError(root)
    return path.resolve(strict=True)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root: what lstat tells, which file readers don't. Symbolic links are rows, never followed."""
    base = validate_root(root)
    rows = []
    for folder, dirs, names in os.walk(base, followlinks=False):
        for name in [*names, *(d for d in dirs if os.path.islink(os.path.join(folder, d)))]:
            full = os.path.join(folder, name)
            rows.append((os.path.relpath(full, base).replace(os.sep, "/"), os.path.islink(full), os.lstat(full).st_size))
    return spark.createDataFrame(rows, ENTRY)


def contents(listed: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """(path) -> path, content: each file's bytes by one read that follows no link; null if it cannot be read, is no
    regular file or is larger than max_bytes. Spark's own binary reader leaves out hidden and empty files. The tree must
    be at the same place on every executor."""
    base = str(validate_root(root))

    def read(path: str) -> bytes | None:
        try:
            handle = os.open(os.path.join(base, path), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
            with os.fdopen(handle, "rb") as f:
                if not stat.S_ISREG(os.fstat(handle).st_mode):
                    return None
                data = f.read() if max_bytes is None else f.read(max_bytes + 1)
                return None if max_bytes is not None and len(data) > max_bytes else data
        except OSError:
            return None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # a file a batch: their sizes add up
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([read(path)], pa.binary())], names=["path", "content"])

    return listed.select("path").mapInArrow(emit, "path string, content binary")


def tree_rules(root: str, tool_file: str | None = None) -> list[tuple[str, str, str, bool, bool]]:
    """Default patterns, each directory's .gitignore (outer before inner), then the tool's own ignore file."""
    base = validate_root(root)
    scopes: list[tuple[str, str, list[str]]] = [("", "default", list(fixed.DEFAULT_PATTERNS))]
    for folder, dirs, names in os.walk(base, followlinks=False):
        dirs.sort()
        if ".gitignore" in names:
            at = os.path.relpath(folder, base).replace(os.sep, "/")
            scopes.append(("" if at == "." else at, "gitignore", Path(folder, ".gitignore").read_text("utf-8").splitlines()))
    if tool_file and (base / tool_file).is_file():
        scopes.append(("", "tool", (base / tool_file).read_text("utf-8").splitlines()))
    return ignore_rules(scopes)


def scan(spark: SparkSession, root: str, max_bytes: int = 1_000_000, tool_file: str | None = None) -> dict[str, DataFrame]:
    """files (path, size_bytes, language, sha256), ignored (path, source, pattern) and skipped (path, reason).

    A protected or ignored path comes before a link, a link before a size, a size before a sniff.
    """
    found = entries(spark, root)
    rules = ignored(found.select("path"), tree_rules(root, tool_file), fixed.PROTECTED_PATTERNS)
    out = rules.filter("source is not null").select("path", "source", "pattern")
    live = found.join(rules.filter("source is null").select("path"), "path", "left_semi")
    content = contents(live.filter(~F.col("is_symlink") & (F.col("size_bytes") <= max_bytes)), root, max_bytes)
    reason = F.when(F.col("is_symlink"), "symlink").when(F.col("size_bytes") > max_bytes, "too_large").when(F.col("content").isNull(), "unreadable").otherwise(text.binary_reason(F.col("content")))
    told = live.join(content, "path", "left").withColumn("reason", reason)
    files = told.filter("reason is null").select("path", "size_bytes", paths.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"))
    return {"files": files, "ignored": out, "skipped": told.filter("reason is not null").select("path", "reason")}


def verified_texts(root: str, files: DataFrame) -> DataFrame:
    """(path, sha256) -> path, text in canonical newlines; a file that changed since its hash raises."""
    content = contents(files, root)
    same = F.sha2("content", 256) == F.col("sha256")
    decoded = F.decode("content", "UTF-8")
    return files.join(content, "path", "left").select("path", F.when(F.coalesce(same, F.lit(False)), text.canonical_newlines(decoded)).otherwise(F.raise_error(F.concat(F.lit("changed since it was scanned: "), "path"))).alias("text"))


def git_changes(spark: SparkSession, root: str, base: str | None = None, staged: bool = False, timeout: float = 30.0) -> DataFrame:
    """(path, status, available) of a read-only git diff; a failure is one row that is not available.

    A path has one status: untracked before deleted before added before modified.
    """
    priority = {"untracked": 0, "deleted": 1, "added": 2, "modified": 3}

    def run(*args: str) -> list[str]:
        done = subprocess.run(["git", "-C", str(validate_root(root)), "-c", "core.fsmonitor=false", *args], capture_output=True, timeout=timeout, check=True)
        return [x for x in done.stdout.decode("utf-8").split("\0") if x]

    try:
        against = ["--cached"] if staged else [base] if base else []
        rows = {}
        for name, code in (("modified", "M"), ("added", "A"), ("deleted", "D")):
            rows |= dict.fromkeys(run("diff", "--no-ext-diff", "--no-renames", "--name-only", "-z", f"--diff-filter={code}", *against, "--"), name)
        if not staged and not base:
            rows |= dict.fromkeys(run("ls-files", "--others", "--exclude-standard", "-z"), "untracked")
        found = [(p, s, True) for p, s in sorted(rows.items(), key=lambda x: (priority[x[1]], x[0]))]
    except (subprocess.SubprocessError, OSError, UnicodeDecodeError):
        found = [(None, None, False)]
    return spark.createDataFrame(found, "path string, status string, available boolean")
