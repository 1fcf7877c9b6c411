"""A bounded excerpt of a text: its beginning, the lines around declarations, and its end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def excerpt(text: str, declared: list[int], limit: int) -> tuple[str, list[tuple[int, int]], bool]:
    """(excerpt, line ranges, truncated) within `limit` bytes.

    Half the budget is for lines from the start, a quarter for those around the declarations (1-based lines), the rest
    for lines from the end; a line that does not fit is passed over. If no line fits, the first bytes are given, whole
    characters only.
    """
    lines = text.splitlines(keepends=True)
    sizes = np.array([len(x.encode()) for x in lines], np.int64)
    n = len(lines)
    if sizes.sum() <= limit:
        return text, [(1, max(1, n))], False
    wishes = (
        (range(n), limit // 2),
        ([k for d in declared for k in range(max(0, d - 2), min(n, d + 1))], limit // 4),
        (range(n - 1, -1, -1), limit - limit // 2 - limit // 4),
    )
    taken = np.zeros(n, bool)
    for order, budget in wishes:
        left = budget
        for k in order:
            if not taken[k] and sizes[k] <= left:
                taken[k], left = True, left - sizes[k]
    if not taken.any():
        return text.encode()[:limit].decode(errors="ignore"), [(1, 1)], True
    at = np.flatnonzero(taken)
    islands = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return "".join(lines[k] for k in at), [(int(i[0]) + 1, int(i[-1]) + 1) for i in islands], True


def excerpts(files: DataFrame, limit: int) -> DataFrame:
    """(path, text, declared array<long>) -> path, excerpt, ranges 'a-b,c-d', truncated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, text, declared = (batch.column(c).to_pylist() for c in ("path", "text", "declared"))
            made = [excerpt(t or "", d or [], limit) for t, d in zip(text, declared, strict=True)]
            cols = [pa.array(path, pa.string()), pa.array([m[0] for m in made], pa.string()), pa.array([",".join(f"{a}-{b}" for a, b in m[1]) for m in made], pa.string()), pa.array([m[2] for m in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "excerpt", "ranges", "truncated"])

    return files.select("path", "text", "declared").mapInArrow(emit, "path string, excerpt string, ranges string, truncated boolean")
