"""Tools of a discovery session, and the state that context actions leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tool:
    """arguments: name -> type; run: arguments -> rows; most: rows that an observation shows."""

    arguments: dict[str, type]
    run: Callable[..., DataFrame]
    most: int = 50


@dataclass(frozen=True)
class Observation:
    tool: str
    ok: bool
    code: str
    n_rows: int
    truncated: bool
    rows: tuple


def execute(tools: dict[str, Tool], requests: list[tuple[str, dict]]) -> list[Observation]:
    """Run requests one by one from a closed table of tools. An unknown tool, an argument too many or too few, or one of
    another type is an observation that is not ok; nothing is run for it. Each observation brings its first rows alone."""
    out = []
    for name, given in requests:
        tool = tools.get(name)
        if tool is None:
            code = "unknown_tool"
        elif set(given) != set(tool.arguments):
            code = "invalid_arguments"
        elif any(type(v) is not tool.arguments[k] for k, v in given.items()):
            code = "wrong_type"
        else:
            rows = tool.run(**given).limit(tool.most + 1).collect()
            out.append(Observation(name, True, "ok", min(len(rows), tool.most), len(rows) > tool.most, tuple(rows[: tool.most])))
            continue
        out.append(Observation(name, False, code, 0, False, ()))
    return out


STATE = "outcome string, used long"


def context_actions(actions: DataFrame, files_limit: int, bytes_limit: int) -> DataFrame:
    """(session, seq, action add or remove, path, size, pinned, excluded) -> with outcome and used, the bytes selected then.

    Excluded paths are never added, pinned ones never removed; an addition over either limit is rolled back, though pins may
    pass the limit of files; what is there already, or is not, is unchanged. A session's actions follow each other, so a task
    streams its sorted sessions and holds the selection of one, which the limits bound.
    """
    names = [*actions.columns, "outcome", "used"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in actions.schema.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, held, used = None, {}, 0
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in ("session", "action", "path", "size", "pinned", "excluded")}
            outcomes, sizes = [], []
            for s, action, path, size, pinned, excluded in zip(*col.values(), strict=True):
                if s != session:
                    session, held, used = s, {}, 0
                if action == "add":
                    if excluded:
                        told = "excluded"
                    elif path in held:
                        told = "unchanged"
                    elif used + size > bytes_limit or (len(held) >= files_limit and not pinned):
                        told = "rolled_back"
                    else:
                        held[path], used, told = size, used + size, "added"
                elif action != "remove":
                    told = "invalid"
                elif path not in held:
                    told = "unchanged"
                elif pinned:
                    told = "pinned"
                else:
                    used, told = used - held.pop(path), "removed"
                outcomes.append(told), sizes.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcomes, pa.string()), pa.array(sizes, pa.int64())], names=names)

    return actions.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(fold, f"{fields}, {STATE}")
