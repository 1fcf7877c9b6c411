"""Strict documents: JSON packages, manifests, layered settings."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any


class DocumentError(ValueError):
    """A document that does not meet its rules; code names which."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise DocumentError("duplicate_key", ", ".join(sorted({k for k, _ in pairs if sum(k == x for x, _ in pairs) > 1})))
    return out


def _constant(name: str) -> Any:
    raise DocumentError("non_finite_number", name)


def strict_json(data: bytes, max_bytes: int, fields: Mapping[str, type | tuple[type, ...]], version: int | None = 1, optional: frozenset[str] = frozenset()) -> dict[str, Any]:
    """One closed JSON object: size, UTF-8, unique keys, finite numbers, exactly the fields, their types, the version."""
    if len(data) > max_bytes:
        raise DocumentError("too_large", f"{len(data)} bytes")
    try:
        value = json.loads(data.decode("utf-8"), object_pairs_hook=_object, parse_constant=_constant)
    except UnicodeDecodeError as e:
        raise DocumentError("invalid_encoding", str(e)) from e
    except json.JSONDecodeError as e:
        raise DocumentError("invalid_json", str(e)) from e
    if not isinstance(value, dict):
        raise DocumentError("not_an_object", type(value).__name__)
    if extra := set(value) - set(fields):
        raise DocumentError("unknown_field", ", ".join(sorted(extra)))
    if missing := set(fields) - set(value) - optional:
        raise DocumentError("missing_field", ", ".join(sorted(missing)))
    for k, v in value.items():
        if not isinstance(v, fields[k]) or isinstance(v, bool) and fields[k] in (int, float):
            raise DocumentError("wrong_type", k)
    if version is not None and value.get("schema_version") != version:
        raise DocumentError("unsupported_version", str(value.get("schema_version")))
    return value


def canonical_json(value: Any) -> bytes:
    """Sorted keys, compact, finite, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def pointer_values(value: Any, pointer: str) -> list[Any]:
    """The values at a JSON pointer whose * stands for every element or field."""
    found = [value]
    for part in [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]:
        step = []
        for v in found:
            if isinstance(v, dict):
                step += list(v.values()) if part == "*" else [v[part]] if part in v else []
            elif isinstance(v, list):
                step += v if part == "*" else [v[int(part)]] if part.isdigit() and int(part) < len(v) else []
        found = step
    return found


def json_shape(value: Any) -> Any:
    """Types in the place of values; an array has the distinct shapes of its elements."""
    if isinstance(value, dict):
        return {k: json_shape(v) for k, v in value.items()}
    if isinstance(value, list):
        seen: list[Any] = []
        for v in map(json_shape, value):
            if v not in seen:
                seen.append(v)
        return seen
    return {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}[type(value)]


def settings(root: str, defaults: Mapping[str, Any], environment: Mapping[str, str] | None = None, prefix: str = "LOAMWORK_", command_line: Mapping[str, Any] | None = None) -> dict[str, tuple[Any, str]]:
    """name -> (value, source): command line over environment over config.local.toml over config.toml over defaults."""
    layers: list[tuple[str, Mapping[str, Any]]] = [("command line", command_line or {})]
    env = os.environ if environment is None else environment
    layers.append(("environment", {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}))
    for source, name in (("local", "config.local.toml"), ("shared", "config.toml")):
        path = Path(root, name)
        layers.append((source, tomllib.loads(path.read_text("utf-8")) if path.is_file() else {}))
    layers.append(("default", defaults))
    out = {}
    for name in defaults:
        source, layer = next((s, x) for s, x in layers if x.get(name) is not None or s == "default")
        value = layer[name]
        kind = type(defaults[name])
        out[name] = (kind(value) if isinstance(value, str) and kind in (int, float) else value, source)
    return out
