"""Log records and errors that may be shown."""

from __future__ import annotations

import json
import re
import traceback

# Names whose values are never logged.
SENSITIVE = ("api_key", "authorization", "cookie", "key", "password", "secret", "token")
DEPTH, TEXT = 5, 1000


def safe_text(text: str) -> str:
    """One line of bounded length without credentials."""
    out = re.sub(r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", r"\1 [REDACTED]", text)
    out = re.sub(r"([a-z][a-z0-9+.-]*://)[^/@\s]+@", r"\1[REDACTED]@", out)
    out = re.sub(rf"(?i)([?&](?:{'|'.join(SENSITIVE)})=)[^&\s#]*", r"\1[REDACTED]", out)
    return re.sub(r"[\r\n\x00]+", " ", out)[:TEXT]


def safe_value(value, depth: int = DEPTH):
    """Mappings and lists to a bounded depth, sensitive keys redacted."""
    if isinstance(value, dict):
        return {str(k): "[REDACTED]" if str(k).lower() in SENSITIVE else safe_value(v, depth - 1) for k, v in value.items()} if depth else "[...]"
    if isinstance(value, (list, tuple)):
        return [safe_value(v, depth - 1) for v in value] if depth else "[...]"
    return safe_text(value) if isinstance(value, str) else value


def safe_error(error: BaseException, code: str, retryable: bool = False, stack: bool = False) -> dict:
    """type, code and message of an error and of its causes, DEPTH of them at most; the stack only if asked for."""
    causes, cause = [], error.__cause__ or error.__context__
    while cause is not None and len(causes) < DEPTH:
        causes.append({"type": type(cause).__name__, "message": safe_text(str(cause))})
        cause = cause.__cause__ or cause.__context__
    out = {"type": type(error).__name__, "code": code, "message": safe_text(str(error)), "retryable": retryable, "causes": causes}
    return out | ({"stack": [safe_text(x) for x in traceback.format_tb(error.__traceback__)]} if stack else {})


def record(component: str, event: str, message: str, data: dict | None = None, level: str = "info", form: str = "json") -> str:
    """A log line as canonical JSON or as plain text."""
    row = {"component": component, "event": event, "level": level, "message": safe_text(message), "data": safe_value(data or {})}
    if form == "json":
        return json.dumps(row, sort_keys=True, ensure_ascii=False)
    return f"{level.upper()} {component} {event}: {row['message']}" + "".join(f" {k}={v}" for k, v in sorted(row["data"].items()))
