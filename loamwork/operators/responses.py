"""Structured responses of a scripted provider: validation, repair plans, retries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.sources.documents import DocumentError, canonical_json, strict_json

# Repair strategies by attempt; later attempts use the last.
REPAIRS = {1: "exact_paths_and_schema", 2: "correct_previous_full_object", 3: "allowed_ids_required_template", 4: "plain_json_local_validation", 5: "smallest_task_valid_object"}
# Seconds before a retry, and which failures may have one.
DELAYS = (0.25, 1.0)
RETRYABLE = ("provider_timeout", "provider_unavailable", "rate_limited")


@dataclass(frozen=True)
class Contract:
    """fields: name -> types. optional: those that may lack. version: put in where the field is missing. check: raises
    DocumentError on a value that the types allow and the task does not."""

    fields: dict[str, type | tuple[type, ...]]
    optional: frozenset[str] = frozenset()
    version: int = 1
    max_bytes: int = 1 << 20
    check: Callable[[dict], None] | None = None


def validate(data: str | None, contract: Contract) -> tuple[bool, str | None, str | None]:
    """(ok, issue code, canonical JSON). Surrounding white space and one fence are removed first."""
    body = (data or "").strip()
    if body.startswith("```") and body.endswith("```") and len(body) >= 6:
        body = body[3:-3].removeprefix("json").strip()
    raw = body.encode()
    try:
        try:
            bare = json.loads(body)
            if isinstance(bare, dict) and "schema_version" not in bare and body.startswith("{"):
                raw = (f'{{"schema_version":{contract.version}' + ("," if bare else "") + body[1:].lstrip()).encode()
        except ValueError:
            pass  # strict_json says what is wrong
        value = strict_json(raw, contract.max_bytes, {**contract.fields, "schema_version": int}, contract.version, contract.optional)
        if contract.check:
            contract.check(value)
    except DocumentError as e:
        return False, e.code, None
    return True, None, canonical_json(value).decode()


def validate_all(responses: DataFrame, contract: Contract) -> DataFrame:
    """(id, response) -> id, ok, code, json."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [validate(x, contract) for x in batch.column("response").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t[0] for t in told], pa.bool_()), pa.array([t[1] for t in told], pa.string()), pa.array([t[2] for t in told], pa.string())], names=["id", "ok", "code", "json"])

    kind = responses.schema["id"].dataType.simpleString()
    return responses.select("id", "response").mapInArrow(emit, f"id {kind}, ok boolean, code string, json string")


def repair_strategy(attempt: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in REPAIRS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, attempt.cast("int")), F.lit(REPAIRS[5]))


def shows_previous(attempt: Column) -> Column:
    return attempt == 2


def is_plain_json(attempt: Column) -> Column:
    return attempt >= 4


def retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def retry_delay(attempt: Column) -> Column:
    """Seconds before the attempt-th retry; null when there is none left."""
    return F.try_element_at(F.array(*map(F.lit, DELAYS)), attempt.cast("int"))


def ask(requests: DataFrame, answer: Callable[[str, int], str | None], contract: Contract, attempts: int = 5) -> DataFrame:
    """(id, prompt) -> id, ok, code, json, used: a provider's answers, asked again with the attempt's number until one is
    valid. answer(prompt, attempt) is the provider, a script here: it runs on the executors and must be picklable."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prompt in batch.column("prompt").to_pylist():
                for attempt in range(1, attempts + 1):
                    told = validate(answer(prompt, attempt), contract)
                    if told[0]:
                        break
                rows.append((*told, attempt))
            kinds = [pa.bool_(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[j] for r in rows], kinds[j]) for j in range(4))], names=["id", "ok", "code", "json", "used"])

    kind = requests.schema["id"].dataType.simpleString()
    return requests.select("id", "prompt").mapInArrow(emit, f"id {kind}, ok boolean, code string, json string, used long")
