"""Chat records of any layout to one template.

A record is a JSON object. The hash of its nested field paths, its schema fingerprint, selects a declarative mapping
that names where prompt, instruction, answer and message fields lie; the mapping makes canonical turns (role, text).
Turns are rendered one chunk each, so a conversation is never held whole: its rendering is its chunks in turn order.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.store import prepare

START, END = "<|im_start|>", "<|im_end|>"
#: The role of what no layout fits: a whole record, or an element among messages that is no object.
NO_ROLE = "record"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping.

    turns: (role, path of the text) in order, for flat records; or each: (path of an array, role key, text key).
    optional: paths that a record may lack. roles: renames of role values.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.each is None:
            return [p for role, path in self.turns for p in ((path, role[1:]) if role.startswith("$") else (path,))]
        at, role, text = self.each
        return [f"{at}[].{role}", f"{at}[].{text}"]

    def variants(self) -> Iterator[frozenset[str]]:
        own = self.paths()
        loose = [p for p in own if p in self.optional]
        for n in range(len(loose) + 1):
            for out in itertools.combinations(loose, n):
                yield frozenset(own) - set(out)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", each=("messages", "role", "content"), roles=NAMES),
    Layout("message_texts", each=("messages", "role", "text"), roles=NAMES),
    Layout("conversations", each=("conversations", "from", "value"), roles=NAMES),
    Layout("turn_row", turns=(("$role", "text"),)),
    Layout("prompt_completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Layout("question_answer", turns=(("system", "context"), ("user", "question"), ("assistant", "answer")), optional=frozenset({"context"})),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"system", "input"})),
)


def field_paths(value) -> Iterator[str]:
    """Paths of a JSON value's leaves, however deep; an array's elements share one path. An empty object or array is a leaf."""
    waiting = [("", value)]
    while waiting:
        at, value = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            waiting += [(f"{at}[]", v) for v in value]
        else:
            yield at


def fingerprint(paths) -> str:
    """SHA-256 of the sorted distinct paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode(errors="surrogatepass")).hexdigest()


class Registry:
    """Fingerprint -> layout. Paths that no layout names (ids, scores, meta data) are left out of the looked-up hash, and what
    lies in a message's content (a list of parts) counts as the content."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known = {p for x in layouts for p in x.paths()}
        self.nested = {f"{x.each[0]}[].{x.each[2]}" for x in layouts if x.each}
        self.by = {}
        for x in layouts:
            for v in x.variants():
                self.by.setdefault(fingerprint(v), x)
        self.seen: dict[frozenset, tuple[str, Layout | None]] = {}

    def find(self, record) -> tuple[str, Layout | None]:
        paths = frozenset(field_paths(record))
        if paths not in self.seen:
            if len(self.seen) > 10_000:  # records with fields named by data: the memory stays bounded
                self.seen.clear()
            whole = {next((n for n in self.nested if p.startswith((n + "[", n + "."))), p) for p in paths}
            self.seen[paths] = (fingerprint(paths), self.by.get(fingerprint(whole & self.known)))
        return self.seen[paths]


def _text(x) -> str:
    """Null is empty, a list of parts the parts' texts by line, a part of another kind (an image, say) its JSON."""
    if x is None or isinstance(x, str):
        return x or ""
    if isinstance(x, list) and x and all(isinstance(p, str) or isinstance(p, dict) and "type" in p for p in x):
        return "\n".join(p if isinstance(p, str) else p["text"] if isinstance(p.get("text"), str) else json.dumps(p, ensure_ascii=False) for p in x)
    return json.dumps(x, ensure_ascii=False)


def sound(text: str) -> str:
    """The text, with half a surrogate pair, which JSON can spell and UTF-8 can't, as U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """The record's canonical turns. Null texts are empty; consecutive user parts of an instruction join by a blank line.
    An element of a message array that is no object is a turn of role NO_ROLE with the element as its text."""
    if layout.each is not None:
        at, role, text = layout.each
        named = [(_text(x.get(role)), _text(x.get(text))) if isinstance(x, dict) else (NO_ROLE, _text(x)) for x in _at(record, at)]
        return [(layout.roles.get(r, r), t) for r, t in named]
    out: list[tuple[str, str]] = []
    for role, path in layout.turns:
        if path in layout.optional and _at(record, path) is None:
            continue
        given = role.startswith("$")
        name = _text(_at(record, role[1:])) if given else role
        name, text = layout.roles.get(name, name), _text(_at(record, path))
        if out and not given and out[-1][0] == name:
            out[-1] = (name, "\n\n".join(x for x in (out[-1][1], text) if x))
        else:
            out.append((name, text))
    return out


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, at long, record JSON string) -> (conv_id, at, part, fingerprint, layout, role, text), a row a turn.

    at orders the records of a conversation, part the turns of a record. A record that is no JSON object, is nested too
    deeply to be read, or whose fingerprint no layout has, gives one turn of role NO_ROLE with the record itself as its text
    (null: empty) and a null layout: it can be counted or mended, and is never lost.
    """
    prepare(records.sparkSession)
    columns = ["conv_id", "at", "part", "fingerprint", "layout", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(layouts)
        for batch in batches:
            out = []
            for conv, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                print_, layout, turns = None, None, []
                try:
                    record = json.loads(raw) if raw is not None else None
                    if isinstance(record, dict):
                        print_, layout = registry.find(record)
                        turns = turns_of(record, layout) if layout else []
                except (ValueError, RecursionError):
                    layout = None
                if layout is None:
                    out.append((conv, at, 0, print_, None, NO_ROLE, raw or ""))
                else:
                    out += [(conv, at, i, print_, layout.name, sound(r), sound(t)) for i, (r, t) in enumerate(turns)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(7)], names=columns)

    return records.select("conv_id", "at", "record").mapInArrow(convert, "conv_id long, at long, part long, fingerprint string, layout string, role string, text string")


def escape(text: Column) -> Column:
    """No control string is left: every <|, <\\|, <\\\\| ... gains one backslash, which unescape takes away again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(turns: DataFrame) -> DataFrame:
    """Add chunk (the turn under the template) and the loss mask: loss_at and loss_len, code points within the chunk.

    The mask covers an assistant's escaped text, no marker. A role's backslashes and line feeds become \\s and \\n.
    """
    role = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), escape(role), F.lit("\n"))
    text = escape(F.col("text"))
    mine = F.col("role") == "assistant"
    return turns.withColumn("chunk", F.concat(head, text, F.lit(END + "\n"))).withColumn("loss_at", F.when(mine, F.length(head)).otherwise(0)).withColumn("loss_len", F.when(mine, F.length(text)).otherwise(0))


def read_back(rendered: DataFrame) -> DataFrame:
    """Add back_role, back_text and loss_text, read from chunk and mask alone."""
    body = F.regexp_extract("chunk", r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\z", 1)
    text = F.regexp_extract("chunk", r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\z", 2)
    role = F.replace(F.replace(unescape(body), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
    return rendered.withColumn("back_role", role).withColumn("back_text", unescape(text)).withColumn("loss_text", unescape(F.substring("chunk", F.col("loss_at") + 1, F.col("loss_len"))))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation the digests of what was read back, turns in order of (at, part), ties by role and text.

    A digest runs over a conversation's bytes in order, which no split can shorten; a task therefore streams its sorted
    rows through running hashes and holds one row at a time, however long the conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = read.select("conv_id", "at", "part", "back_role", "back_text", "loss_text", F.length("chunk").cast("long").alias("size"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part", "back_role", "back_text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def close() -> None:
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(6)], names=[x.split()[0] for x in schema.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("conv_id", "back_role", "back_text", "loss_text", "size")]
            for conv, role, text, loss, size in zip(*cols, strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            yield made()
        close()
        yield made()

    return ordered.mapInArrow(fold, schema)
