"""SentencePiece encoding and decoding with a given model's pieces and scores.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give every piece that
ends there, and each relaxes the position's best score: that of the place where the piece begins, plus the piece's own.
A unigram model's path has the greatest sum of scores. A BPE model's scores are merge ranks, and the greatest sum over all
paths is not what its merges give: there a piece costs infinitely much behind one that it would not stay apart from when
their joint text is merged, so that the best score is finite on one path of each prefix alone, the one that merges give.
Characters that no piece has fall back to their UTF-8 bytes. Decoding gives back the exact text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm import worker
from loamwork.llm.store import fresh, prepare

#: Where the model lies by default; every function takes another path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Distinct stretches of text whose pieces a worker remembers, in each of two generations.
MEMORY = 300_000


@dataclass(frozen=True)
class Pieces:
    """Normal pieces (text, id, score), the id of each byte, and the unknown id where a model lacks byte pieces."""

    normal: list[tuple[str, int, float]]
    byte_ids: dict[int, int]
    unknown: int
    size: int
    bpe: bool = False


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _field(data: bytes, number: int) -> int | bytes | None:
    """The last field of that number in a protocol buffer message."""
    at, found = 0, None
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        if tag >> 3 == number:
            found = value
    return found


def is_bpe(model: bytes) -> bool:
    """trainer_spec (field 2) has model_type (field 3): 1 unigram, the default, 2 BPE."""
    return _field(_field(model, 2) or b"", 3) == 2


def checked(model: bytes) -> bytes:
    """The model, if its texts are taken as they are; else an error, since ids under other rules would be silently wrong.

    normalizer_spec (field 3): precompiled_charsmap (2) must be empty, add_dummy_prefix (3) and escape_whitespaces (5) on,
    their default, remove_extra_whitespaces (4) off. trainer_spec: treat_whitespace_as_suffix (24) off.
    """
    rules = _field(model, 3) or b""
    off = [name for name, number, right in (("add_dummy_prefix", 3, 1), ("remove_extra_whitespaces", 4, 0), ("escape_whitespaces", 5, 1)) if (1 if (got := _field(rules, number)) is None else got) != right]
    if off or _field(rules, 2) or _field(_field(model, 2) or b"", 24):
        raise ValueError(f"the model normalises texts or marks spaces in another way: {', '.join(off) or 'a character map or spaces as suffixes'}")
    return model


def load(path: str = MODEL) -> Pieces:
    """A model's pieces, for models that checked() lets pass and that have no user-defined pieces."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = checked(f.read())
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    normal, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append((piece, i, model.get_score(i)))
    return Pieces(normal, byte_ids, model.unk_id(), model.get_piece_size(), is_bpe(raw))


class Codec:
    """encode: text -> ids as packed int32; decode: ids -> text."""

    def __init__(self, pieces: Pieces):
        if len(pieces.byte_ids) not in (0, 256):
            raise ValueError("a model has all 256 byte pieces or none")
        self.automaton = ahocorasick.Automaton()
        for text, i, score in pieces.normal:
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        self.single = {t for t, _, _ in pieces.normal if len(t) == 1}
        self.low = min((s for _, _, s in pieces.normal), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown = pieces.byte_ids, pieces.unknown
        self.bytes_of = [b""] * pieces.size
        for text, i, _ in pieces.normal:
            self.bytes_of[i] = text.replace(SPACE, " ").encode()
        for b, i in pieces.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        # No piece has a space mark behind another character, or one of the cuts beside one: best paths then meet
        # at these places and each stretch between them can be solved, and remembered, by itself.
        cuts = "".join(c for c in "\n\t" if not any(c in t for t, _, _ in pieces.normal if len(t) > 1))
        if any(SPACE in t.lstrip(SPACE) for t, _, _ in pieces.normal):
            self.stretch = re.compile(f"[^{SPACE}]+|{SPACE}")
        else:
            self.stretch = re.compile(f" +[^ {cuts}{SPACE}]*|[^ {cuts}{SPACE}]+|[{cuts}{SPACE}]")
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bpe, self.score = pieces.bpe, {t: x for t, _, x in pieces.normal}
        self.text_of = {i: t for t, i, _ in pieces.normal}
        self.apart: dict[int, bool] = {}
        # No piece holds two neighbours that are not in here: a stretch can be cut between them.
        self.joins = {t[k : k + 2] for t, _, _ in pieces.normal for k in range(len(t) - 1)}

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The text by merges: the neighbours of the best-scored joint piece first, the leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            joint = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            top = max(joint)
            if top == -np.inf:
                break
            k = joint.index(top)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stays(self, before: int, piece: int) -> bool:
        """Whether a piece behind another (-1: none, or a fallback) comes out of the merges as it is."""
        if len(self.apart) > 3 * MEMORY:
            self.apart.clear()
        parts = [self.text_of[i] for i in (before, piece) if i >= 0]
        got = self.apart[before << 32 | piece] = self.merged("".join(parts)) == parts
        return got

    def path_of_merges(self, text: str) -> list[int]:
        """The path of the best score, where a piece behind one that it would merge with scores minus infinity. piece: the
        last piece of each prefix's best path, -1 none or a fallback."""
        n, apart, known, low = len(text), self.apart, self.single.issuperset(text), -np.inf
        best = [0.0] + [low] * n
        piece, came = [-1] * (n + 1), [0] * (n + 1)
        seen = 0
        for last, (length, score, i) in self.automaton.iter(text):
            end = last + 1
            if not known and seen < end:
                self._bridge(text, best, piece, came, seen, end)
                seen = end
            start = end - length
            if best[start] + score > best[end]:
                stays = apart.get(piece[start] << 32 | i)
                if self.stays(piece[start], i) if stays is None else stays:
                    best[end], piece[end], came[end] = best[start] + score, i, start
        self._bridge(text, best, piece, came, seen, n)
        return self._trace(text, piece, came)

    def _bridge(self, text: str, best: list[float], piece: list[int], came: list[int], start: int, end: int) -> None:
        for q in range(start, end):
            if text[q] not in self.single and (s := best[q] + self.low) > best[q + 1]:
                best[q + 1], came[q + 1], piece[q + 1] = s, q, -1

    def _trace(self, text: str, piece: list[int], came: list[int]) -> list[int]:
        out: list[int] = []
        at = len(text)
        while at:
            if piece[at] < 0:
                out += reversed(self._fallback(text[came[at]]))
            else:
                out.append(piece[at])
            at = came[at]
        out.reverse()
        return out

    def viterbi(self, text: str) -> list[int]:
        """The path of the greatest sum of scores; a fallback is worse than any piece."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        piece, came = [-1] * (n + 1), [0] * (n + 1)
        seen = 0
        for last, (length, score, i) in self.automaton.iter(text):
            if last >= seen:
                self._bridge(text, best, piece, came, seen, last + 1)
                seen = last + 1
            if (s := best[last + 1 - length] + score) > best[last + 1]:
                best[last + 1], came[last + 1], piece[last + 1] = s, last + 1 - length, i
        self._bridge(text, best, piece, came, seen, n)
        return self._trace(text, piece, came)

    def solve(self, stretch: str) -> bytes:
        """ids of one stretch without space marks of its own, part by part."""
        text, joins, memory, older = stretch.replace(" ", SPACE), self.joins, self.memory, self.older
        best = self.path_of_merges if self.bpe else self.viterbi
        out, start = [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in joins:
                part = text[start:k]
                # parts have space marks where stretches have spaces, so that both can share the memory
                if (got := memory.get(part)) is None:
                    got = older.get(part) or array("i", best(part)).tobytes()
                    if k - start <= 64:
                        memory[part] = got
                out.append(got)
                start = k
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The text, with a space put before it, as ids. An empty text has none."""
        if not text:
            return b""
        if len(self.memory) > MEMORY:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        out = []
        marked = SPACE in text
        for x in self.stretch.findall(" " + text):
            got = memory.get(x)
            if marked and x == SPACE:  # the memory has it as a space; the text's own mark goes by its bytes
                out.append(array("i", self._fallback(x)).tobytes())
                continue
            if got is None:
                got = older.get(x) or self.solve(x)
                if len(x) <= 64:
                    memory[x] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of any ids: what is no UTF-8 becomes U+FFFD; ids that the model has not, null and control ones are nothing."""
        table = self.bytes_of
        try:
            if min(ids, default=0) < 0:
                raise IndexError
            text = b"".join([table[i] for i in ids])
        except (IndexError, TypeError):
            text = b"".join([table[i] for i in ids if i is not None and 0 <= i < len(table)])
        return text.decode(errors="replace")[1:]


def codec_of(pieces: Pieces) -> Codec:
    """The worker's codec, kept with its memory from task to task until another model or operator comes."""
    return worker.kept(pieces, lambda: Codec(pieces))


def encode(text: Column, pieces: Pieces) -> Column:
    """array<int> of the whole text's ids (null: none)."""

    @F.arrow_udf("array<int>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(pieces)
        for batch in texts:
            made = [codec.encode(t or "") for t in batch.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(made), np.int32)))

    return of(text)


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of ids (null or none: empty)."""

    @F.arrow_udf("string")
    def of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(pieces)
        for batch in arrays:
            yield pa.array([codec.decode(x or []) for x in batch.to_pylist()], pa.string())

    return of(ids)


def tokenize(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens and round_trip (decoding the ids gives the text back; a null text counts as empty).

    One pass over each text, no shuffle; the pieces, as many as the model has, travel with the code. Encoding and the
    check run in one Python stage. Columns of docs with these names are replaced.
    """
    prepare(docs.sparkSession)
    pieces = load(model)

    @F.arrow_udf("struct<ids: array<int>, n_tokens: bigint, round_trip: boolean>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(pieces)
        for batch in texts:
            rows = [t or "" for t in batch.to_pylist()]
            made = [codec.encode(t) for t in rows]
            sizes = [len(x) // 4 for x in made]
            flat = np.frombuffer(b"".join(made), np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            back = [codec.decode(flat[a:b].tolist()) == t for a, b, t in zip(offsets[:-1], offsets[1:], rows, strict=True)]
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes, pa.int64()), pa.array(back, pa.bool_())], names=["ids", "n_tokens", "round_trip"])

    held = fresh(docs, "pieces")
    told = docs.withColumn(held, of(F.col(text)))
    return told.withColumns({c: F.col(held)[c] for c in ("ids", "n_tokens", "round_trip")}).drop(held)
