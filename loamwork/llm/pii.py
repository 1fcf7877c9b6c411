"""Personal data: spans by pattern, and terms that give protected entities away.

Patterns find emails, IP addresses, card and phone numbers, and secrets that a text names as such (a token, key or
password and its value): the protected entities. Over the whole corpus, a term's
pointwise mutual information with an entity, by documents that hold both, against the entity's own information, says
how strongly the term reveals it (C-sanitisation, Sanchez and Batet 2016). Terms over the threshold are generalised
wherever they stand in the entity's documents, stronger ones removed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm import worker
from loamwork.llm.store import Held, join_checked, materialise, prepare, row_bytes

#: The base kinds, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "term", "secret")
BASE, TERM, SECRET = 4, 4, 5
#: Measured bytes of the most frequent terms that every executor gets to rule out pairs.
FREQUENT_BYTES = 8 << 20
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, and takes whole runs: no start within a run, no backtracking into one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")
# How texts name a secret.
_SECRET = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/=.~-]{16,})")


@dataclass(frozen=True)
class Disclosure:
    """prior: documents without the entity that every term is taken to have besides those counted, so that a term seen once
    or twice says less than one seen often. generalise, remove: thresholds on the smoothed PMI(entity; term) / IC(entity),
    which nears one as the term is seen with the entity only, in ever more documents."""

    prior: float = 4.0
    generalise: float = 0.8
    remove: float = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @ outward: linear, unlike a plain search."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kinds as listed in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    out.sort()
    return out


def protected(text: str) -> list[tuple[int, int, int]]:
    """The base spans and the values of named secrets, sorted."""
    named = [(m.start(1), SECRET, m.end(1)) for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    return sorted(base_spans(text) + named) if named else base_spans(text)


def entity(kind: int, text: str) -> str:
    """The protected entity of a span: addresses by lower case, numbers by digits, secrets as they are."""
    return f"{KINDS[kind]}:{text if kind == SECRET else text.lower() if kind < 2 else ''.join(_DIGIT.findall(text))}"


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms of the text that no span touches; spans sorted."""
    k, reach = 0, 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][2])
            k += 1
        if a >= reach:
            yield m[0].lower(), a, b


FOUND = "kinds array<int>, starts array<int>, ends array<int>, entities array<string>, terms array<string>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.free()
    for batch in batches:
        spans, entities, terms = [], [], []
        for text in batch.column("text").to_pylist():
            own = protected(text) if text else []
            spans.append(own)
            entities.append(sorted({entity(kind, text[a:b]) for a, kind, b in own}))
            terms.append(sorted({t for t, _, _ in outside(text, own)}) if own else [])
        made = [pa.array([[x[j] for x in s] for s in spans], pa.list_(pa.int32())) for j in (1, 0, 2)]
        made += [pa.array(x, pa.list_(pa.string())) for x in (entities, terms)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "kinds", "starts", "ends", "entities", "terms"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, tid2, text) -> doc_id, tid, tid2, the protected spans, and where there are any the document's distinct
    entities and terms; no text."""
    return docs.select("doc_id", "tid", "tid2", "text").mapInArrow(_find, f"doc_id long, tid long, tid2 int, {FOUND}")


def _all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["term", "n"])

    for batch in batches:
        for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            for t in set(_TERM.findall((text or "").lower())):
                total[t] += 1 / copies
        if len(total) > 200_000:
            yield flush()
            total.clear()
    yield flush()


def term_documents(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n): distinct texts of the whole corpus that have it; each of k copies counts for a k-th."""
    counted = join_checked(docs.select("tid", "tid2", "text"), copies, ["tid", "tid2"], "left").select("text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    return counted.mapInArrow(_all_terms, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n"))


def _disclosure(both: Column, n: Column, ne: Column, total: float, rule: Disclosure) -> Column:
    """The smoothed PMI(entity; term) / IC(entity), which never falls as `both` grows."""
    seen = (both + rule.prior * ne / total) / (n + rule.prior)
    pmi, ic = F.log(seen * total / ne), F.log(F.lit(total) / ne)
    return F.when(ic > 0, pmi / ic).otherwise(0.0)


def frequent(counts: DataFrame, total: float, rule: Disclosure) -> DataFrame:
    """(term, n) of terms too frequent to disclose an entity of one text, the most frequent ones that fit FREQUENT_BYTES,
    marked for a broadcast: a power of two of documents is in whole or not at all."""
    one = F.lit(1).cast("long")
    out = counts.filter(_disclosure(one, F.col("n"), one, total, rule) < rule.generalise)
    width = F.length(F.bin(F.col("n").cast("long")))
    room, least = FREQUENT_BYTES, 65
    for w, size in sorted(out.groupBy(width).agg(F.sum(row_bytes(out))).collect(), reverse=True):
        if size > room:
            break
        room, least = room - size, w
    return F.broadcast(out.filter(width >= least))


def disclosing(docs: DataFrame, found: DataFrame, rule: Disclosure, hold: Held) -> DataFrame:
    """(entity, term, disclosure): the pairs at or over the generalise threshold.

    With N distinct texts, n(e), n(t) and n(e, t) of them holding the entity, the term, and both, anywhere in the text,
    p(e | t) is smoothed to (n(e, t) + prior n(e) / N) / (n(t) + prior), PMI = ln(p(e | t) N / n(e)) and IC = ln(N / n(e)).
    Equal texts are one, so that copies of a document support nothing.

    A pair of a frequent term is counted only if it would reach the threshold with n(e, t) = n(e), the most that can be; for
    most pairs that is settled where the document lies, before any is shuffled. The other terms' pairs are all counted.
    """
    copies = hold(found.groupBy("tid", "tid2").agg(F.count("*").alias("copies")).filter("copies > 1"))
    twice = copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    total = float(found.count() - twice)
    held = found.filter(F.size("entities") > 0).select("tid", "tid2", "entities", "terms").dropDuplicates(["tid", "tid2"])
    held = hold(held)
    of_entity = hold(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("ne")))
    counts = hold(term_documents(docs, copies))
    pairs = join_checked(held.select(F.explode("entities").alias("entity"), "terms"), of_entity, ["entity"], "inner").select("entity", "ne", F.explode("terms").alias("term"))
    pairs = pairs.join(frequent(counts, total, rule), "term", "left")
    pairs = pairs.filter(F.col("n").isNull() | (_disclosure(F.col("ne"), F.col("n"), F.col("ne"), total, rule) >= rule.generalise))
    pairs = pairs.groupBy("entity", "ne", "term").agg(F.count("*").alias("both"))
    scored = pairs.join(counts, "term").withColumn("disclosure", _disclosure(F.col("both"), F.col("n"), F.col("ne"), total, rule))
    return scored.filter(F.col("disclosure") >= rule.generalise).select("entity", "term", "disclosure")


EXTRA = "array<struct<start: int, kind: int, end: int, disclosure: double>>"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]))
    for batch in batches:
        extra = []
        for text, told in zip(batch.column("text").to_pylist(), batch.column("told").to_pylist(), strict=True):
            score = {x["term"]: x["disclosure"] for x in told}
            extra.append([{"start": a, "kind": TERM, "end": b, "disclosure": score[t]} for t, a, b in outside(text, protected(text)) if t in score])
        yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("tid2"), pa.array(extra, kind)], names=["tid", "tid2", "extra"])


def locate(docs: DataFrame, found: DataFrame, told: DataFrame, hold: Held) -> DataFrame:
    """(tid, tid2, extra): for each text with a disclosing term of one of its entities, all places of those terms."""
    of = found.filter(F.size("entities") > 0).select("tid", "tid2", "entities", "terms").dropDuplicates(["tid", "tid2"])
    of = of.select("tid", "tid2", F.explode("entities").alias("entity"), "terms")
    by = hold(told.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("score")))
    hit = join_checked(of, by, ["entity"], "inner")
    hit = hit.select("tid", "tid2", F.explode(F.filter(F.transform("terms", lambda t: F.struct(t.alias("term"), F.element_at("score", t).alias("disclosure"))), lambda x: x["disclosure"].isNotNull())).alias("x"))
    hit = hit.groupBy("tid", "tid2", "x.term").agg(F.max("x.disclosure").alias("disclosure"))
    hit = hold(hit.groupBy("tid", "tid2").agg(F.collect_list(F.struct("term", "disclosure")).alias("told")))
    texts = join_checked(docs.select("tid", "tid2", "text"), hit, ["tid", "tid2"], "inner")
    # equal texts have equal places
    return texts.mapInArrow(_locate, f"tid long, tid2 int, extra {EXTRA}").dropDuplicates(["tid", "tid2"])


def _key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("tid"), F.hash(whole).alias("tid2"), F.col(text).alias("text"))


def spans(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, tid and tid2 (hashes of the text), spans: array of (start, kind, end, disclosure), sorted.

    Kinds are numbered as in KINDS: 0 to 3 the base ones, 4 terms, 5 secrets; disclosure is null but for terms. A null or empty text
    has none; rows are judged each by itself, equal ones alike; an empty table gives no rows. Texts are read for spans and
    terms, for the counts of terms, and for the places of disclosing ones; they are shuffled only where what is joined to
    them is too large to broadcast.
    """
    prepare(docs.sparkSession)
    base = _key(docs, doc_id, text)
    found = materialise(find(base), "found")
    with Held() as hold:
        told = materialise(disclosing(base, found, rule, hold), "disclosing")
        hits = materialise(locate(base, found, told, hold), "terms_found")
    own = F.transform(F.arrays_zip("starts", "kinds", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["kinds"].alias("kind"), x["ends"].alias("end"), F.lit(None).cast("double").alias("disclosure")))
    joined = join_checked(found, hits, ["tid", "tid2"], "left")
    return joined.select("doc_id", "tid", "tid2", F.array_sort(F.concat(own, F.coalesce("extra", F.array().cast(EXTRA)))).alias("spans"))


def report(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """Per row: doc_id, a count a kind, base_sha256 of the base spans and spans, kind:start:end by comma, and any_span."""
    told = spans(docs, rule)
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = {f"n_{k}": F.size(F.array_remove(F.transform("spans", lambda x: x["kind"] == KINDS.index(k)), False)).cast("long") for k in KINDS}
    return told.withColumns(count).select("doc_id", *count, F.sha2(F.encode(line(F.filter("spans", lambda x: x["kind"] < BASE)), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("any_span"))


def cleaned(text: str, found: list[tuple[int, int, int, float | None]], remove: float) -> str:
    """The text with protected spans as [KIND], terms as [TERM] or, from `remove` on, left out. Overlapping spans fall to the
    first, and a longer one's rest goes with it."""
    out, at = [], 0
    for start, kind, end, disclosure in found:
        if start < at:
            at = at if kind == TERM else max(at, end)
            continue
        out.append(text[at:start])
        out.append(f"[{KINDS[kind].upper()}]" if kind != TERM or disclosure < remove else "")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text sanitised; all rows and columns stay, a null text stays null.

    What a text reveals depends on the text and the corpus alone, so spans find their rows by two hashes of the text.
    """
    keys = lambda t: (F.xxhash64(t).alias("tid"), F.hash(t).alias("tid2"))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    told = spans(named, rule).filter(F.size("spans") > 0).select("tid", "tid2", "spans").dropDuplicates(["tid", "tid2"])
    told = materialise(told, "spans")

    @F.arrow_udf("string")
    def clean(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([t if t is None or not s else cleaned(t, [(x["start"], x["kind"], x["end"], x["disclosure"]) for x in s], rule.remove) for t, s in rows], pa.string())

    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys(F.coalesce(F.col(text), F.lit(""))))
    joined = join_checked(keyed, told, ["tid", "tid2"], "left")
    new = F.when(F.col("spans").isNull(), F.col("row")[text]).otherwise(clean(F.col("row")[text], F.col("spans")))
    return joined.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
