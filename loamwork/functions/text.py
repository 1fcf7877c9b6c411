"""Expressions over texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions import fixed


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), F.lit("[a-z0-9]+"), F.lit(0))


def ranking_tokens(text: Column) -> Column:
    """Distinct lower-cased words of two characters or more that are no stop words, by their aliases."""
    alias = F.create_map(*(F.lit(x) for kv in fixed.TOKEN_ALIASES.items() for x in kv))
    stops = F.array(*map(F.lit, fixed.STOP_WORDS))
    kept = F.filter(words(text), lambda w: (F.length(w) >= 2) & ~F.array_contains(stops, w))
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(alias, w), w)))


def task_tokens(task: str) -> list[str]:
    """ranking_tokens of a query's own parameter, worked out where the plan is made."""
    found = (w for w in re.findall("[a-z0-9]+", task.casefold().replace("_", " ")) if len(w) >= 2 and w not in fixed.STOP_WORDS)
    return list(dict.fromkeys(fixed.TOKEN_ALIASES.get(w, w) for w in found))


def any_of(tokens: Column, wanted) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, wanted)))


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unfinished last line; none for an empty text."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def canonical_newlines(text: Column) -> Column:
    """Without one leading byte-order mark, CRLF and CR as LF."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def token_estimate(n_bytes: Column) -> Column:
    return F.floor((n_bytes + 2) / 3).cast("long")


def truncate_utf8(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8, no character split: a continuation byte at the cut takes its character along."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, n)
    whole = [F.decode(F.substring(raw, 1, n - k), "UTF-8") for k in range(4)]
    next_byte = lambda k: F.hex(F.substring(raw, n - k + 1, 1))  # noqa: E731  the byte behind the cut
    starts = lambda k: ~next_byte(k).rlike("^[89AB]")
    return F.when(F.octet_length(text) <= n, text).when(starts(0), F.decode(cut, "UTF-8")).when(starts(1), whole[1]).when(starts(2), whole[2]).otherwise(whole[3])


def license_name(text: Column) -> Column:
    """The first marker, in the fixed order, within the first 16,384 characters."""
    head = F.lower(F.substring(text, 1, 16384))
    out = F.lit(None).cast("string")
    for marker, name in reversed(fixed.LICENSE_MARKERS):
        out = F.when(F.contains(head, F.lit(marker)), name).otherwise(out)
    return out


def binary_reason(content: Column) -> Column:
    """binary for a NUL byte; invalid_encoding; binary for over 30 % control bytes; else null. Only the first 8 KiB
    count, so that a character split at their end reads as invalid, as it should for the same results."""
    head = F.substring(content, 1, fixed.SNIFF_BYTES)
    pairs = F.hex(head)
    size = F.octet_length(head)
    texts = "|".join(f"{b:02X}" for b in fixed.TEXT_CONTROLS)
    # pairs of hex digits: drop the control bytes that text may hold, then count the other ones
    listed = F.regexp_replace(pairs, "(..)", "$1 ")
    controls = F.size(F.regexp_extract_all(F.regexp_replace(listed, f"\\b({texts})\\b", ""), F.lit(r"\b[01][0-9A-F]\b"), F.lit(0)))
    return (
        F.when(size == 0, F.lit(None).cast("string")).when(listed.rlike(r"\b00\b"), "binary").when(~F.is_valid_utf8(head.cast("string")), "invalid_encoding")
        .when(controls / size > fixed.SNIFF_CONTROL_RATIO, "binary")
    )


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def redact(text: Column) -> Column:
    """Bearer tokens, credentials of URLs and values of sensitive query parameters replaced."""
    out = F.regexp_replace(text, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 [REDACTED]")
    out = F.regexp_replace(out, r"([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1[REDACTED]@")
    return F.regexp_replace(out, r"(?i)([?&](?:api_key|key|password|secret|token)=)[^&\s#]*", "$1[REDACTED]")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 of the canonical JSON array of the prefix and the parts."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat(F.lit(f'["{prefix}",'), F.concat_ws(",", *quoted), F.lit("]")), 256))
