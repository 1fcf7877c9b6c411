"""Quality rules by document and by host.

Every document gets rule features over its whole text. Rule failures are counted by host, which is the domain of a URL;
a beta prior is fitted to the hosts' failure rates by the method of moments, every host's rate is shrunk towards it, and
hosts whose shrunk rate lies far above what the prior expects of a host lose all their documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.store import join_checked, materialise, prepare
from loamwork.llm.text import grams, pieces

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
RULES = ("short", "repeats", "symbols", "lines")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_pct: the base rules. max_symbol_pct: symbols against word characters; max_dup_line_pct: of
    lines with a word. A host is rejected if its shrunk failure rate is over least_rate and over the prior's mean by more
    than `spread` of the prior's standard deviations. prior_floor, prior_ceiling: bounds on the prior's strength
    (pseudo-documents), so that a host of few documents can't be condemned by them alone, and hosts that are all alike
    don't make every small difference count."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    least_rate: float = 0.2
    spread: float = 3.0
    prior_floor: float = 20.0
    prior_ceiling: float = 200.0


def repeat_words(hashes: np.ndarray, k: int = 8) -> int:
    """Words that lie in a k-word window found twice or more among one text's windows."""
    n = len(hashes)
    if n <= k:
        return 0
    windows = grams(hashes, k)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # equal 64-bit sums are confirmed on the words' own hashes, each window against the one before it in its run
    at = np.flatnonzero(same)
    a, b = order[at], order[at + 1]
    alike = np.ones(len(at), bool)
    for j in range(k):
        alike &= hashes[a + j] == hashes[b + j]
    starts = np.concatenate([a[alike], b[alike]])
    cover = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    cover[starts] += 1
    cover[starts + k] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def dup_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines)), len(lines)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        out: list[tuple] = []
        for p in pieces(text):
            for i, t in enumerate(text.slice(p.row, p.n).to_pylist()):
                t = t or ""
                own = p.hash[p.first[i] : p.first[i + 1]]
                d, lines = dup_lines(t)
                out.append((len(own), len(t) - sum(map(t.count, WHITE)), sum(map(t.count, SYMBOLS)), d, lines, repeat_words(own)))
        made = [pa.array([r[j] for r in out], pa.int64()) for j in range(6)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *(x.split()[0] for x in FEATURES.split(", "))])


def document_features(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and, for every row, the features over its whole text (null: no words)."""
    prepare(docs.sparkSession)
    kept = docs.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_features, f"{schema}, {FEATURES}")


def failures(r: Rules) -> dict[str, Column]:
    """One boolean a rule, of features."""
    return {
        "short": F.expr(f"n_words < {r.min_words}"),
        "repeats": F.expr(f"100 * n_repeat_words > {r.max_repeat_pct} * n_words"),
        "symbols": F.expr(f"100 * n_symbols > {r.max_symbol_pct} * word_chars"),
        "lines": F.expr(f"100 * n_dup_lines > {r.max_dup_line_pct} * n_lines"),
    }


def host_rates(flagged: DataFrame, host: str, r: Rules) -> DataFrame:
    """Per host: n, failed, the shrunk rate, the limit of the fitted prior and the verdict.

    Prior: mean m is the pooled rate; the strength s solves the beta-binomial moment equation on hosts weighted by their
    size, within prior_floor and prior_ceiling. Shrunk rate: (failed + m s) / (n + s). Limit: m + spread sd, where
    sd^2 = m (1 - m) / (s + 1) is the prior's variance, and least_rate at least.
    """
    hosts = flagged.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialise(hosts.filter(F.col(host).isNotNull()), "hosts")
    t = hosts.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") ** 2).alias("n2")).first()
    n, k = t["n"] or 0, t["k"]
    m = (t["f"] or 0) / n if n else 0.0
    q = hosts.agg(F.sum(F.col("n") * F.pow(F.col("n_failed") / F.col("n") - F.lit(m), 2)).alias("q")).first()["q"] or 0.0
    rho = 0.0
    if k > 1 and 0 < m < 1:
        # E q = m (1-m) [ (k-1) + rho (n - n2/n - (k-1)) ], rho = 1 / (s + 1)
        room = n - t["n2"] / n - (k - 1)
        rho = min(1.0, max(0.0, (q / (m * (1 - m)) - (k - 1)) / room)) if room > 0 else 0.0
    strength = min(r.prior_ceiling, max(r.prior_floor, 1 / rho - 1)) if rho > 0 else r.prior_ceiling
    limit = max(r.least_rate, m + r.spread * math.sqrt(m * (1 - m) / (strength + 1)))
    rate = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_limit", F.lit(limit)).withColumn("host_rejected", F.col("host_rate") > F.lit(limit))


def domain(source: Column) -> Column:
    """The host of a URL, lower-cased, without user, port and a leading www.; any other value is a host as it is."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    return F.when(host != "", F.regexp_replace(F.lower(host), r"^www\.(?=.)", "")).otherwise(source)


def judge(docs: DataFrame, rules: Rules = Rules(), host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, host, features, a boolean a rule, base_failed, host_rate, host_rejected, kept. The host is the
    domain of the column `host`, if that holds URLs, else the column itself.

    base_failed is "short or repeats"; a document fails for its host if any rule fails. kept: neither base_failed nor of
    a rejected host. A null text has no words and fails as short; a null host is no host: its documents are judged by
    the base rules alone; rows with equal ids are judged each by itself; an empty table gives no rows. Only the features
    (no text) are written and shuffled.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), domain(F.col(host).cast("string")).alias("host"), F.col(text).alias("text"))
    features = materialise(document_features(named, ["doc_id", "host"]), "features")
    rule = failures(rules)
    flagged = features.select("*", *(c.alias(f"fails_{k}") for k, c in rule.items())).withColumn("failed", reduce(lambda a, b: a | b, rule.values()))
    hosts = host_rates(flagged, "host", rules).select("host", "host_rate", "host_rejected")
    out = join_checked(flagged, hosts, ["host"], "left")
    base = F.col("fails_short") | F.col("fails_repeats")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.withColumn("host_rejected", rejected).withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)
