"""Candidate ranking for a task: scores with their signals, facets, fallback picks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions import fixed, paths
from loamwork.functions.text import ranking_tokens, task_tokens
from loamwork.operators.ranking import global_row_number


def _overlap(tokens: Column, wanted) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, wanted)).cast("array<string>")))


def score(candidates: DataFrame, task: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, symbols array, summary array, semantic, entry, direct_test, pinned booleans) -> path, score, signals, carry.

    1, and 12, 8 and 6 a token that the task shares with the path, the symbols and the summary; a pin 10,000, a semantic
    record 0.5. A metadata penalty counts instead of entry point (10) or implementation file (3) and role scores. Tests
    gain 10 or 2 if asked for, and lose 12 otherwise. Never below 0.
    """
    wants = task_tokens(task)
    path = F.col("path")
    m = {"path": _overlap(ranking_tokens(path), wants), "symbol": _overlap(F.col("symbols"), wants), "summary": _overlap(F.col("summary"), wants)}
    penalty = paths.metadata_penalty(path, wants)
    code = paths.is_implementation(path)
    role = F.when(F.col("entry"), 10.0).when(code, 3.0).otherwise(0.0) + paths.role_score(path, wants)
    any_match = (m["path"] + m["symbol"] + m["summary"]) > 0
    asked = bool({"test", "regression"} & set(wants))
    test = paths.is_test_ranked(path)
    direct, matched = F.lit(asked) & F.col("direct_test"), F.lit(asked) & any_match
    total = (
        1.0 + m["path"] * 12.0 + m["symbol"] * 8.0 + m["summary"] * 6.0 + F.when(F.col("pinned"), 10_000.0).otherwise(0.0) + F.when(F.col("semantic"), 0.5).otherwise(0.0)
        + F.when(penalty != 0, penalty).otherwise(role) + F.when(~test, 0.0).when(direct, 10.0).when(matched, 2.0).otherwise(-12.0)
    )
    named = [F.when(F.col("pinned"), "manual_pin")]
    named += [F.when(n > 0, F.concat(F.lit(f"task_{k}_token_matches="), n.cast("string"))) for k, n in m.items()]
    named += [F.when(F.col("semantic"), "current_semantic_record"), F.when(penalty != 0, "incidental_metadata_penalty")]
    named += [F.when(penalty == 0, F.when(F.col("entry"), "application_entry_point").when(code, "implementation_file"))]
    named += [F.when((penalty == 0) & has, k) for k, (_, has) in paths.task_roles(path, wants).items()]
    named += [F.when(test, F.when(direct, "direct_related_test").when(matched, "task_matched_test").when(any_match, "unrequested_test_penalty").otherwise("unrelated_test_penalty"))]
    return candidates.select("path", F.greatest(total, F.lit(0.0)).alias("score"), F.slice(F.array_distinct(F.array_compact(F.array(*named))), 1, 10).alias("signals"), *carry)


#: What the facet functions need of a candidate besides its score.
FACET_COLUMNS = ("symbols", "summary", "entry")

RELEVANT = ("application_entry_point", "browser_bootstrap_role", "browser_document_role", "configuration_role", "direct_related_test", "media_client_role", "media_search_service_role", "server_entry_role", "startup_manifest_role")


def is_relevant(signals: Column) -> Column:
    """A pin or a role; tests that count against a record leave only the pin."""
    pinned = F.array_contains(signals, "manual_pin")
    against = F.arrays_overlap(signals, F.array(F.lit("unrelated_test_penalty"), F.lit("unrequested_test_penalty")))
    return F.when(against, pinned).otherwise(pinned | F.arrays_overlap(signals, F.array(*map(F.lit, RELEVANT))))


def rank(scored: DataFrame) -> DataFrame:
    """Add rank by (score descending, path), and candidate_id, ten hex digits of the path's hash, two more a collision."""
    ranked = global_row_number(scored, "rank", [-F.col("score"), F.col("path")])
    digest = F.sha2("path", 256)
    nth = F.row_number().over(Window.partitionBy(F.substring(digest, 1, 10)).orderBy("rank"))
    return ranked.withColumn("candidate_id", F.concat(F.lit("c-"), F.substring(digest, F.lit(1), 10 + 2 * (nth - 1))))


@dataclass(frozen=True)
class Facet:
    label: str
    tokens: frozenset[str]
    substantial: bool = True


# The words that startup and test facets stand for.
STARTUP = frozenset({"app", "application", "boot", "bootstrap", "entry", "main", "server", "start", "startup"})


def facets(task: str, most: int = 4) -> list[Facet]:
    """The intents of a task, one a clause, distinct by label."""
    out: dict[str, Facet] = {}
    for clause in re.split(r"\s*(?:,|;|\b(?:and|then|plus)\b)\s*", task.casefold()):
        tokens, raw = set(task_tokens(clause)), set(re.findall("[a-z0-9]+", clause))
        has = tokens.intersection
        rules = (
            (has({"start", "startup", "boot", "bootstrap"}), lambda: Facet("application startup", STARTUP)),
            (has({"config", "setting"}) and not has({"implementation", "service"}), lambda: Facet("configuration", frozenset({"config", "environment", "setting"}))),
            ({"media", "search"} <= tokens and has({"implementation", "integration", "provider", "service"}), lambda t=tokens: Facet("media search service", frozenset(t))),
            (has({"endpoint", "http", "route"}), lambda t=tokens: Facet("server integration", frozenset(t | {"server"}))),
            ("server" in tokens and has({"code", "entry", "integration"}), lambda t=tokens: Facet("server integration", frozenset(t))),
            (has({"catalog", "library", "video"}) and has({"client", "render", "renders", "submits"}), lambda t=tokens: Facet("media client", frozenset(t))),
            (raw & {"test", "tests", "file", "files"} and raw & {"coverage", "list", "regression", "relevant", "test", "tests"}, lambda r=raw: Facet("relevant tests/files", frozenset({"file", "test"}), bool(r & {"regression", "test", "tests"}))),
            (tokens, lambda t=tokens: Facet(" ".join(sorted(t)), frozenset(t))),
        )
        made = next((make() for holds, make in rules if holds), None)
        if made and len(out) < most:
            out.setdefault(made.label, made)
    return list(out.values()) or [Facet("task", frozenset(task_tokens(task)))]


def facet_role(facet: Facet, path: Column, entry: Column) -> Column:
    low = F.lower(path)
    stem = F.substring_index(F.substring_index(low, "/", -1), ".", 1)
    base = F.when(entry, 12.0).otherwise(0.0)
    own = {
        "application startup": F.when(entry, 24.0).when(stem.isin("app", "bootstrap", "index", "main", "server", "startup"), 14.0),
        "relevant tests/files": F.when(paths.is_test_ranked(path), 8.0),
        "server integration": F.when(stem.isin("server", "main", "app"), 28.0),
        "media search service": F.when(F.array_contains(ranking_tokens(path), "media") & F.array_contains(ranking_tokens(path), "search"), 32.0),
        "media client": F.when(paths.is_implementation(path) & F.arrays_overlap(ranking_tokens(path), F.array(F.lit("video"), F.lit("library"), F.lit("catalog"))), 26.0),
        "configuration": F.when(stem.isin("config", "configuration", "setting", "settings"), 28.0),
    }.get(facet.label)
    return base if own is None else base + F.coalesce(own, F.lit(0.0))


def in_facets(scored: DataFrame, found: list[Facet], least: float = 8.0) -> DataFrame:
    """(path, score, signals, symbols, summary, entry) with facets: an array of (facet, facet_score, mismatch), those that the
    record has a place in. Records with a metadata penalty, or under the least score, have none."""
    path = F.col("path")
    places = F.array(*(
        F.struct(
            F.lit(f.label).alias("facet"),
            (_overlap(ranking_tokens(path), sorted(f.tokens)) * 12.0 + _overlap(F.col("symbols"), sorted(f.tokens)) * 8.0 + _overlap(F.col("summary"), sorted(f.tokens)) * 6.0 + facet_role(f, path, F.col("entry"))).alias("facet_score"),
            (~paths.is_test_ranked(path) if f.label == "relevant tests/files" else paths.is_test_ranked(path)).alias("mismatch"),
        )
        for f in found
    ))
    held = F.when(F.array_contains("signals", "incidental_metadata_penalty"), F.slice(places, 1, 0)).otherwise(F.filter(places, lambda x: x["facet_score"] >= least))
    return scored.select("path", "score", "signals", held.alias("facets"))


def _order(x: Column) -> Column:
    """The place of a record in a facet; a global rank breaks ties, which is the order of score and path."""
    return F.struct(x["mismatch"].alias("a"), (-x["facet_score"]).alias("b"), (-F.col("score")).alias("c"), F.col("path").alias("d"))


def facet_ranking(placed: DataFrame) -> DataFrame:
    """in_facets() -> facet, path, facet_score, facet_rank."""
    laid = placed.select("path", "score", F.explode("facets").alias("x")).select("path", "score", "x.*")
    # offsets restart a facet: number all, then take off what lies before the facet
    all_ = global_row_number(laid, "place", [F.col("facet"), F.col("mismatch"), -F.col("facet_score"), -F.col("score"), F.col("path")])
    first = all_.groupBy("facet").agg(F.min("place").alias("first"))
    return all_.join(F.broadcast(first), "facet").select("facet", "path", "facet_score", (F.col("place") - F.col("first") + 1).alias("facet_rank"))


def facet_firsts(placed: DataFrame) -> DataFrame:
    """in_facets() -> facet, path: the first record of each facet, a row a facet."""
    laid = placed.select("path", "score", F.explode("facets").alias("x"))
    return laid.groupBy(F.col("x.facet").alias("facet")).agg(F.min_by("path", _order(F.col("x"))).alias("path"))


def covered(placed: DataFrame, found: list[Facet], chosen: int = 5, most: int = 2) -> DataFrame:
    """The first record of each substantial facet that none of the `chosen` best records has a place in, `most` facets at most."""
    top = placed.orderBy(F.desc("score"), "path").limit(chosen).select(F.explode("facets").alias("x")).select("x.facet").distinct()
    open_ = facet_firsts(placed).join(F.broadcast(top), "facet", "left_anti").filter(F.col("facet").isin([f.label for f in found if f.substantial]))
    return open_.orderBy("facet").limit(most)


def preselect(placed: DataFrame, found: list[Facet], limit: int, fill: bool = True) -> DataFrame:
    """in_facets() -> path and tier: the first of each substantial facet, then records by relevance or score floor in rank
    order, and for a generic task one more neutral file, `limit` in all.

    Two looks at the records: one for the facets' firsts and the best score, a few numbers; one for the first rows of each tier
    in order, of which every task keeps `limit`. Nobody is ranked for it.
    """
    labels = [f.label for f in found if f.substantial]
    roles = {"application startup", "configuration", "media client", "media search service", "relevant tests/files", "server integration"}
    generic = any(f.label not in roles for f in found)
    unpinned = F.when(~F.array_contains("signals", "manual_pin"), F.col("score"))
    named = lambda k: F.get(F.filter("facets", lambda x: x["facet"] == k), F.lit(0))
    own = [named(k) for k in labels]
    none = F.array().cast("array<string>")
    told = placed.agg(F.coalesce(F.max(unpinned), F.lit(0.0)).alias("best"), F.array_compact(F.array(*(F.min_by(F.when(x.isNotNull(), F.col("path")), F.when(x.isNotNull(), _order(x))) for x in own)) if own else none).alias("firsts"))  # one row
    floor = F.greatest(F.lit(4.0), F.col("best") * (0.25 if generic else 0.75))
    penalised = F.array_contains("signals", "incidental_metadata_penalty")
    task_match = F.lit(generic) & F.exists("signals", lambda s: s.startswith("task_"))
    good = is_relevant(F.col("signals")) | task_match | (~penalised & (F.col("score") >= floor) & paths.is_implementation(F.col("path")))
    tier = F.when(F.array_contains("firsts", F.col("path")), 0)
    if fill:
        tier = tier.when(good, 1)
    if fill and generic:
        tier = tier.when(~penalised, 2)
    laid = placed.crossJoin(F.broadcast(told)).select("path", "score", tier.alias("tier")).filter("tier is not null")
    # with room left, all of the first tiers are in, and the next row in order is the neutral file
    top = laid.orderBy("tier", F.desc("score"), "path").limit(limit)
    nth = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "path"))
    return top.withColumn("n", nth).filter("tier < 2 or n = 1").select("path", "tier")


def requested_roles(task: str) -> list[str]:
    """The role signals that a task asks for, in order."""
    said = set(task_tokens(task))
    return [signal for signal, groups in fixed.REQUESTED_ROLES if all(said & set(g) for g in groups)]


def fallback_roles(scored: DataFrame, task: str) -> DataFrame:
    """(path, score, signals) -> signal, path: the first record of each role that the task asks for; a path that several
    have counts for the first of them. A row a role at most, found without ranking all."""
    wanted = requested_roles(task)
    order = F.create_map(*(F.lit(x) for kv in ((s, n) for n, s in enumerate(wanted)) for x in kv)) if wanted else F.lit(None).cast("map<string,int>")
    laid = scored.select("path", "score", F.explode("signals").alias("signal")).filter(F.col("signal").isin(wanted) if wanted else F.lit(False))
    firsts = laid.groupBy("signal").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path"))
    return firsts.groupBy("path").agg(F.min_by("signal", F.try_element_at(order, F.col("signal"))).alias("signal")).select("signal", "path")


def pick_confidence(score: Column, fallback: bool) -> Column:
    base, most = (0.4, 0.8) if fallback else (0.5, 0.99)
    return F.least(F.lit(most), base + score / (2 * (score + 1)))


def text_search(lines: DataFrame, needle: str, per_file: int = 20, most: int = 100, width: int = 500) -> DataFrame:
    """(path, line, text) -> hits: per file the first per_file, in all the first `most` by path and line."""
    hits = lines.filter(F.contains("text", F.lit(needle)))
    n = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return hits.withColumn("n", n).filter(F.col("n") <= per_file).orderBy("path", "line").limit(most).select("path", "line", F.substring("text", 1, width).alias("snippet"))
