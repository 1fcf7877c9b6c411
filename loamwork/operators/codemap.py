"""Bounded views of what is known of a file, records of it, claims about it, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Symbols and relationships that a projection shows, and code points of a signature.
SYMBOLS, RELATIONSHIPS, SIGNATURE = 24, 32, 160
#: Symbols, imports and exports of a compact view at the first try; every retry halves them.
COMPACT = (100, 50, 50)


def first_rows(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key; every task cuts its own before they meet."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def _listed(df: DataFrame, value: Column, most: int, name: str) -> DataFrame:
    """(path, first `most` values joined by comma, how many there are)."""
    laid = df.select("path", value.alias("v")).distinct()
    first = first_rows(laid, "path", ["v"], most).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(name))
    return laid.groupBy("path").agg(F.count("*").alias(f"n_{name}")).join(first, "path")


def projection(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path), (path, symbol, signature), (path, kind, target) -> path, the first symbols with their signatures cut, the first
    relationships, counts by kind, and whether any of it is cut."""
    s = _listed(symbols, F.concat_ws("=", "symbol", F.substring("signature", 1, SIGNATURE)), SYMBOLS, "symbols")
    r = _listed(edges, F.concat_ws(":", "kind", "target"), RELATIONSHIPS, "relationships")
    kinds = edges.select("path", "kind", "target").distinct().groupBy("path", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("kinds"))
    long_ = symbols.groupBy("path").agg(F.bool_or(F.length("signature") > SIGNATURE).alias("long"))
    out = files.select("path").distinct().join(s, "path", "left").join(r, "path", "left").join(kinds, "path", "left").join(long_, "path", "left")
    cut = (F.coalesce("n_symbols", F.lit(0)) > SYMBOLS) | (F.coalesce("n_relationships", F.lit(0)) > RELATIONSHIPS) | F.coalesce("long", F.lit(False))
    return out.select("path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("symbols", "relationships", "kinds")), cut.alias("truncated"))


def compact(files: DataFrame, parts: dict[str, tuple[DataFrame, Column]], retry: int, caps: tuple[int, ...] = COMPACT) -> DataFrame:
    """path, the first values of each part under its cap halved `retry` times, and whether any part is cut."""
    out, cut = files.select("path").distinct(), F.lit(False)
    for (name, (df, value)), cap in zip(parts.items(), caps, strict=True):
        out = out.join(_listed(df, value, max(1, cap >> retry), name), "path", "left")
        cut = cut | (F.coalesce(f"n_{name}", F.lit(0)) > max(1, cap >> retry))
    return out.select("path", *(F.coalesce(n, F.lit("")).alias(n) for n in parts), cut.alias("truncated"))


def search_symbols(symbols: DataFrame, needle: str, kind: str | None = None, under: str = "") -> DataFrame:
    """(path, kind, name, symbol, signature): those that hold the needle in any letter case, of a kind, under a path."""
    said = F.lower(F.concat_ws(" ", "name", "symbol", "signature"))
    out = symbols.filter(F.contains(said, F.lit(needle.lower())) & F.col("path").startswith(under))
    return out if kind is None else out.filter(F.col("kind") == kind)


def search_index(records: DataFrame, needle: str, kinds: tuple[str, ...], mode: str = "indexed") -> DataFrame:
    """(kind, record JSON): the needle in any letter case within the serialised record; a fresh mode has no index."""
    if mode == "fresh":
        return records.limit(0)
    return records.filter(F.col("kind").isin(*kinds) & F.contains(F.lower("record"), F.lit(needle.lower())))


RECORD = "schema_version int, path string, status string, symbols array<struct<symbol: string, name: string>>"


def serialise(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, status), (path, symbol, name) -> path, record: canonical JSON, symbols in order, nulls written."""
    own = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("symbol", "name"))).alias("symbols"))
    none = F.array().cast("array<struct<symbol: string, name: string>>")
    both = files.select("path", "status").join(own, "path", "left")
    return both.select("path", F.to_json(F.struct(F.lit(1).alias("schema_version"), "path", "status", F.coalesce("symbols", none).alias("symbols")), {"ignoreNullFields": "false"}).alias("record"))


def deserialise(records: DataFrame) -> DataFrame:
    """path, record -> path, status, symbols, and valid: it is the canonical form of what it says, of this version, and no more."""
    x = records.withColumn("x", F.from_json("record", RECORD, {"mode": "PERMISSIVE"}))
    again = F.to_json(F.col("x"), {"ignoreNullFields": "false"})
    return x.select("path", "x.status", "x.symbols", F.coalesce((again == F.col("record")) & (F.col("x.schema_version") == 1) & (F.col("x.path") == F.col("path")), F.lit(False)).alias("valid"))


def review(found: DataFrame, reviewed: DataFrame, replaces: bool) -> DataFrame:
    """Discovered (path) and a reviewer's (path, action include or exclude) -> path, origin. A reviewer's includes join the
    discovered ones or replace them, exclusions win over both."""
    mine = reviewed.filter("action = 'include'").select("path", F.lit("manual").alias("origin"))
    out = mine if replaces else mine.union(found.select("path", F.lit("discovered")))
    kept = out.groupBy("path").agg(F.max("origin").alias("origin"))
    return kept.join(reviewed.filter("action = 'exclude'").select("path"), "path", "left_anti")


def review_priority(pinned: Column, manual: Column, test: Column, ranged: Column, selected: Column) -> Column:
    """0 pinned, 1 manual, 2 a whole file that is no test, 3 a ranged one, 4 a test, 5 any other."""
    return F.when(pinned, 0).when(manual, 1).when(test, 4).when(selected & ~ranged, 2).when(ranged, 3).otherwise(5)


def stamped(claims: DataFrame, files: DataFrame, analyzer: str, provider: str, model: str) -> DataFrame:
    """Claims (path, symbol or null, start, stop of the symbol, text, evidence array of lines) and (path, sha256) -> claims with
    their provenance. Evidence is sorted and distinct; a symbol's lies in its range, and a claim that keeps none is left out."""
    inside = F.filter("evidence", lambda x: F.col("symbol").isNull() | x.between(F.col("start"), F.col("stop")))
    kept = claims.withColumn("evidence", F.array_sort(F.array_distinct(inside))).filter(F.size("evidence") > 0)
    return kept.join(files.select("path", "sha256"), "path").select("path", "symbol", "text", "evidence", F.lit(analyzer).alias("analyzer"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("sha256").alias("source_sha256"))


def index_report(structural: DataFrame, semantic: DataFrame, maps: DataFrame, wants_maps: bool) -> DataFrame:
    """(path, status parsed, partial or failed), (path, status complete, partial or failed) and the maps built -> one row."""
    s = structural.agg(F.count("*").alias("n_files"), F.count_if(F.col("status") == "parsed").alias("n_parsed"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    t = semantic.agg(F.count("*").alias("n_semantic"), F.count_if(F.col("status") == "complete").alias("n_complete"))
    m = maps.agg(F.count("*").alias("n_maps"))
    one = s.crossJoin(t).crossJoin(m)  # a row each
    partial = (F.col("n_parsed") < F.col("n_files")) | (F.col("n_complete") < F.col("n_semantic")) | (F.lit(wants_maps) & (F.col("n_maps") == 0))
    return one.withColumn("partial", partial)


def universe(files: DataFrame, maps: DataFrame, analyses: DataFrame, excluded: DataFrame) -> DataFrame:
    """Paths known from any of three sources that are still text files and not excluded, and from how many."""
    known = files.select("path").distinct().union(maps.select("path").distinct()).union(analyses.select("path").distinct()).groupBy("path").agg(F.count("*").alias("n_sources"))
    return known.join(files.select("path"), "path", "left_semi").join(excluded.select("path"), "path", "left_anti")


def dependencies(selected: DataFrame, imports: DataFrame, candidates: DataFrame, allowance: int) -> DataFrame:
    """Candidates (path, rank, matches, code) not selected: first implementation files that selected ones import (tier 1), then
    those in a folder of theirs (tier 2), task matches alone, by tier and rank up to the allowance."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    live = candidates.filter("matches").join(selected.select("path"), "path", "left_anti")
    wanted = imports.filter("resolution = 'internal'").join(selected.select("path"), "path", "left_semi").select(F.col("target").alias("path")).distinct()
    one = live.filter("code").join(wanted, "path", "left_semi").select("path", "rank", F.lit(1).alias("tier"))
    near = live.withColumn("folder", folder(F.col("path"))).join(selected.select(folder(F.col("path")).alias("folder")).distinct(), "folder", "left_semi").select("path", "rank", F.lit(2).alias("tier"))
    best = one.union(near).groupBy("path", "rank").agg(F.min("tier").alias("tier"))
    return best.orderBy("tier", "rank", "path").limit(allowance)
