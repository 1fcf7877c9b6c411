"""Selection of files: globs, selectors, ignore rules, line ranges."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _class(pattern: str, i: int, negation: str = "!^") -> tuple[str, int] | None:
    """The regex of a bracket expression that begins at i, and where it ends; None if it is not closed.

    A range that runs backwards holds nothing. What a slash may match is up to the caller.
    """
    at = i + 1
    negated = pattern[at : at + 1] in negation and at < len(pattern)
    at += negated
    end = pattern.find("]", at + 1 if pattern[at : at + 1] == "]" else at)
    if end < 0:
        return None
    body, items, k = pattern[at:end], "", 0
    one = lambda c: c if c.isalnum() else f"\\{c}"
    while k < len(body):
        low, high = (body[k], body[k + 2]) if body[k + 1 : k + 2] == "-" and k + 2 < len(body) else (body[k], body[k])
        if low <= high:
            items += one(low) + (f"-{one(high)}" if high > low else "")
        k += 3 if body[k + 1 : k + 2] == "-" and k + 2 < len(body) else 1
    if not items:
        return ("[\\s\\S]" if negated else "(?!)"), end + 1
    return f"[{'^' if negated else ''}{items}]", end + 1


def glob_regex(pattern: str) -> str:
    """A git-style glob as an anchored regex over whole paths.

    Without a slash but at its end it matches a name at any depth, and with it what lies below; ** crosses directories,
    * and ? do not.
    """
    if not pattern or pattern.startswith(("/", "!")) or ".." in pattern.split("/"):
        raise ValueError(f"not a relative glob: {pattern!r}")
    return _gitwild(pattern)


def _gitwild(pattern: str) -> str:
    anchored = "/" in pattern.rstrip("/") or pattern.startswith("/")
    only_below = pattern.endswith("/")
    parts = pattern.strip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                while part[i + 1 : i + 2] == "*":
                    i += 1
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (got := _class(part, i)):
                out += f"(?!/){got[0]}"
                i = got[1] - 1
            elif c == "\\" and i + 1 < len(part):
                i += 1
                out += re.escape(part[i])
            else:
                out += re.escape(c)
            i += 1
        out += "" if last else "/"
    return f"^{out}{'/.*' if only_below else '' if parts[-1] == '**' else '(?:/.*)?'}$"


def fnmatch_regex(pattern: str) -> str:
    """A shell pattern in which * and ? cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (got := _class(pattern, i, "!")):
            out, i = out + got[0], got[1]
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def selector(kind: str, value: str, path: Column) -> Column:
    """Whether a path matches a selector of kind exact_path, directory, glob or exclusion (a directory, path or glob)."""
    if kind == "exact_path":
        return path == value
    if kind == "directory":
        return F.lit(True) if value == "." else path.startswith(value.rstrip("/") + "/")
    if kind == "glob":
        return path.rlike(glob_regex(value))
    if kind == "exclusion":
        return (path == value) | path.startswith(value.rstrip("/") + "/") | path.rlike(glob_regex(value))
    raise ValueError(f"unknown selector kind {kind!r}")


def selector_matches(files: DataFrame, selectors: list[tuple[str, str]]) -> DataFrame:
    """(ordinal, path) of every match; one scan of files, whatever the number of selectors."""
    hits = F.array_compact(F.array(*(F.when(selector(k, v, F.col("path")), F.lit(i).cast("long")) for i, (k, v) in enumerate(selectors))))
    return files.select(F.explode(hits).alias("ordinal"), "path")


def select_files(files: DataFrame, includes: list[tuple[str, str]], excludes: list[tuple[str, str]]) -> DataFrame:
    """Files that an include matches and no exclude."""
    path = F.col("path")
    return files.filter(reduce(Column.__or__, (selector(k, v, path) for k, v in includes))).filter(~reduce(Column.__or__, (selector(k, v, path) for k, v in excludes), F.lit(False)))


def unmatched(files: DataFrame, selectors: list[tuple[str, str]]) -> DataFrame:
    """Selectors without a file."""
    spark = files.sparkSession
    named = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(selectors)], "ordinal long, kind string, value string")
    return named.join(selector_matches(files, selectors).select("ordinal").distinct(), "ordinal", "left_anti")


def ignore_rules(scopes: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, str, bool, bool]]:
    """Scopes (base directory, source, patterns) in order -> rules (source, pattern, regex of whole paths, negated, directories only).

    A rule with base b matches paths below b. Blank lines and comments are none.
    """
    out = []
    for base, source, patterns in scopes:
        for raw in patterns:
            line = raw.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            body = line[1:] if negated else line.removeprefix("\\")
            directories = body.endswith("/")
            regex = _gitwild(body.rstrip("/"))
            own = regex if not base else f"^{re.escape(base)}/{regex[1:]}"
            out.append((source, line, own.replace("(?:/.*)?$", "$") if regex.endswith("(?:/.*)?$") else own, negated, directories))
    return out


def ignored(paths: DataFrame, rules: list[tuple[str, str, str, bool, bool]], protected: tuple[str, ...] = ()) -> DataFrame:
    """path -> (path, source, pattern, at): what ignores a file, the outermost ancestor or itself; null if nothing.

    Protected names come first, in any part and any case. Then, from the outermost directory inwards, the last rule that
    matches a level decides it; an ignored directory ends the search, since what lies in it is never seen.
    """
    path = F.col("path")
    parts = F.split(path, "/")
    guard = [p.rstrip("/").lower() for p in protected]
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("at"), (i < F.size(parts)).alias("dir")))

    def verdict(x: Column) -> Column:
        out = F.lit(None).cast("struct<source:string,pattern:string,at:string>")
        for source, pattern, regex, negated, directories in rules:  # later rules win
            hit = x["at"].rlike(regex) & (x["dir"] if directories else F.lit(True))
            told = F.lit(None).cast("struct<source:string,pattern:string,at:string>") if negated else F.struct(F.lit(source).alias("source"), F.lit(pattern).alias("pattern"), x["at"].alias("at"))
            out = F.when(hit, told).otherwise(out)
        return out

    first = F.try_element_at(F.array_compact(F.transform(levels, verdict)), F.lit(1))
    guarded = F.filter(F.transform(parts, F.lower), lambda p: p.isin(*guard)) if guard else F.array().cast("array<string>")
    found = F.when(F.size(guarded) > 0, F.struct(F.lit("protected").alias("source"), F.concat(guarded[0], F.lit("/")).alias("pattern"), F.lit(None).cast("string").alias("at"))).otherwise(first)
    return paths.select("path", found.alias("_m")).select("path", "_m.source", "_m.pattern", "_m.at")


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop) -> the same with duplicate, nested, overlapping and adjacent ranges as one."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.distinct().withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(w))
    return island.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_i")


def overlaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that begin before, or right behind, the end of the one before them."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    return ranges.withColumn("before", F.lag("stop").over(w)).filter("start <= before + 1")


def slice_lines(text: Column, start: Column, stop: Column) -> Column:
    """Lines start to stop, 1-based, each with its line feed but an unfinished last one; null if stop lies beyond the end."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines) - F.when(text.endswith("\n"), 1).otherwise(0)
    cut = F.array_join(F.slice(lines, start, stop - start + 1), "\n")
    return F.when((stop <= n) & (text != ""), F.concat(cut, F.when((stop < n) | text.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))))
