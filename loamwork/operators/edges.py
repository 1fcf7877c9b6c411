"""Modules, imports, calls and the edges between files and symbols. Every graph query is one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def module_names(path: Column) -> Column:
    """The dotted names of a Python file: without .py and __init__, and also without a leading src or lib."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    names = F.array(F.replace(bare, F.lit("/"), F.lit(".")), F.replace(F.regexp_replace(bare, "^(src|lib)/", ""), F.lit("/"), F.lit(".")))
    return F.when(path.endswith(".py"), F.array_distinct(F.filter(names, lambda n: n != ""))).otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, level, module) and (module, path) -> id, resolution, target.

    One distinct path is internal, none of an absolute import external, all else unresolved. A row of imports may stand
    for each candidate name of one import.
    """
    both = imports.join(modules.distinct(), "module", "left").groupBy("id", "level").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    label = F.when(F.col("n") == 1, "internal").when((F.col("n") == 0) & (F.col("level") == 0), "external").otherwise("unresolved")
    return both.select("id", label.alias("resolution"), F.when(F.col("n") == 1, F.col("path")).alias("target"))


def resolve_calls(calls: DataFrame, scopes: list[str]) -> DataFrame:
    """(id, shadowed, scope, target): the first of the scopes that has targets decides, if it has just one; shadowed
    names never resolve -> id, target, scope."""
    counts = calls.groupBy("id").agg(
        F.bool_or("shadowed").alias("shadowed"), *(F.count_distinct(F.when(F.col("scope") == s, F.col("target"))).alias(f"n_{s}") for s in scopes), *(F.min(F.when(F.col("scope") == s, F.col("target"))).alias(f"t_{s}") for s in scopes)
    )
    level = F.lit(None).cast("string")
    for s in reversed(scopes):
        level = F.when(F.col(f"n_{s}") > 0, s).otherwise(level)
    target = F.lit(None).cast("string")
    for s in scopes:
        target = F.when((level == s) & (F.col(f"n_{s}") == 1) & ~F.col("shadowed"), F.col(f"t_{s}")).otherwise(target)
    return counts.select("id", target.alias("target"), F.when(target.isNotNull(), level).alias("scope"))


def containing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, id, line) and (path, symbol, start, stop) -> id, symbol: the innermost range that holds the line, which is
    that of the latest start, the shortest of those.

    Each line of a file has one innermost range, found once however many points lie on it: ranges nest, so that their lines
    are as many as the file's, times the depth. Points then meet lines by equality, never all ranges of their file.
    """
    lines = symbols.filter("start <= stop").withColumn("line", F.explode(F.sequence("start", "stop")))
    inner = lines.groupBy("path", "line").agg(F.max_by("symbol", F.struct("start", -F.col("stop"), "symbol")).alias("symbol"))
    return points.join(inner, ["path", "line"], "left").select("id", "symbol")


def rebuild(*parts: DataFrame) -> DataFrame:
    """Edge relations (kind, source, target) as one, an id a distinct edge."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, parts).distinct()
    return all_.withColumn("id", F.sha2(F.concat_ws("|", "kind", "source", "target"), 256))


INVERSE = {"import": "imported-by", "contains": "contained-in", "call": "called-by", "tests": "tested-by"}


def with_inverse(edges: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))
    return edges.select("kind", "source", "target").union(edges.select(F.try_element_at(names, F.col("kind")), "target", "source").filter(F.col(edges.columns[0]).isNotNull())).distinct()


def sharing(keys: DataFrame) -> DataFrame:
    """(path, key) -> distinct (path, n): how many other paths share a key with it.

    Counted a key by its size, not by pairs: of paths with one key each, a key of n paths gives each n - 1 others.
    """
    sizes = keys.distinct().groupBy("key").agg((F.count("*") - 1).alias("n"))
    return keys.distinct().join(sizes, "key").groupBy("path").agg(F.sum("n").alias("n"))
