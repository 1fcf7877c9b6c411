"""Resolution of imports and calls across the files of a repository, and the links between tests and what they test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators.edges import module_names


def _bases(path: Column, level: Column, module: Column) -> Column:
    """The absolute modules that an import's own module may mean: itself at level 0, else under each dotted name of the
    importing file, less its own part (a package's __init__ has none) and one part a level over the first."""
    package = path.rlike(r"(^|/)__init__\.py$")
    tail = F.when(module.isNull(), F.array().cast("array<string>")).otherwise(F.split(module, r"\."))

    def under(name: Column) -> Column:
        parts = F.split(name, r"\.")
        keep = F.size(parts) - F.when(package, 0).otherwise(1) - (level - 1)
        return F.when(keep >= 0, F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)).cast("int")), tail), "."))

    relative = F.array_distinct(F.array_compact(F.transform(module_names(path), under)))
    return F.when(level == 0, F.array(F.coalesce(module, F.lit("")))).otherwise(relative)


def imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, n, level, module, name, ..) and (path) -> facts with resolution and target.

    Candidates are base.name and base for each base; one distinct file over all of them is internal, none of an absolute
    import external, anything else unresolved. A star or no name stands for the module alone.
    """
    modules = files.select(F.explode(module_names(F.col("path"))).alias("candidate"), F.col("path").alias("target")).distinct()
    named = F.col("name").isNotNull() & (F.col("name") != "*")
    bases = F.filter(_bases(F.col("path"), F.col("level"), F.col("module")), lambda b: b.isNotNull())
    longer = F.transform(bases, lambda b: F.when(b == "", F.col("name")).otherwise(F.concat(b, F.lit("."), F.col("name"))))
    candidates = F.array_distinct(F.when(named, F.concat(bases, longer)).otherwise(bases))
    laid = facts.select("path", "n", F.explode(candidates).alias("candidate"))
    found = laid.join(modules, "candidate").groupBy("path", "n").agg(F.count_distinct("target").alias("k"), F.min("target").alias("target"))
    label = F.when(F.col("k") == 1, "internal").when(F.col("k").isNull() & (F.col("level") == 0), "external").otherwise("unresolved")
    both = facts.join(found, ["path", "n"], "left")
    return both.select(*(both[c] for c in facts.columns), label.alias("resolution"), F.when(F.col("k") == 1, F.col("target")).alias("target"))


def imported_calls(calls: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbol, observed, shadowed, params array) of calls not resolved in their own file, resolved imports with the
    symbol they lie in (inside, null: the module), and (path, symbol, name, parent) -> calls with target_path, target_symbol.

    An imported name, or its alias, stands for itself; a module's alias for one name behind it; a module for one name behind
    its whole dotted name. The name must be one top-level symbol of the file, and all imports that fit must mean the same.
    Shadowed names and parameters never resolve.
    """
    usable = resolved.filter("resolution = 'internal' and (name is not null or module is not null)")
    key = F.when(F.col("name").isNotNull(), F.concat(F.lit("n:"), F.coalesce("alias", "name"))).otherwise(F.concat(F.lit("m:"), F.coalesce("alias", "module")))
    bound = usable.select("path", key.alias("key"), F.col("name").alias("imported"), F.col("target").alias("target_path"), "inside")
    free = calls.filter(~F.col("shadowed") & ~F.array_contains("params", F.substring_index("observed", ".", 1)))
    behind = F.col("observed").contains(".")
    keys = F.array_compact(F.array(
        F.struct(F.concat(F.lit("n:"), F.col("observed")).alias("key"), F.lit(None).cast("string").alias("last")),
        F.when(behind, F.struct(F.concat(F.lit("m:"), F.regexp_extract("observed", r"^(.*)\.[^.]*$", 1)).alias("key"), F.substring_index("observed", ".", -1).alias("last"))),
    ))
    asked = free.select("path", "symbol", "observed", F.explode(keys).alias("x")).select("path", "symbol", "observed", "x.*")
    met = asked.join(bound, ["path", "key"]).filter(F.col("inside").isNull() | (F.col("inside") == F.col("symbol")))
    met = met.select("path", "symbol", "observed", "target_path", F.coalesce("imported", "last").alias("target_name"))
    # of each file's top-level names only those that one symbol has
    top = symbols.filter("parent is null").groupBy(F.col("path").alias("target_path"), F.col("name").alias("target_name")).agg(F.count("*").alias("k"), F.min("symbol").alias("target_symbol")).filter("k = 1").drop("k")
    one = met.join(top, ["target_path", "target_name"]).groupBy("path", "symbol", "observed").agg(F.count_distinct("target_path", "target_symbol").alias("k"), F.min("target_path").alias("target_path"), F.min("target_symbol").alias("target_symbol")).filter("k = 1").drop("k")
    both = calls.join(one, ["path", "symbol", "observed"], "left")
    return both.select(*(both[c] for c in calls.columns), "target_path", "target_symbol")


def is_test(path: Column) -> Column:
    """A folder tests, a name that begins with test_, or a stem that ends with _test."""
    name = F.substring_index(path, "/", -1)
    return F.array_contains(F.split(path, "/"), "tests") | name.startswith("test_") | F.regexp_replace(name, r"(.)\.[^.]*$", "$1").endswith("_test")


def test_links(files: DataFrame, resolved: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, status), resolved imports and resolved calls -> distinct edges (kind, source, target, method).

    A parsed test tests every parsed file that it imports without doubt, and the one file whose name its own carries
    (test_x.py and x_test.py: x.py), by import if both hold; the file is tested by it. A resolved call into a file that is no
    test is a reference, with the symbol.
    """
    known = files.select("path", "status", is_test(F.col("path")).alias("test"))
    tests = known.filter("test and status = 'parsed'").select(F.col("path").alias("source"))
    plain = known.filter("not test")
    parsed = plain.filter("status = 'parsed'").select(F.col("path").alias("target"))
    by_import = resolved.filter("resolution = 'internal'").select(F.col("path").alias("source"), "target").distinct().join(tests, "source", "left_semi").join(parsed, "target", "left_semi")
    name = F.substring_index("source", "/", -1)
    own = F.when(name.startswith("test_"), F.substring(name, F.lit(6), F.length(name))).when(name.endswith("_test.py"), F.regexp_replace(name, r"_test\.py$", ".py"))
    lone = plain.groupBy(F.substring_index("path", "/", -1).alias("own")).agg(F.count("*").alias("k"), F.min("path").alias("target")).filter("k = 1").select("own", "target")
    by_name = tests.withColumn("own", own).join(lone, "own").join(parsed, "target", "left_semi").select("source", "target")
    links = by_import.select("source", "target", F.lit(1).alias("rank")).union(by_name.select("source", "target", F.lit(2))).groupBy("source", "target").agg(F.min("rank").alias("rank"))
    method = F.when(F.col("rank") == 1, "python_unambiguous_test_import").otherwise("python_test_path_convention")
    forth = links.select(F.lit("tests").alias("kind"), "source", "target", method.alias("method"))
    back = links.select(F.lit("tested_by").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), method.alias("method"))
    called = calls.filter("target_path is not null").join(tests, F.col("path") == F.col("source"), "left_semi").filter(~is_test(F.col("target_path")))
    reference = called.select(F.lit("test_reference").alias("kind"), F.col("path").alias("source"), F.col("target_symbol").alias("target"), F.lit("python_resolved_test_call").alias("method"))
    return forth.union(back).union(reference).distinct()


# What the kinds of a file's own facts are called between files; exports and others have no name there.
EDGE_KINDS = {"import": "imports", "contains": "contains", "call": "calls-name", "test_reference": "references"}
VERIFIED = ("import", "contains")


def overview_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges (kind, source, target) of files and configuration keys (path, key) -> distinct (kind, source, target, verified).

    Kinds are mapped, and those without a name left out; imports also run backwards, tests lead from what they test, and a
    key leads to each file that consumes it.
    """
    names = F.create_map(*(F.lit(x) for kv in EDGE_KINDS.items() for x in kv))
    named = edges.select(F.try_element_at(names, F.col("kind")).alias("kind"), "source", "target", F.col("kind").isin(*VERIFIED).alias("verified")).filter("kind is not null")
    back = edges.filter("kind = 'import'").select(F.lit("imported-by"), F.col("target"), F.col("source"), F.lit(True))
    tests = edges.filter("kind = 'tests'").select(F.lit("source-test"), F.col("target"), F.col("source"), F.lit(False))
    shared = keys.select(F.lit("configuration-consumer"), F.col("key"), F.col("path"), F.lit(False))
    return named.union(back).union(tests).union(shared).distinct()
