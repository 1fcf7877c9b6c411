"""From a source tree and a task to a bounded package, without a model: scan, facts, ranking, selection, review, prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import paths
from loamwork.functions.text import ranking_tokens
from loamwork.operators import budget, edges, extract, rank, render, review
from loamwork.operators.select import selector
from loamwork.sources import repository


@dataclass(frozen=True)
class Limits:
    files: int = 100
    source_bytes: int = 2 << 20
    file_bytes: int = 1_000_000


@dataclass(frozen=True)
class Handoff:
    """Lazy relations of one discovery; what several of them use is persisted until released."""

    scan: dict[str, DataFrame]
    facts: DataFrame
    ranked: DataFrame
    selected: DataFrame
    warnings: DataFrame
    sections: DataFrame

    def release(self) -> None:
        for df in (self.scan["files"], self.facts, self.ranked, self.selected):
            df.unpersist()


def symbol_tokens(facts: DataFrame) -> DataFrame:
    """(path, symbols): the ranking tokens of a file's classes and functions."""
    named = facts.filter(F.col("kind").isin("class", "function", "method"))
    return named.select("path", F.explode(ranking_tokens(F.concat_ws(" ", "name", "qualified_name", "detail"))).alias("t")).groupBy("path").agg(F.collect_set("t").alias("symbols"))


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, source, target) of imports that resolve to one file: by the whole name, else by the module it comes from."""
    modules = files.select("path", F.explode(edges.module_names(F.col("path"))).alias("module"))
    whole = F.col("name")
    imports = facts.filter("kind = 'import'").select(F.concat_ws("\t", "path", whole).alias("id"), F.lit(0).alias("level"), F.explode(F.array_distinct(F.array(whole, F.regexp_replace(whole, r"\.[^.]+$", "")))).alias("module"))
    got = edges.resolve_imports(imports, modules).filter("resolution = 'internal'")
    return got.select(F.lit("import").alias("kind"), F.split("id", "\t")[0].alias("source"), F.col("target")).filter("source <> target").distinct()


def overview(files: DataFrame, facts: DataFrame) -> DataFrame:
    """A row a package: files, tests, symbols and entry points, the deterministic form of an architecture map."""
    n = facts.filter(F.col("kind").isin("class", "function", "method")).groupBy("path").agg(F.count("*").alias("n_symbols"))
    stem = F.substring_index(paths.file_name(F.col("path")), ".", 1)
    f = files.join(n, "path", "left").select("path", paths.package_key(F.col("path")).alias("package"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), paths.is_test_any(F.col("path")).alias("test"), stem.isin("main", "app", "server", "__main__").alias("entry"))
    return f.groupBy("package").agg(F.count("*").alias("n_files"), F.count_if("test").alias("n_tests"), F.sum("n_symbols").alias("n_symbols"), F.count_if("entry").alias("n_entry_points"))


def discover(spark: SparkSession, root: str, task: str, pins: tuple[str, ...] = (), excludes: tuple[tuple[str, str], ...] = (), limits: Limits = Limits()) -> Handoff:
    """The deterministic path: facet firsts, then rank order within the limits; larger files are passed over, pins are not."""
    scan = repository.scan(spark, root, limits.file_bytes)
    files = scan["files"] = scan["files"].persist()
    texts = repository.verified_texts(root, files.select("path", "sha256"))
    facts = extract.extract(texts).persist()
    stem = F.substring_index(paths.file_name(F.col("path")), ".", 1)
    live = files
    for kind, value in excludes:
        live = live.filter(~selector(kind, value, F.col("path")))
    none = F.array().cast("array<string>")
    known = live.join(symbol_tokens(facts), "path", "left").select(
        "path", "size_bytes", F.coalesce("symbols", none).alias("symbols"), none.alias("summary"), F.lit(False).alias("semantic"),
        stem.isin("main", "app", "server", "__main__").alias("entry"), F.lit(False).alias("direct_test"), F.col("path").isin(*pins).alias("pinned"),
    ).persist()
    scored = rank.score(known, task, rank.FACET_COLUMNS)
    ranked = rank.rank(scored.select("path", "score", "signals")).persist()
    found = rank.facets(task)
    chosen = rank.preselect(rank.in_facets(scored, found), found, limits.files)
    order = ranked.join(chosen, "path").join(known.select("path", "size_bytes", "pinned"), "path").select("path", "rank", "size_bytes", "pinned", (~F.col("pinned")).cast("int").alias("after"), F.lit(0).alias("all"))
    selected = budget.greedy(order, ["all"], ["after", "rank"], "size_bytes", limits.source_bytes, "pinned").filter("taken").select("path", "rank", "size_bytes").persist()
    near = import_edges(facts, files)
    mine = selected.select("path")
    warnings = review.neighbours(mine, near, "direct-import-omitted").union(review.neighbours(mine, near, "direct-importer-omitted", "target", "source"))
    return Handoff(scan, facts, ranked, selected, warnings, render.file_sections(texts.join(selected.select("path"), "path", "left_semi")))


def gate(n_selected: int, n_warnings: int, reviewed: bool) -> str:
    """What to do with a selection: correct an empty one, review the first warnings once, else it is final."""
    if not n_selected:
        return "correct"
    return "review" if n_warnings and not reviewed else "final"
