"""Packages and prompts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions.paths import language
from loamwork.functions.text import fence


def fenced(text: Column, info: Column) -> Column:
    """A block whose fence no run of backticks inside can end."""
    mark = fence(text)
    return F.concat(mark, info, F.lit("\n"), text, F.when(text.endswith("\n") | (text == ""), F.lit("")).otherwise(F.lit("\n")), mark)


def file_sections(files: DataFrame) -> DataFrame:
    """(path, text) -> path, markdown: a heading and a fenced block; a package is its sections in path order, so that no
    task holds more than one."""
    info = F.lower(F.coalesce(language(F.col("path")), F.lit("text")))
    return files.select("path", F.concat(F.lit("## `"), "path", F.lit("`\n\n"), fenced(F.col("text"), info), F.lit("\n")).alias("markdown"))


def tree_lines(paths: DataFrame) -> DataFrame:
    """(path, parent, name, is_dir, key) -> path, line with its connector: the last of its siblings has its own."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("parent").orderBy(F.desc("key"))
    last = F.row_number().over(w) == 1
    depth = F.size(F.split("path", "/")) - 1
    return paths.select("path", F.concat(F.repeat(F.lit("|   "), depth), F.when(last, "`-- ").otherwise("|-- "), "name", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


#: Byte budgets of a prompt's categories, and of all.
BUDGETS = {"source": 1 << 20, "codemap": 256 << 10, "architecture": 128 << 10, "diff": 256 << 10, "instructions": 64 << 10}
TOTAL = 2 << 20
#: Order of a prompt's sections.
SECTIONS = ("task", "instructions", "selection", "architecture", "codemap", "source", "diff", "warnings")


def prompt_budgets(parts: DataFrame) -> DataFrame:
    """(prompt, category, text, pinned) -> prompt, category, n_bytes, fits: each category's bytes against its budget;
    pinned source may exceed its own. The category total stands for all of a prompt."""
    limit = F.create_map(*(F.lit(x) for kv in BUDGETS.items() for x in kv))
    each = parts.groupBy("prompt", "category").agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(F.when(F.col("pinned"), 0).otherwise(F.octet_length("text"))).cast("long").alias("free"))
    counted = F.when(F.col("category") == "source", F.col("free")).otherwise(F.col("n_bytes"))
    fits = F.coalesce(counted <= F.try_element_at(limit, F.col("category")), F.lit(True))
    whole = each.groupBy("prompt").agg(F.sum("n_bytes").cast("long").alias("n_bytes"))
    return each.select("prompt", "category", "n_bytes", fits.alias("fits")).union(whole.select("prompt", F.lit("total"), "n_bytes", F.col("n_bytes") <= TOTAL))


def prompt_order(parts: DataFrame) -> DataFrame:
    """Parts with section, the place of their category; a prompt is its parts by (section, path)."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category"))
    return parts.withColumn("section", place.cast("long"))


def suggestion(selected: DataFrame, warnings: DataFrame, form: str) -> DataFrame:
    """(rank, path, confidence) and (code, path or null, message) -> (part, at, line): a discovery result's lines in order of
    (part, at), as text, markdown or json. Text and markdown show equal warnings once, with how many they are; json each."""
    share = F.format_number("confidence", 2)
    if form == "json":
        files = F.to_json(F.struct("rank", "path", "confidence"))
        told = warnings.select(F.to_json(F.struct("code", "path", "message"), {"ignoreNullFields": "false"}).alias("line"))
    else:
        files = F.concat_ws("", F.col("rank").cast("string"), F.lit(". `" if form == "markdown" else ". "), "path", F.lit("` (" if form == "markdown" else " ("), share, F.lit(")"))
        groups = warnings.groupBy("code", "message").agg(F.count("*").alias("n"))
        told = groups.select(F.concat_ws("", F.lit("- **" if form == "markdown" else "- "), "code", F.lit("**: " if form == "markdown" else ": "), "message", F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n").cast("string"))).otherwise("")).alias("line"))
    return selected.select(F.lit(1).alias("part"), F.lpad(F.col("rank").cast("string"), 12, "0").alias("at"), files.alias("line")).union(told.select(F.lit(2), F.col("line"), "line"))


def inspection(sections: DataFrame, most: int = 20) -> DataFrame:
    """Package sections (path, n_bytes, ranged) -> (at, line): its totals, and its `most` largest files. Offline: nothing but the
    package is read."""
    total = sections.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b"), F.count_if("ranged").alias("r"))
    lines = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("at"), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")).alias("line")) for k, (name, c) in enumerate((("files", "n"), ("bytes", "b"), ("ranged", "r")))))).alias("x")).select("x.at", "x.line")
    top = sections.orderBy(F.desc("n_bytes"), "path").limit(most)
    at = F.row_number().over(Window.orderBy(F.desc("n_bytes"), "path")) + 9  # `most` rows
    return lines.union(top.select(at.alias("at"), F.concat("path", F.lit(" "), F.col("n_bytes").cast("string"))))
