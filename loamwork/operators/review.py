"""Advice on what a selection of files may lack. Nothing here claims that the edges are all there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Related paths that a warning names at most.
MOST = 50
# How sure each code is.
CONFIDENCE = {
    "structural-record-unavailable": 0.2, "incomplete-parse-data": 0.2, "dynamic-or-unresolved-calls": 0.35, "documentation-not-selected": 0.5,
    "stale-index-coverage": 0.3, "structural-coverage-limitations": 0.35, "indexed-source-not-read": 0.1,
}
RELATED = 0.6


def looks_like_test(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"^tests?/") | F.substring_index(low, "/", -1).rlike(r"^test_|(_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts)$")


def _first(near: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """The first `most` related paths of each key; each part of the input keeps no more before parts meet."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("related"))
    return near.distinct().withColumn("n", n).filter(F.col("n") <= most).drop("n")


def _warned(near: DataFrame, code: str) -> DataFrame:
    """(path, related) -> a warning a path, its first related paths joined by comma."""
    listed = _first(near, ["path"]).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("related")), ",").alias("related"))
    return listed.select(F.lit(code).alias("code"), "path", "related", F.lit(RELATED).alias("confidence"))


def neighbours(selected: DataFrame, edges: DataFrame, code: str, source: str = "source", target: str = "target") -> DataFrame:
    """Of each selected path the neighbours along (source, target) that are not selected."""
    near = edges.select(F.col(source).alias("path"), F.col(target).alias("related")).filter("related is not null and path <> related").join(selected, "path", "left_semi")
    return _warned(near.join(selected.select(F.col("path").alias("related")), "related", "left_anti"), code)


def consumers(selected: DataFrame, keys: DataFrame, code: str = "configuration-consumer-omitted") -> DataFrame:
    """(path, key): of each selected path the unselected files with a key of its own. A key gives its first MOST files alone,
    which is all that the first MOST of any union can take from it: no pairs of a key that very many files share."""
    others = keys.select("key", F.col("path").alias("related")).join(selected.select(F.col("path").alias("related")), "related", "left_anti")
    mine = keys.select("path", "key").distinct().join(selected, "path", "left_semi")
    return _warned(mine.join(_first(others, ["key"]), "key").select("path", "related"), code)


def states(selected: DataFrame, maps: DataFrame, unresolved: DataFrame, uncertainty: DataFrame) -> DataFrame:
    """Selected paths without a structural record; of the others those not parsed, with unresolved calls, or with an
    uncertain analysis. maps (path, status), unresolved (path, n), uncertainty (path, confidence), the latter several a path."""
    known = selected.join(maps, "path", "left").join(unresolved, "path", "left").join(uncertainty.groupBy("path").agg(F.min("confidence").alias("unsure")), "path", "left")
    has = F.col("status").isNotNull()
    codes = F.array_compact(F.array(
        *(F.when(when, F.struct(F.lit(code).alias("code"), F.lit(CONFIDENCE[code]).alias("confidence"))) for code, when in (
            ("structural-record-unavailable", ~has), ("incomplete-parse-data", has & (F.col("status") != "parsed")), ("dynamic-or-unresolved-calls", has & (F.col("n") > 0)),
        )),
        F.when(has & F.col("unsure").isNotNull(), F.struct(F.lit("semantic-uncertainty").alias("code"), F.col("unsure").alias("confidence"))),
    ))
    return known.select("path", F.explode(codes).alias("x")).select("x.code", "path", F.lit("").alias("related"), "x.confidence")


def overall(selected: DataFrame, touched: DataFrame | None, stale: DataFrame, diagnostics: DataFrame, source_was_read: bool) -> DataFrame:
    """Warnings of the whole selection, path null. touched (path) by a diff or None; stale (path); diagnostics (any rows).

    Each is one row: what is gathered for it is an aggregate or the first MOST paths.
    """
    spark = selected.sparkSession
    one = lambda code, when: when.select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("path"), F.lit("").alias("related"), F.lit(CONFIDENCE[code]).alias("confidence"))
    listed = lambda df: df.select("path").distinct().orderBy("path").limit(MOST).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("related")).filter("related <> ''")
    every = listed(stale).select(F.lit("stale-index-coverage").alias("code"), F.lit(None).cast("string").alias("path"), "related", F.lit(CONFIDENCE["stale-index-coverage"]).alias("confidence"))
    every = every.union(one("structural-coverage-limitations", diagnostics.limit(1)))
    if not source_was_read:
        every = every.union(one("indexed-source-not-read", spark.range(1)))
    if touched is not None:
        left = listed(touched.join(selected, "path", "left_anti"))
        every = every.union(left.select(F.lit("diff-file-omitted").alias("code"), F.lit(None).cast("string").alias("path"), "related", F.lit(RELATED).alias("confidence")))
        docs = F.lower("path").rlike(r"\.(md|rst)$|^docs/")
        code = F.col("path").endswith(".py") | F.col("path").endswith(".pyi")
        marked = selected.join(touched.select("path", F.lit(True).alias("hit")).distinct(), "path", "left")
        asked = marked.agg(F.coalesce(F.bool_or(F.coalesce("hit", F.lit(False)) & code), F.lit(False)).alias("changed"), F.coalesce(F.bool_or(docs), F.lit(False)).alias("told"))
        every = every.union(one("documentation-not-selected", asked.filter("changed and not told")))
    return every
