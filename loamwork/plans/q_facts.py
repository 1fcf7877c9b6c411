"""Queries over the facts of a repository: imports, calls, test links, overview edges and the completeness review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import resolve, review
from loamwork.operators.cut import cut
from loamwork.plans.facts import RESOLVED_SQL, facts
from loamwork.plans.registry import query

R = f"WITH {RESOLVED_SQL}"


def resolved(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The facts with resolved imports, calls and test links."""
    f = facts(spark, d)
    f["resolved"] = cut(resolve.imports(f["imports"], f["code"]))
    f["called"] = cut(resolve.imported_calls(f["calls"], f["resolved"], f["symbols"]))
    return f


@query("file_imports", "JOIN-10", f"{R} SELECT path, n, resolution, target FROM resolved")
def file_imports(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return resolve.imports(f["imports"], f["code"]).select("path", "n", "resolution", "target")


@query("imported_calls", "JOIN-11", f"{R} SELECT * FROM rcalls")
def imported_calls(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)["called"].select("path", "symbol", "observed", "target_path", "target_symbol")


@query("test_links", "JOIN-15", f"{R} SELECT * FROM links")
def test_links(spark: SparkSession, d: str) -> DataFrame:
    f = resolved(spark, d)
    return resolve.test_links(f["code"], f["resolved"], f["called"])


def _edges(f: dict[str, DataFrame]) -> DataFrame:
    """Facts as edges of a file's own: (kind, source, target)."""
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
    out = row(f["resolved"].filter("resolution = 'internal'"), "import", "path", "target").union(row(f["symbols"].filter("parent is not null"), "contains", "parent", "symbol"))
    out = out.union(row(f["called"].filter("target_symbol is not null"), "call", "symbol", "target_symbol"))
    return out.union(resolve.test_links(f["code"], f["resolved"], f["called"]).select("kind", "source", "target")).distinct()


@query("overview_edges", "FLT-22,JOIN-22", f"""{R}, raw AS (SELECT 'import' AS kind, path AS source, target FROM resolved WHERE resolution = 'internal' UNION SELECT 'contains', parent, symbol FROM symbols WHERE parent IS NOT NULL
  UNION SELECT 'call', symbol, target_symbol FROM rcalls WHERE target_symbol IS NOT NULL UNION SELECT kind, source, target FROM links),
named AS (SELECT CASE kind WHEN 'import' THEN 'imports' WHEN 'call' THEN 'calls-name' WHEN 'test_reference' THEN 'references' ELSE kind END AS kind, source, target, kind IN ('import', 'contains') AS verified FROM raw WHERE kind NOT IN ('tests', 'tested_by'))
SELECT * FROM named UNION SELECT 'imported-by', target, source, true FROM named WHERE kind = 'imports' UNION SELECT 'source-test', target, source, false FROM raw WHERE kind = 'tests'
UNION SELECT 'configuration-consumer', key, path, false FROM keys""")
def overview_edges(spark: SparkSession, d: str) -> DataFrame:
    f = resolved(spark, d)
    return resolve.overview_edges(_edges(f), f["keys"])


_SEL = "sel AS (SELECT path FROM code WHERE i % 5 < 2 OR i % 6 = 4)"
_OMIT = """SELECT '{code}' AS code, path, string_agg(related, ',' ORDER BY related) AS related, 0.6::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY related) AS k FROM (SELECT DISTINCT {a} AS path, {b} AS related FROM {src})
  WHERE path IN (SELECT path FROM sel) AND related NOT IN (SELECT path FROM sel) AND path <> related) WHERE k <= 50 GROUP BY path"""


def selection(f: dict[str, DataFrame]) -> DataFrame:
    return f["code"].filter("i % 5 < 2 or i % 6 = 4").select("path").distinct()


def _omitted(name: str, code: str, ids: str, src: str, a: str, b: str, rows):
    @query(name, ids, f"{R}, {_SEL} " + _OMIT.format(code=code, src=src, a=a, b=b))
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = resolved(spark, d)
        return review.neighbours(selection(f), rows(f), code)

    return run


_omitted("omitted_imports", "direct-import-omitted", "JOIN-20,SET-02", "resolved WHERE resolution = 'internal'", "path", "target", lambda f: f["resolved"].select(F.col("path").alias("source"), "target"))
_omitted("omitted_importers", "direct-importer-omitted", "JOIN-20,SET-02", "resolved WHERE resolution = 'internal'", "target", "path", lambda f: f["resolved"].select(F.col("target").alias("source"), F.col("path").alias("target")).filter("source is not null"))
_omitted("omitted_callers", "caller-omitted", "JOIN-20", "rcalls WHERE target_path IS NOT NULL", "target_path", "path", lambda f: f["called"].filter("target_path is not null").select(F.col("target_path").alias("source"), F.col("path").alias("target")))
_omitted("omitted_entry_points", "public-entry-point-omitted", "JOIN-20", "(SELECT c.path AS handler, o.path AS entry FROM code c JOIN code o ON o.i = c.i + 2 WHERE c.i % 5 = 0)", "handler", "entry", lambda f: f["code"].filter("i % 5 = 0").select(F.col("path").alias("source"), (F.col("i") + 2).alias("i")).join(f["code"].select("i", F.col("path").alias("target")), "i").select("source", "target"))

_LOOKS = r"(regexp_matches(lower(related), '^tests?/') OR regexp_matches(lower(related), '(^|/)test_[^/]*$') OR regexp_matches(lower(related), '(_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts)$'))"


@query("omitted_tests", "JOIN-20", f"{R}, {_SEL}, near AS (SELECT source AS path, target AS related FROM links WHERE kind IN ('tests', 'tested_by')) " + _OMIT.format(code="related-test-omitted", src=f"near WHERE {_LOOKS}", a="path", b="related"))
def omitted_tests(spark: SparkSession, d: str) -> DataFrame:
    f = resolved(spark, d)
    both = resolve.test_links(f["code"], f["resolved"], f["called"]).filter("kind in ('tests', 'tested_by')")
    return review.neighbours(selection(f), both.filter(review.looks_like_test(F.col("target"))), "related-test-omitted")


@query("omitted_consumers", "JOIN-20,JOIN-21", f"{R}, {_SEL}, near AS (SELECT DISTINCT a.path, b.path AS related FROM keys a JOIN keys b ON a.key = b.key AND a.path <> b.path) " + _OMIT.format(code="configuration-consumer-omitted", src="near", a="path", b="related"))
def omitted_consumers(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return review.consumers(selection(f), f["keys"])


@query("review_states", "JOIN-20,AGG-27", f"""{R}, {_SEL}, un AS (SELECT path, count(*) AS n FROM rcalls WHERE target_symbol IS NULL GROUP BY path), x AS (SELECT s.path, c.status, coalesce(un.n, 0) AS n, CASE WHEN c.i % 4 = 0 THEN 0.5::DOUBLE - (c.i % 5) / 10.0::DOUBLE END AS unsure FROM sel s JOIN code c USING (path) LEFT JOIN un USING (path))
SELECT 'structural-record-unavailable' AS code, path, '' AS related, 0.2::DOUBLE AS confidence FROM x WHERE status IS NULL UNION ALL SELECT 'incomplete-parse-data', path, '', 0.2 FROM x WHERE status <> 'parsed'
UNION ALL SELECT 'dynamic-or-unresolved-calls', path, '', 0.35 FROM x WHERE status IS NOT NULL AND n > 0 UNION ALL SELECT 'semantic-uncertainty', path, '', round(least(unsure, 0.4), 6) FROM x WHERE status IS NOT NULL AND unsure IS NOT NULL""")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    f = resolved(spark, d)
    open_ = f["called"].filter("target_symbol is null").groupBy("path").agg(F.count("*").alias("n"))
    i = F.col("i")
    unsure = f["code"].filter("i % 4 = 0").select("path", F.explode(F.array(F.lit(0.4), F.lit(0.5) - (i % 5) / F.lit(10.0))).alias("confidence"))
    out = review.states(selection(f), f["code"].filter("status is not null").select("path", "status"), open_, unsure)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("review_overall", "JOIN-20", f"""{R}, {_SEL}, touched AS (SELECT path FROM code WHERE i % 10 = 4), stale AS (SELECT path FROM code WHERE i % 11 = 3),
first50 AS (SELECT 'diff-file-omitted' AS code, path, 0.6 AS c FROM (SELECT DISTINCT path FROM touched WHERE path NOT IN (SELECT path FROM sel) ORDER BY path LIMIT 50) UNION ALL SELECT 'stale-index-coverage', path, 0.3 FROM (SELECT DISTINCT path FROM stale ORDER BY path LIMIT 50))
SELECT code, CAST(NULL AS VARCHAR) AS path, string_agg(path, ',' ORDER BY path) AS related, max(c)::DOUBLE AS confidence FROM first50 GROUP BY code
UNION ALL SELECT 'structural-coverage-limitations', NULL, '', 0.35 WHERE (SELECT count(*) FROM code WHERE status = 'partial') > 0 UNION ALL SELECT 'indexed-source-not-read', NULL, '', 0.1
UNION ALL SELECT 'documentation-not-selected', NULL, '', 0.5 WHERE (SELECT count(*) FROM sel WHERE path IN (SELECT path FROM touched) AND ends_with(path, '.py')) > 0 AND (SELECT count(*) FROM sel WHERE regexp_matches(lower(path), '\\.(md|rst)$|^docs/')) = 0""")
def review_overall(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d)["code"]
    return review.overall(selection({"code": c}), c.filter("i % 10 = 4").select("path"), c.filter("i % 11 = 3").select("path"), c.filter("status = 'partial'"), source_was_read=False)
