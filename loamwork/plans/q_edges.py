"""Queries over modules, imports, calls, edges and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions import paths
from loamwork.operators import edges, metrics
from loamwork.plans.binding import EDGES_SQL, FILES_SQL, files, table
from loamwork.plans.binding import edges as edge_table
from loamwork.plans.registry import duck_language, query

E = f"WITH {EDGES_SQL} "
_KEY = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))


@query("module_index", "JOIN-09", f"""WITH {FILES_SQL}, p AS (SELECT path, regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', '') AS b FROM files WHERE ends_with(path, '.py')),
m AS (SELECT path, unnest(list_distinct([replace(b, '/', '.'), replace(regexp_replace(b, '^(src|lib)/', ''), '/', '.')])) AS module FROM p) SELECT module, count(DISTINCT path) AS n, min(path) AS path FROM m WHERE module <> '' GROUP BY module""")
def module_index(spark: SparkSession, d: str) -> DataFrame:
    m = files(spark, d).select("path", F.explode(edges.module_names(F.col("path"))).alias("module"))
    return m.groupBy("module").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))


@query("import_resolution", "JOIN-10", """WITH b AS (SELECT o_orderkey AS id, o_orderkey % 2 AS level, count(DISTINCT p_brand) AS n, min(p_brand) AS path FROM orders LEFT JOIN part ON 'm' || (o_custkey % 400)::VARCHAR = 'm' || (p_partkey % 997 + 100)::VARCHAR GROUP BY ALL)
SELECT id, CASE WHEN n = 1 THEN 'internal' WHEN n = 0 AND level = 0 THEN 'external' ELSE 'unresolved' END AS resolution, CASE WHEN n = 1 THEN path END AS target FROM b""")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("level"), F.concat(F.lit("m"), (F.col("o_custkey") % 400).cast("string")).alias("module"))
    m = table(spark, d, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 997 + 100).cast("string")).alias("module"), F.col("p_brand").alias("path"))
    return edges.resolve_imports(i, m)


_SCOPES = ["contained", "sibling", "module"]


@query("local_call_priority", "JOIN-12", """WITH c AS (SELECT l_orderkey AS id, l_tax > 0.07 AS shadowed, CASE WHEN l_quantity < 4 THEN 'contained' WHEN l_quantity < 10 THEN 'sibling' WHEN l_quantity < 20 THEN 'module' ELSE 'other' END AS scope, 's' || (l_suppkey % 10)::VARCHAR AS target FROM lineitem),
g AS (SELECT id, bool_or(shadowed) AS sh, count(DISTINCT target) FILTER (scope = 'contained') AS a, count(DISTINCT target) FILTER (scope = 'sibling') AS b, count(DISTINCT target) FILTER (scope = 'module') AS c,
  min(target) FILTER (scope = 'contained') AS ta, min(target) FILTER (scope = 'sibling') AS tb, min(target) FILTER (scope = 'module') AS tc FROM c GROUP BY id),
r AS (SELECT id, CASE WHEN sh THEN NULL WHEN a > 0 THEN CASE WHEN a = 1 THEN ta END WHEN b > 0 THEN CASE WHEN b = 1 THEN tb END WHEN c = 1 THEN tc END AS target, CASE WHEN a > 0 THEN 'contained' WHEN b > 0 THEN 'sibling' WHEN c > 0 THEN 'module' END AS scope FROM g)
SELECT id, target, CASE WHEN target IS NOT NULL THEN scope END AS scope FROM r""")
def local_call_priority(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    scope = F.when(q < 4, "contained").when(q < 10, "sibling").when(q < 20, "module").otherwise("other")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_tax") > 0.07).alias("shadowed"), scope.alias("scope"), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("target"))
    return edges.resolve_calls(c, _SCOPES)


@query("containing_symbol", "JOIN-13", """WITH s AS (SELECT DISTINCT 'u' || user_id::VARCHAR AS path, event_id % 40 AS start, event_id % 40 + event_id % 9 AS stop, event_id % 997 AS symbol FROM events),
p AS (SELECT 'u' || user_id::VARCHAR AS path, event_id AS id, floor(value)::BIGINT % 50 AS line FROM events),
i AS (SELECT p.id, s.symbol, row_number() OVER (PARTITION BY p.id ORDER BY s.start DESC, s.stop, s.symbol DESC) AS n FROM p JOIN s ON p.path = s.path AND p.line BETWEEN s.start AND s.stop) SELECT p.id, i.symbol FROM p LEFT JOIN i ON p.id = i.id AND n = 1""")
def containing_symbol(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i, path = F.col("event_id"), _KEY("u", "user_id").alias("path")
    s = e.select(path, (i % 40).alias("start"), (i % 40 + i % 9).alias("stop"), (i % 997).alias("symbol")).distinct()
    p = e.select(path, i.alias("id"), (F.floor("value").cast("long") % 50).alias("line"))
    return edges.containing(p, s)


@query("edge_rebuild", "JOIN-14", E + "SELECT kind, source, target, sha256(kind || '|' || source || '|' || target) AS id FROM edges")
def edge_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return edges.rebuild(edge_table(spark, d))


@query("edge_kind_counts", "AGG-28", E + "SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM edges GROUP BY kind")
def edge_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return edge_table(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query("inverse_edges", "JOIN-14", E + """SELECT * FROM edges UNION SELECT CASE kind WHEN 'import' THEN 'imported-by' WHEN 'contains' THEN 'contained-in' ELSE 'called-by' END, target, source FROM edges""")
def inverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.with_inverse(edge_table(spark, d))


_FAN = "SELECT {b} AS node, count(*) AS n, min({a}) AS first FROM edges WHERE kind = '{k}' GROUP BY {b}"


@query("importers", "JOIN-16", E + _FAN.format(a="source", b="target", k="import"))
def importers(spark: SparkSession, d: str) -> DataFrame:
    return edge_table(spark, d).filter("kind = 'import'").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("first"))


@query("callers", "JOIN-17", E + "SELECT target AS node, count(*) AS n, min(source) AS first, (SELECT count(*) FROM edges WHERE kind = 'call' AND target NOT IN (SELECT source FROM edges WHERE kind = 'import')) AS n_unresolved FROM edges WHERE kind = 'call' GROUP BY target")
def callers(spark: SparkSession, d: str) -> DataFrame:
    e = edge_table(spark, d)
    calls = e.filter("kind = 'call'")
    known = e.filter("kind = 'import'").select(F.col("source").alias("target")).distinct()
    unresolved = calls.join(known, "target", "left_anti").agg(F.count("*").alias("n_unresolved"))  # one row
    return calls.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("first")).crossJoin(F.broadcast(unresolved))


@query("related_tests", "JOIN-18", E + """, u AS (SELECT target AS path, source AS rel, 1 AS prio FROM edges WHERE kind = 'import' UNION ALL SELECT source, target, 2 FROM edges WHERE kind = 'import' UNION ALL SELECT target, source, 3 FROM edges WHERE kind = 'contains'),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY prio DESC, rel DESC) AS n FROM u) SELECT path, rel AS related, prio::BIGINT AS direction FROM r WHERE n = 1""")
def related_tests(spark: SparkSession, d: str) -> DataFrame:
    e = edge_table(spark, d)
    way = lambda k, a, b, p: e.filter(F.col("kind") == k).select(F.col(a).alias("path"), F.col(b).alias("related"), F.lit(p).cast("long").alias("direction"))
    u = way("import", "target", "source", 1).union(way("import", "source", "target", 2)).union(way("contains", "target", "source", 3))
    # the last direction, and of it the last path, holds: a maximum instead of a sort
    return u.groupBy("path").agg(F.max(F.struct("direction", "related")).alias("x")).select("path", "x.related", "x.direction")


@query("overview_counts", "AGG-05", f"""WITH {FILES_SQL} SELECT count(*) AS n_files, count(*) FILTER (doc_id % 17 <> 1) AS n_parsed, sum(doc_id % 7)::BIGINT AS n_symbols, count(*) FILTER (list_contains(string_split(path, '/'), 'tests') OR regexp_matches(path, '(^|/)test_[^/]*$')) AS n_tests,
  count(DISTINCT {duck_language('path')}) AS n_languages, count(DISTINCT regexp_extract(path, '^([^/]*)', 1)) AS n_packages FROM files""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    i, p = F.col("doc_id"), F.col("path")
    return files(spark, d).agg(
        F.count("*").alias("n_files"), F.count_if(i % 17 != 1).alias("n_parsed"), F.sum(i % 7).alias("n_symbols"), F.count_if(paths.is_test_strict(p)).alias("n_tests"),
        F.count_distinct(paths.language(p)).alias("n_languages"), F.count_distinct(F.substring_index(p, "/", 1)).alias("n_packages"),
    )


@query("coverage", "AGG-06", f"WITH {FILES_SQL} SELECT count(*) AS n_files, count(*) FILTER (doc_id % 3 = 0) AS n_analysed, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 2 = 0) AS n_represented, count(*) FILTER (doc_id % 3 = 0) < count(*) AS partial FROM files")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return files(spark, d).agg(F.count("*").alias("n_files"), F.count_if(i % 3 == 0).alias("n_analysed"), F.count_if((i % 3 == 0) & (i % 2 == 0)).alias("n_represented"), (F.count_if(i % 3 == 0) < F.count("*")).alias("partial"))


@query("config_consumers", "JOIN-21", """WITH k AS (SELECT DISTINCT c_custkey AS path, c_nationkey::VARCHAR || c_mktsegment AS key FROM customer), s AS (SELECT key, count(*) - 1 AS n FROM k GROUP BY key) SELECT path, sum(n)::BIGINT AS n FROM k JOIN s USING (key) GROUP BY path""")
def config_consumers(spark: SparkSession, d: str) -> DataFrame:
    return edges.sharing(table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("key")))


def warnings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", F.concat(F.lit("code-"), (i % 5).cast("string")).alias("code"), F.when(i % 11 == 0, F.lit(None)).otherwise(_KEY("u", "user_id")).alias("path"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("related"),
        F.when(i % 2 == 0, "info").otherwise("warning").alias("severity"), F.concat(F.lit("m"), (i % 13).cast("string")).alias("message"), i.alias("ordinal"), F.col("user_id").alias("run"),
    )


W = """WITH w AS (SELECT event_id, 'code-' || (event_id % 5)::VARCHAR AS code, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'u' || user_id::VARCHAR END AS path, 'r' || (event_id % 3)::VARCHAR AS related,
  CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'warning' END AS severity, 'm' || (event_id % 13)::VARCHAR AS message, event_id AS ordinal, user_id AS run FROM events) """


@query("warning_canonical", "AGG-15", W + "SELECT code, path, related, arg_max(message, ordinal) AS message FROM w GROUP BY ALL")
def warning_canonical(spark: SparkSession, d: str) -> DataFrame:
    return metrics.canonical_warnings(warnings(spark, d))


_GROUP = "SELECT {k}, count(*) AS n_records, count(*) FILTER (path IS NULL) AS n_pathless, count(DISTINCT path) AS n_paths, count(DISTINCT related) AS n_related FROM w GROUP BY {k}"


@query("warning_groups", "AGG-16", W + _GROUP.format(k="code, severity, message, related"))
def warning_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.warning_groups(warnings(spark, d), ["code", "severity", "message", "related"])


@query("bench_warning_groups", "AGG-17", W + _GROUP.format(k="code, severity, message"))
def bench_warning_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.warning_groups(warnings(spark, d), ["code", "severity", "message"])


_CODES = ["stale-index", "incomplete-parse-data", "structural-coverage-limitations", "dynamic-or-unresolved-calls", "structural-record-unavailable", "documentation-not-selected"]
_PEN = """CASE WHEN contains(code, 'stale') THEN 0.8 WHEN code = 'incomplete-parse-data' THEN 0.08 WHEN code = 'structural-coverage-limitations' THEN 0.12 WHEN code = 'dynamic-or-unresolved-calls' THEN 0.15 WHEN code = 'structural-record-unavailable' THEN 0.5 ELSE 0.1 END"""


@query("result_confidence", "AGG-20", f"""WITH w AS (SELECT user_id AS run, [{', '.join(f"'{c}'" for c in _CODES)}][(event_id % 6 + 1)::INT] AS code, event_id % 4 = 0 AS info, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 10) / 20.0::DOUBLE END AS conf FROM events),
p AS (SELECT run, code, max({_PEN}::DOUBLE * (CASE WHEN info THEN 0.5 ELSE 1.0 END)::DOUBLE * coalesce(conf, 0.5::DOUBLE)) AS pen FROM w GROUP BY run, code)
SELECT run, round(0.9::DOUBLE * (CASE WHEN run % 2 = 0 THEN 1.0 ELSE 0.35 END)::DOUBLE * (CASE WHEN run % 3 = 0 THEN 0.85 ELSE 1.0 END)::DOUBLE * product(1 - least(0.9::DOUBLE, pen)), 12) AS confidence FROM p GROUP BY run""")
def result_confidence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (i % 6 + 1).cast("int"))
    w = table(spark, d, "events").select(F.col("user_id").alias("run"), code.alias("code"), F.when(i % 4 == 0, "info").otherwise("warning").alias("severity"), F.when(i % 3 == 0, F.lit(None)).otherwise((i % 10) / 20.0).alias("conf"))
    each = w.groupBy("run", "code").agg(F.max(metrics.penalty(F.col("code"), F.col("severity"), F.col("conf"))).alias("pen"))
    # one entry a code
    listed = each.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "pen"))), lambda x: x["pen"]).alias("p"))
    return listed.select("run", F.round(metrics.result_confidence(F.lit(0.9), F.col("p"), F.col("run") % 2 == 0, F.col("run") % 3 == 0), 12).alias("confidence"))


@query("symbol_set_equality", "JOIN-33,JOIN-34", "SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'unknown' WHEN b.k IS NULL THEN 'missing' END AS fault FROM (SELECT p_partkey AS k FROM part WHERE p_size > 5) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def symbol_set_equality(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("k")).alias("a")
    b = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct().alias("b")
    both = a.join(b, F.col("a.k") == F.col("b.k"), "full_outer").filter("a.k is null or b.k is null")
    return both.select(F.coalesce("a.k", "b.k").alias("id"), F.when(F.col("a.k").isNull(), "unknown").otherwise("missing").alias("fault"))


@query("symbol_ordinals", "WIN-08", "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem")
def symbol_ordinals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.row_number().over(w).cast("long").alias("nth"))
