"""Queries over bounded views of files, records, claims, reviews, reports and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import codemap, render, resolve, session
from loamwork.operators.cut import cut
from loamwork.plans.binding import FILES_SQL, files, table
from loamwork.plans.facts import FACTS_SQL, RESOLVED_SQL, facts
from loamwork.plans.q_facts import _edges, resolved
from loamwork.plans.registry import query

# Signatures of differing length, some over the cap.
_SIGNED = "signed AS (SELECT s.path, s.symbol, s.name, s.parent, CASE WHEN s.parent IS NULL THEN 'function' ELSE 'method' END AS kind, s.name || '(' || repeat('x, ', (c.i % 61)::INT) || ')' AS signature FROM symbols s JOIN code c ON s.path = c.path)"


def signed(f: dict[str, DataFrame]) -> DataFrame:
    s = f["symbols"].join(f["code"].select("path", "i"), "path")
    signature = F.concat("name", F.lit("("), F.repeat(F.lit("x, "), (F.col("i") % 61).cast("int")), F.lit(")"))
    return s.select("path", "symbol", "name", "parent", F.when(F.col("parent").isNull(), "function").otherwise("method").alias("kind"), signature.alias("signature"))


# A file's part of an edge's source, which may be a symbol of it.
_OWN = "regexp_extract(source, '^([^#]*)', 1)"


@query("codemap_projection", "PRJ-01", f"""WITH {RESOLVED_SQL}, {_SIGNED}, raw AS (SELECT 'import' AS kind, path AS source, target FROM resolved WHERE resolution = 'internal' UNION SELECT 'contains', parent, symbol FROM symbols WHERE parent IS NOT NULL
  UNION SELECT 'call', symbol, target_symbol FROM rcalls WHERE target_symbol IS NOT NULL UNION SELECT kind, source, target FROM links),
e AS (SELECT DISTINCT {_OWN} AS path, kind, target FROM raw),
s AS (SELECT path, string_agg(v, ',' ORDER BY v) FILTER (k <= 24) AS symbols, count(*) AS n, bool_or(l) AS l FROM (SELECT path, symbol || '=' || substr(signature, 1, 160) AS v, length(signature) > 160 AS l, row_number() OVER (PARTITION BY path ORDER BY symbol || '=' || substr(signature, 1, 160)) AS k FROM signed) GROUP BY path),
r AS (SELECT path, string_agg(v, ',' ORDER BY v) FILTER (k <= 32) AS relationships, count(*) AS n FROM (SELECT path, kind || ':' || target AS v, row_number() OVER (PARTITION BY path ORDER BY kind || ':' || target) AS k FROM e) GROUP BY path),
n AS (SELECT path, string_agg(v, ',' ORDER BY v) AS kinds FROM (SELECT path, kind || '=' || count(*)::VARCHAR AS v FROM e GROUP BY path, kind) GROUP BY path)
SELECT c.path, coalesce(symbols, '') AS symbols, coalesce(relationships, '') AS relationships, coalesce(kinds, '') AS kinds, coalesce(s.n, 0) > 24 OR coalesce(r.n, 0) > 32 OR coalesce(s.l, false) AS truncated FROM (SELECT DISTINCT path FROM code) c LEFT JOIN s USING (path) LEFT JOIN r USING (path) LEFT JOIN n USING (path)""")
def codemap_projection(spark: SparkSession, d: str) -> DataFrame:
    f = resolved(spark, d)
    edges = _edges(f).select(F.substring_index("source", "#", 1).alias("path"), "kind", "target")
    return codemap.projection(f["code"], signed(f), cut(edges))


_CUT = "SELECT path, string_agg(v, ',' ORDER BY v) FILTER (k <= {cap}) AS {name}, count(*) AS n FROM (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY v) AS k FROM (SELECT DISTINCT path, {v} AS v FROM {src})) GROUP BY path"


@query("compact_facts", "PRJ-02", f"""WITH {FACTS_SQL}, s AS ({_CUT.format(cap=1, name='symbols', v='symbol', src='symbols')}), m AS ({_CUT.format(cap=1, name='imports', v="n::VARCHAR || ':' || module", src='imports')}), x AS ({_CUT.format(cap=1, name='exports', v='name', src='symbols WHERE parent IS NULL')})
SELECT c.path, coalesce(symbols, '') AS symbols, coalesce(imports, '') AS imports, coalesce(exports, '') AS exports, coalesce(s.n, 0) > 1 OR coalesce(m.n, 0) > 1 OR coalesce(x.n, 0) > 1 AS truncated FROM (SELECT DISTINCT path FROM code) c LEFT JOIN s USING (path) LEFT JOIN m USING (path) LEFT JOIN x USING (path)""")
def compact_facts(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    parts = {"symbols": (f["symbols"], F.col("symbol")), "imports": (f["imports"], F.concat_ws(":", "n", "module")), "exports": (f["symbols"].filter("parent is null"), F.col("name"))}
    return codemap.compact(f["code"], parts, 6)


@query("symbol_search", "FLT-14", f"WITH {FACTS_SQL}, {_SIGNED} SELECT path, symbol, kind FROM signed WHERE contains(lower(name || ' ' || symbol || ' ' || signature), 'run(x, x') AND kind = 'method' AND starts_with(path, 'src/')")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return codemap.search_symbols(signed(facts(spark, d)), "Run(X, x", "method", "src/").select("path", "symbol", "kind")


@query("index_search", "FLT-15", f"""WITH {FACTS_SQL}, r AS (SELECT 'verified_fact' AS kind, '{{"path":"' || path || '","symbol":"' || symbol || '","name":"' || name || '"}}' AS record FROM symbols UNION ALL SELECT 'model_interpretation', '{{"path":"' || path || '","key":"' || key || '"}}' FROM keys)
SELECT kind, record FROM r WHERE kind = 'verified_fact' AND contains(lower(record), 'm1') AND contains(lower(record), '"name":"helper"') OR kind = 'model_interpretation' AND contains(lower(record), '"key":"l3"')""")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    fact = f["symbols"].select(F.lit("verified_fact").alias("kind"), F.to_json(F.struct("path", "symbol", "name")).alias("record"))
    told = f["keys"].select(F.lit("model_interpretation").alias("kind"), F.to_json(F.struct("path", "key")).alias("record"))
    all_ = fact.union(told)
    one = codemap.search_index(codemap.search_index(all_, "M1", ("verified_fact",)), '"NAME":"helper"', ("verified_fact",))
    return one.union(codemap.search_index(all_, '"key":"L3"', ("model_interpretation",))).union(codemap.search_index(all_, "m", ("verified_fact",), "fresh"))


@query("codemap_records", "UDT-04", f"""WITH {FACTS_SQL}, c AS (SELECT path, status, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM code),
s AS (SELECT path, string_agg('{{"symbol":"' || symbol || '","name":"' || name || '"}}', ',' ORDER BY symbol, name) AS s, count(*) AS n FROM symbols GROUP BY path)
SELECT c.path, sha256('{{"schema_version":1,"path":"' || c.path || '","status":' || coalesce('"' || status || '"', 'null') || ',"symbols":[' || coalesce(s, '') || ']}}') AS sha256, coalesce(n, 0)::BIGINT AS n_symbols, true AS valid FROM c LEFT JOIN s USING (path)""")
def codemap_records(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    r = codemap.serialise(f["code"], f["symbols"])
    back = codemap.deserialise(r.withColumn("path", F.col("path"))).select(F.col("path").alias("p"), F.size("symbols").cast("long").alias("n_symbols"), "valid")
    return r.join(back, F.col("path") == F.col("p")).select("path", F.sha2("record", 256).alias("sha256"), "n_symbols", "valid")


@query("review_selection", "JOIN-35", f"""WITH {FACTS_SQL}, u AS (SELECT path, 'discovered' AS origin FROM code WHERE i % 3 = 0 UNION ALL SELECT path, 'manual' FROM code WHERE i % 5 = 0),
m AS (SELECT path, max(origin) AS origin FROM u WHERE path NOT IN (SELECT path FROM code WHERE i % 7 = 0) GROUP BY path) SELECT 'merge' AS mode, path, origin FROM m UNION ALL SELECT 'replace', path, 'manual' FROM code WHERE i % 5 = 0 AND path NOT IN (SELECT path FROM code WHERE i % 7 = 0) GROUP BY path""")
def review_selection(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d)["code"]
    told = c.filter("i % 5 = 0").select("path", F.lit("include").alias("action")).union(c.filter("i % 7 = 0").select("path", F.lit("exclude")))
    found = c.filter("i % 3 = 0").select("path")
    both = [codemap.review(found, told, r).select(F.lit("replace" if r else "merge").alias("mode"), "path", "origin") for r in (False, True)]
    return both[0].union(both[1])


@query("review_priority", "FLT-19", f"""WITH {FACTS_SQL}, t AS (SELECT *, list_contains(string_split(path, '/'), 'tests') AS test FROM code)
SELECT i, CASE WHEN i % 11 = 0 THEN 0 WHEN i % 7 = 0 THEN 1 WHEN test THEN 4 WHEN i % 2 = 0 AND i % 4 <> 2 THEN 2 WHEN i % 4 = 2 THEN 3 ELSE 5 END::BIGINT AS priority FROM t""")
def review_priority(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return facts(spark, d)["code"].select("i", codemap.review_priority(i % 11 == 0, i % 7 == 0, resolve.is_test(F.col("path")), i % 4 == 2, i % 2 == 0).cast("long").alias("priority"))


@query("stamped_claims", "JOIN-37", f"""WITH {FILES_SQL}, c AS (SELECT doc_id AS i, path, sha256, CASE WHEN doc_id % 4 <> 0 THEN path || '#s' END AS symbol, doc_id % 6 AS a, doc_id % 6 + doc_id % 8 AS b, [doc_id % 9, doc_id % 5 + 2, doc_id % 9, doc_id % 30] AS e FROM files),
k AS (SELECT *, list_sort(list_distinct(list_filter(e, lambda x: symbol IS NULL OR x BETWEEN a AND b))) AS kept FROM c)
SELECT path, symbol, array_to_string(kept, ',') AS evidence, 'rules/2|scripted|none|' || sha256 AS stamp FROM k WHERE len(kept) > 0""")
def stamped_claims(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    claims = files(spark, d).select("path", F.when(i % 4 != 0, F.concat("path", F.lit("#s"))).alias("symbol"), (i % 6).alias("start"), (i % 6 + i % 8).alias("stop"), F.lit("says").alias("text"), F.array(i % 9, i % 5 + 2, i % 9, i % 30).alias("evidence"))
    out = codemap.stamped(claims, files(spark, d), "rules/2", "scripted", "none")
    return out.select("path", "symbol", F.array_join("evidence", ",").alias("evidence"), F.concat_ws("|", "analyzer", "provider", "model", "source_sha256").alias("stamp"))


@query("index_report", "AGG-30", f"""WITH {FACTS_SQL} SELECT count(*) AS n_files, count(*) FILTER (status = 'parsed') AS n_parsed, count(*) FILTER (status IS NULL) AS n_failed, count(*) FILTER (i % 4 = 0) AS n_semantic, count(*) FILTER (i % 4 = 0 AND i % 13 <> 0) AS n_complete,
  (SELECT count(DISTINCT split_part(path, '/', 2)) FROM code) AS n_maps, true AS partial FROM code""")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d)["code"]
    semantic = c.filter("i % 4 = 0").select("path", F.when(F.col("i") % 13 == 0, "partial").otherwise("complete").alias("status"))
    return codemap.index_report(c.select("path", F.coalesce("status", F.lit("failed")).alias("status")), semantic, c.select(F.split("path", "/")[1].alias("package")).distinct(), True)


@query("candidate_universe", "JOIN-23", f"""WITH {FACTS_SQL}, f AS (SELECT DISTINCT path FROM code WHERE i % 13 <> 0), u AS (SELECT path FROM f UNION ALL SELECT DISTINCT path FROM code WHERE status IS NOT NULL UNION ALL SELECT DISTINCT path FROM code WHERE i % 4 = 0)
SELECT path, count(*) AS n_sources FROM u WHERE path IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM code WHERE i % 17 = 3) GROUP BY path""")
def candidate_universe(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d)["code"]
    return codemap.universe(c.filter("i % 13 <> 0"), c.filter("status is not null"), c.filter("i % 4 = 0"), c.filter("i % 17 = 3"))


@query("dependency_enrichment", "JOIN-24", f"""WITH {RESOLVED_SQL}, p AS (SELECT path, min(i) AS rank FROM code GROUP BY path), sel AS (SELECT path FROM p WHERE rank BETWEEN 24 AND 28), cand AS (SELECT *, rank % 3 <> 1 AS matches, starts_with(path, 'src/') AS code FROM p),
live AS (SELECT * FROM cand WHERE matches AND path NOT IN (SELECT path FROM sel)), u AS (SELECT path, rank, 1 AS tier FROM live WHERE code AND path IN (SELECT target FROM resolved WHERE resolution = 'internal' AND path IN (SELECT path FROM sel))
  UNION ALL SELECT path, rank, 2 FROM live WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM sel))
SELECT path, min(tier)::BIGINT AS tier FROM u GROUP BY path, rank ORDER BY min(tier), rank, path LIMIT 8""")
def dependency_enrichment(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    p = f["code"].groupBy("path").agg(F.min("i").alias("rank"))
    cand = p.select("path", "rank", (F.col("rank") % 3 != 1).alias("matches"), F.col("path").startswith("src/").alias("code"))
    out = codemap.dependencies(p.filter("rank between 24 and 28"), resolve.imports(f["imports"], f["code"]), cand, 8)
    return out.select("path", F.col("tier").cast("long").alias("tier"))


def tools(spark: SparkSession, d: str) -> dict[str, session.Tool]:
    """Some of a session's tools, over the facts."""
    f = resolved(spark, d)
    return {
        "search_symbols": session.Tool({"query": str, "under": str}, lambda query, under: codemap.search_symbols(signed(f), query, None, under).select("path", "symbol").orderBy("path", "symbol")),
        "find_imports": session.Tool({"path": str}, lambda path: f["resolved"].filter((F.col("path") == path) & (F.col("resolution") == "internal")).select("target").distinct().orderBy("target")),
        "find_importers": session.Tool({"path": str}, lambda path: f["resolved"].filter(F.col("target") == path).select("path").distinct().orderBy("path")),
        "list_tests": session.Tool({}, lambda: f["code"].filter(resolve.is_test(F.col("path"))).select("path").distinct().orderBy("path"), most=5),
    }


REQUESTS = [("search_symbols", {"query": "HELPER2", "under": "src/p0/"}), ("find_imports", {"path": "src/p0/m24.py"}), ("find_importers", {"path": "src/p6/m30.py"}), ("list_tests", {}), ("list_tests", {"path": "x"}), ("find_imports", {"path": 3}), ("run_shell", {"command": "ls"})]


@query("tool_observations", "WF-01", f"""WITH {RESOLVED_SQL}, r(n, tool, ok, code, k, most) AS (
  SELECT 0, 'search_symbols', true, 'ok', (SELECT count(*) FROM symbols WHERE contains(lower(symbol), 'helper2') AND starts_with(path, 'src/p0/')), 50 UNION ALL SELECT 1, 'find_imports', true, 'ok', (SELECT count(DISTINCT target) FROM resolved WHERE path = 'src/p0/m24.py' AND resolution = 'internal'), 50
  UNION ALL SELECT 2, 'find_importers', true, 'ok', (SELECT count(DISTINCT path) FROM resolved WHERE target = 'src/p6/m30.py'), 50 UNION ALL SELECT 3, 'list_tests', true, 'ok', (SELECT count(DISTINCT path) FROM istest WHERE test), 5
  UNION ALL SELECT 4, 'list_tests', false, 'invalid_arguments', 0, 5 UNION ALL SELECT 5, 'find_imports', false, 'wrong_type', 0, 50 UNION ALL SELECT 6, 'run_shell', false, 'unknown_tool', 0, 50)
SELECT n::BIGINT AS n, tool, ok, code, least(k, most)::BIGINT AS n_rows, k > most AS truncated FROM r""")
def tool_observations(spark: SparkSession, d: str) -> DataFrame:
    told = session.execute(tools(spark, d), REQUESTS)
    return spark.createDataFrame([(n, o.tool, o.ok, o.code, o.n_rows, o.truncated) for n, o in enumerate(told)], "n long, tool string, ok boolean, code string, n_rows long, truncated boolean")


@query("context_actions", "WF-02")
def context_actions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.floor("value").cast("long")
    a = e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "view", "click"), "add").otherwise("remove").alias("action"), F.concat(F.lit("f"), (v % 20).cast("string")).alias("path"),
        (v % 20 * 7 + 5).alias("size"), (v % 20 == 3).alias("pinned"), (v % 20 == 4).alias("excluded"),
    )
    return session.context_actions(a, 8, 400).select("session", "seq", "outcome", "used")


_FORM = """SELECT '{form}' AS form, 1::BIGINT AS part, lpad(rank::VARCHAR, 12, '0') AS at, {file} AS line FROM sel UNION ALL SELECT '{form}', 2, {told} AS at, {told} FROM {src}"""


@query("suggestion_render", "SNK-09", f"""WITH {FACTS_SQL}, sel AS (SELECT i AS rank, path, 0.5::DOUBLE + (i % 4) / 8.0::DOUBLE AS confidence FROM code WHERE i % 10 = 4), w AS (SELECT CASE WHEN i % 2 = 0 THEN 'related-test-omitted' ELSE 'stale-index-coverage' END AS code, CASE WHEN i % 2 = 0 THEN path END AS path, 'look at ' || (i % 3)::VARCHAR AS message FROM code WHERE i % 7 = 0),
g AS (SELECT code, message, CASE WHEN count(*) > 1 THEN ' x' || count(*)::VARCHAR ELSE '' END AS n FROM w GROUP BY ALL)
{_FORM.format(form='text', file="rank::VARCHAR || '. ' || path || ' (' || printf('%.2f', confidence) || ')'", told="'- ' || code || ': ' || message || n", src='g')}
UNION ALL {_FORM.format(form='markdown', file="rank::VARCHAR || '. `' || path || '` (' || printf('%.2f', confidence) || ')'", told="'- **' || code || '**: ' || message || n", src='g')}
UNION ALL {_FORM.format(form='json', file="chr(123) || '\"rank\":' || rank::VARCHAR || ',\"path\":\"' || path || '\",\"confidence\":' || confidence::VARCHAR || chr(125)", told="chr(123) || '\"code\":\"' || code || '\",\"path\":' || coalesce('\"' || path || '\"', 'null') || ',\"message\":\"' || message || '\"' || chr(125)", src='w')}""")
def suggestion_render(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d)["code"]
    i = F.col("i")
    chosen = c.filter("i % 10 = 4").select(i.alias("rank"), "path", (F.lit(0.5) + (i % 4) / F.lit(8.0)).alias("confidence"))
    told = c.filter("i % 7 = 0").select(F.when(i % 2 == 0, "related-test-omitted").otherwise("stale-index-coverage").alias("code"), F.when(i % 2 == 0, F.col("path")).alias("path"), F.concat(F.lit("look at "), (i % 3).cast("string")).alias("message"))
    forms = [render.suggestion(chosen, told, form).select(F.lit(form).alias("form"), F.col("part").cast("long").alias("part"), "at", "line") for form in ("text", "markdown", "json")]
    return forms[0].union(forms[1]).union(forms[2])


@query("package_inspection", "SNK-12", f"""WITH {FILES_SQL}, s AS (SELECT path, size_bytes AS b, doc_id % 3 = 0 AS r FROM files), t AS (SELECT path, b, row_number() OVER (ORDER BY b DESC, path) AS n FROM s)
SELECT 0::BIGINT AS at, 'files: ' || count(*)::VARCHAR AS line FROM s UNION ALL SELECT 1, 'bytes: ' || sum(b)::VARCHAR FROM s UNION ALL SELECT 2, 'ranged: ' || (count(*) FILTER (r))::VARCHAR FROM s UNION ALL SELECT n + 9, path || ' ' || b::VARCHAR FROM t WHERE n <= 20""")
def package_inspection(spark: SparkSession, d: str) -> DataFrame:
    s = files(spark, d).select("path", F.col("size_bytes").alias("n_bytes"), (F.col("doc_id") % 3 == 0).alias("ranged"))
    return render.inspection(s).select(F.col("at").cast("long").alias("at"), "line")
