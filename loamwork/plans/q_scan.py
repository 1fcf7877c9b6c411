"""Queries over scanning, selection, line ranges and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions import fixed, paths, text
from loamwork.operators import index, select
from loamwork.plans.binding import FILES_SQL, RANGES_SQL, STATES_SQL, files, ranges, states, table
from loamwork.plans.registry import duck_language, duck_list, duck_name, query

WITH_FILES = f"WITH {FILES_SQL} "
WITH_STATES = f"WITH {STATES_SQL} "


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes, with NUL, control and invalid bytes put into some."""
    f = table(spark, d, "documents")
    raw, i = F.encode("text", "UTF-8"), F.col("doc_id")
    made = F.when(i % 9 == 0, F.concat(raw, F.unhex(F.lit("00")))).when(i % 9 == 1, F.concat(F.unhex(F.lit("FF")), raw)).when(i % 9 == 2, F.concat(F.encode(F.lit("\x01" * 600), "UTF-8"), raw)).otherwise(raw)
    return f.select("doc_id", made.alias("content"))


@query("binary_sniff", "SRC-04,SRC-05", r"""
WITH b AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN hex(encode(text)) || '00' WHEN 1 THEN 'FF' || hex(encode(text)) WHEN 2 THEN repeat('01', 600) || hex(encode(text)) ELSE hex(encode(text)) END AS h FROM documents),
s AS (SELECT doc_id, length(h) // 2 AS n_bytes, substr(h, 1, 16384) AS h FROM b),
p AS (SELECT *, regexp_extract_all(h, '..') AS pairs FROM s)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN len(pairs) = 0 THEN NULL WHEN list_contains(pairs, '00') THEN 'binary' WHEN TRY(decode(unhex(h))) IS NULL THEN 'invalid_encoding'
  WHEN len(list_filter(pairs, lambda x: x < '20' AND NOT list_contains(['08', '09', '0A', '0C', '0D'], x))) / len(pairs) > 0.3 THEN 'binary' END AS reason FROM p
""")
def binary_sniff(spark: SparkSession, d: str) -> DataFrame:
    return _bytes(spark, d).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), text.binary_reason(F.col("content")).alias("reason"))


@query("sha_inventory", "SRC-06,SRC-01", WITH_FILES + "SELECT path, size_bytes, sha256 FROM files")
def sha_inventory(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", "size_bytes", "sha256")


@query("language_counts", "FLT-20,FN-23,AGG-01", WITH_FILES + f"SELECT {duck_language('path')} AS language, count(*) AS n FROM files GROUP BY 1")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("scan_summary", "AGG-01,AGG-02", WITH_FILES + f"""SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes, count(*) FILTER (size_bytes > 4000) AS n_too_large,
  count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS n_directories, count(*) FILTER ({duck_language('path')} IS NULL) AS n_unknown FROM files""")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"), F.count_if(F.col("size_bytes") > 4000).alias("n_too_large"),
        F.count_distinct(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("n_directories"), F.count_if(paths.language(F.col("path")).isNull()).alias("n_unknown"),
    )


@query("line_counts", "FN-06", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END::BIGINT AS n_lines FROM documents")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query("canonical_newlines", "FN-07,SRC-09", r"SELECT doc_id, sha256(regexp_replace(replace(text, '. ', '.' || chr(13) || chr(10)), chr(13) || chr(10) || '|' || chr(13), chr(10), 'g')) AS sha256 FROM documents")
def canonical_newlines(spark: SparkSession, d: str) -> DataFrame:
    windows = F.concat(F.lit("﻿"), F.replace("text", F.lit(". "), F.lit(".\r\n")))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.canonical_newlines(windows), 256).alias("sha256"))


@query("token_estimate", "FN-09", "SELECT doc_id, ((strlen(text) + 2) // 3)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.octet_length("text")).alias("n_tokens"))


@query("truncate_utf8", "FN-08", r"SELECT doc_id, coalesce(TRY(decode(unhex(substr(hex(encode(text)), 1, 2000)))), TRY(decode(unhex(substr(hex(encode(text)), 1, 1998)))), TRY(decode(unhex(substr(hex(encode(text)), 1, 1996)))), decode(unhex(substr(hex(encode(text)), 1, 1994)))) AS head FROM documents")
def truncate_utf8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate_utf8(F.col("text"), 1000).alias("head"))


_LICENSE_SQL = "CASE " + " ".join(f"WHEN contains(lower(substr(text, 1, 16384)), '{m}') THEN '{n}'" for m, n in fixed.LICENSE_MARKERS) + " END"


@query("license_detect", "FLT-21,FN-22", f"SELECT doc_id, {_LICENSE_SQL} AS license FROM documents")
def license_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.license_name(F.col("text")).alias("license"))


@query("fence_width", "FN-19", "SELECT page_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(replace(html, '<p>', repeat('`', (page_id % 7)::INT)), '`+'), lambda x: length(x))), 0))::INT) AS fence FROM pages")
def fence_width(spark: SparkSession, d: str) -> DataFrame:
    ticks = F.replace("html", F.lit("<p>"), F.repeat(F.lit("`"), (F.col("page_id") % 7).cast("int")))
    return table(spark, d, "pages").select("page_id", text.fence(ticks).alias("fence"))


@query("redact_text", "FN-18", r"""WITH t AS (SELECT page_id, url || '&token=' || page_id::VARCHAR || ' Bearer abc' || page_id::VARCHAR || ' https://me:pw@x.org/' AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+', '\1 [REDACTED]', 'g'), '([a-z][a-z0-9+.-]*://)[^/@\s]+@', '\1[REDACTED]@', 'g'), '(?i)([?&](?:api_key|key|password|secret|token)=)[^&\s#]*', '\1[REDACTED]', 'g') AS redacted FROM t""")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    s = F.concat("url", F.lit("&token="), i, F.lit(" Bearer abc"), i, F.lit(" https://me:pw@x.org/"))
    return table(spark, d, "pages").select("page_id", text.redact(s).alias("redacted"))


@query("portable_paths", "FLT-23", r"""WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:x' WHEN 3 THEN 'a\b' WHEN 4 THEN 'a//b' WHEN 5 THEN 'a/./b' WHEN 6 THEN 'a/..b/c.' ELSE 'a/b' || chr(9) END AS path FROM pages)
SELECT page_id, NOT (regexp_matches(path, '[\\\x00-\x1f\x7f]') OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(path, '(^|/)\.{0,2}(/|$)')) AS portable FROM p""")
def portable_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 8
    p = F.when(i == 0, F.concat(F.lit("/"), "url")).when(i == 1, "a/../b").when(i == 2, "C:x").when(i == 3, "a\\b").when(i == 4, "a//b").when(i == 5, "a/./b").when(i == 6, "a/..b/c.").otherwise("a/b\t")
    return table(spark, d, "pages").select("page_id", paths.is_portable(p).alias("portable"))


_TEST_ANY = r"(regexp_matches(lower(path), '^tests?/') OR regexp_matches(lower(path), '(^|/)test_[^/]*$') OR regexp_matches(lower(path), '({})$'))"
_TEST_RANKED = _TEST_ANY.format(r"_test\.py|\.test\.ts|\.spec\.ts")


@query("test_paths", "FLT-07,FLT-08,FLT-09,FLT-10", WITH_FILES + rf"""SELECT path, list_contains(string_split(path, '/'), 'tests') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test(\.[^./]*)?$') AS strict_test,
  {_TEST_ANY.format(r'_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts')} AS any_test, {_TEST_RANKED} AS ranked_test,
  NOT {_TEST_RANKED} AND list_contains({duck_list(fixed.IMPLEMENTATION_EXTENSIONS)}, lower(regexp_extract(path, '([^.]*)$', 1))) AS implementation FROM files""")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", paths.is_test_strict(F.col("path")).alias("strict_test"), paths.is_test_any(F.col("path")).alias("any_test"), paths.is_test_ranked(F.col("path")).alias("ranked_test"), paths.is_implementation(F.col("path")).alias("implementation"))


@query("package_key", "FLT-18", WITH_FILES + """SELECT path, CASE WHEN p[1] IN ('src', 'lib') AND len(p) >= 2 THEN p[1] || '/' || p[2] WHEN p[1] = 'tests' THEN CASE WHEN len(p) < 3 THEN 'tests' ELSE p[1] || '/' || p[2] END
  WHEN len(p) = 1 THEN 'repository-root' ELSE p[1] END AS package FROM (SELECT path, string_split(path, '/') AS p FROM files)""")
def package_key(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", paths.package_key(F.col("path")).alias("package"))


_CATEGORY = rf"""CASE WHEN regexp_matches({duck_name('path')}, '^(license|copying|notice)') THEN 'license' WHEN starts_with({duck_name('path')}, 'readme') THEN 'readme'
  WHEN regexp_matches({duck_name('path')}, '.\.(json|toml|yaml|yml|xml|ini|cfg)$') THEN 'config' WHEN regexp_matches({duck_name('path')}, '.\.(md|txt|rst|adoc)$') THEN 'document' ELSE 'source' END"""


@query("semantic_route", "FLT-17", WITH_FILES + f"""SELECT path, {_CATEGORY} AS category, (CASE {_CATEGORY} WHEN 'license' THEN 128 WHEN 'source' THEN CASE WHEN size_bytes <= 2048 AND doc_id % 7 <= 4 THEN 256 WHEN size_bytes <= 32768 THEN 320 ELSE 512 END
  ELSE CASE WHEN size_bytes > 2048 THEN 192 ELSE 160 END END)::BIGINT AS output_tokens, (8 + greatest(1, least(16, ceil(size_bytes / 2048.0))))::BIGINT AS work_units FROM files""")
def semantic_route(spark: SparkSession, d: str) -> DataFrame:
    units = 8 + F.greatest(F.lit(1), F.least(F.lit(16), F.ceil(F.col("size_bytes") / 2048.0)))
    return files(spark, d).select("path", paths.semantic_category(F.col("path")).alias("category"), paths.output_tokens(F.col("path"), F.col("size_bytes"), F.lit(False), F.col("doc_id") % 7).cast("long").alias("output_tokens"), units.cast("long").alias("work_units"))


RULES = [("", "default", list(fixed.DEFAULT_PATTERNS)), ("", "gitignore", ["*.md", "!src/**/*.md", "public/item_*", "docs/", "!docs/en", "*_1?.py"]), ("lib", "nested", ["*.json", "!src2/**"])]


@query("ignore_match", "FLT-05,SRC-07,SRC-08", WITH_FILES + r"""SELECT path, CASE
  WHEN starts_with(path, 'docs/') THEN 'gitignore' WHEN regexp_matches(path, '^lib/.*\.json$') AND NOT starts_with(path, 'lib/src2/') THEN 'nested'
  WHEN regexp_matches(path, '^public/item_[^/]*$') OR regexp_matches(path, '_1[^/]\.py$') THEN 'gitignore'
  WHEN regexp_matches(path, '\.md$') AND NOT starts_with(path, 'src/') AND NOT starts_with(path, 'lib/src2/') THEN 'gitignore' END AS source FROM files""")
def ignore_match(spark: SparkSession, d: str) -> DataFrame:
    return select.ignored(files(spark, d).select("path"), select.ignore_rules(RULES), fixed.PROTECTED_PATTERNS).select("path", "source")


INCLUDES = [("directory", "src"), ("glob", "*.py"), ("exact_path", "public/item_4.ts"), ("glob", "lib/**/config_*"), ("directory", "nowhere")]
EXCLUDES = [("exclusion", "src/src5"), ("exclusion", "test_*")]
_INCLUDE_SQL = [r"starts_with(path, 'src/')", r"regexp_matches(path, '\.py$')", "path = 'public/item_4.ts'", r"regexp_matches(path, '^lib/(.*/)?config_[^/]*$')", "starts_with(path, 'nowhere/')"]
_EXCLUDE_SQL = r"(starts_with(path, 'src/src5/') OR regexp_matches(path, '(^|/)test_[^/]*$'))"


@query("select_files", "JOIN-01,SET-01,SET-02,FLT-01,FLT-02", WITH_FILES + f"SELECT path, size_bytes FROM files WHERE ({' OR '.join(_INCLUDE_SQL)}) AND NOT {_EXCLUDE_SQL}")
def select_files(spark: SparkSession, d: str) -> DataFrame:
    return select.select_files(files(spark, d), INCLUDES, EXCLUDES).select("path", "size_bytes")


@query("selector_matches", "JOIN-01", WITH_FILES + " UNION ALL ".join(f"SELECT {i}::BIGINT AS ordinal, path FROM files WHERE {c}" for i, c in enumerate(_INCLUDE_SQL)))
def selector_matches(spark: SparkSession, d: str) -> DataFrame:
    return select.selector_matches(files(spark, d), INCLUDES)


@query("unmatched_selectors", "JOIN-01", WITH_FILES + "SELECT ordinal, value FROM (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS ordinal, '{v}' AS value, count(*) FILTER ({c}) AS n FROM files" for i, ((_, v), c) in enumerate(zip(INCLUDES, _INCLUDE_SQL, strict=True))) + ") WHERE n = 0")
def unmatched_selectors(spark: SparkSession, d: str) -> DataFrame:
    return select.unmatched(files(spark, d), INCLUDES).select("ordinal", "value")


@query("excluded_files", "SET-03", WITH_FILES + f"SELECT path FROM files WHERE ({' OR '.join(_INCLUDE_SQL)}) AND {_EXCLUDE_SQL}")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path")
    kept = select.select_files(f, INCLUDES, [])
    return kept.intersect(select.selector_matches(f, EXCLUDES).select("path"))


@query("glob_match", "FLT-03", WITH_FILES + r"SELECT path FROM files WHERE regexp_matches(path, '^lib/(.*/)?item_[^/]*[0-4]\.[^/][^/]$')")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).filter(F.col("path").rlike(select.glob_regex("lib/**/item_*[0-4].??"))).select("path")


@query("fnmatch_match", "FLT-04", WITH_FILES + r"SELECT path FROM files WHERE regexp_matches(path, '^src.*_[^0-4].*\.py$')")
def fnmatch_match(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).filter(F.col("path").rlike(select.fnmatch_regex("src*_[!0-4]*.py"))).select("path")


@query("dir_prefixes", "FLT-16", WITH_FILES + "SELECT dir, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(p) - 1), lambda i: array_to_string(p[1:i], '/'))) AS dir FROM (SELECT string_split(path, '/') AS p FROM files)) GROUP BY dir")
def dir_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


@query("tree_preorder", "WIN-22,SNK-07", WITH_FILES + """, p AS (SELECT path, string_split(path, '/') AS p FROM files),
dirs AS (SELECT DISTINCT unnest(list_transform(generate_series(1, len(p) - 1), lambda i: array_to_string(p[1:i], '/'))) AS path FROM p),
n AS (SELECT path, 'file' AS kind, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = len(p) THEN '1' ELSE '0' END || x), chr(1)) AS k FROM p
  UNION ALL SELECT path, 'directory', array_to_string(list_transform(string_split(path, '/'), lambda x: '0' || x), chr(1)) FROM dirs)
SELECT path, kind, row_number() OVER (ORDER BY k) AS position FROM n""")
def tree_preorder(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.operators.ranking import global_row_number

    f = files(spark, d).select("path")
    folders = f.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    at = F.array_join(F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("0"), x)), "\x01")
    nodes = f.select("path", F.lit("file").alias("kind"), paths.preorder_key(F.col("path")).alias("k")).union(folders.select("path", F.lit("directory"), at))
    return global_row_number(nodes, "position", [F.col("k")]).select("path", "kind", "position")


@query("merge_ranges", "WIN-01", f"""WITH {RANGES_SQL}, r AS (SELECT DISTINCT * FROM ranges),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start, stop) AS island FROM m) SELECT path, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM i GROUP BY path, island""")
def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    return select.merge_ranges(ranges(spark, d), ["path"])


@query("range_disjoint", "WIN-02", f"""WITH {RANGES_SQL}, r AS (SELECT DISTINCT * FROM ranges), l AS (SELECT *, lag(stop) OVER (PARTITION BY path ORDER BY start, stop) AS b FROM r)
SELECT path, count(*) AS n FROM l WHERE start <= b + 1 GROUP BY path""")
def range_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return select.overlaps(ranges(spark, d).distinct(), ["path"]).groupBy("path").agg(F.count("*").alias("n"))


@query("range_targets", "JOIN-02", f"""WITH {RANGES_SQL}, t AS (SELECT 'u/' || n_nationkey::VARCHAR AS path FROM nation WHERE n_regionkey <> 2)
SELECT path, count(*) AS n, min(start)::BIGINT AS first_line FROM ranges WHERE path IN (SELECT path FROM t) GROUP BY path""")
def range_targets(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.concat(F.lit("u/"), F.col("n_nationkey").cast("string")).alias("path"))
    return ranges(spark, d).join(known, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"), F.min("start").alias("first_line"))


@query("slice_lines", "WIN-03,SRC-10", """SELECT doc_id, CASE WHEN 3 <= n AND text <> '' THEN array_to_string(l[2:3], chr(10)) || CASE WHEN 3 < n OR ends_with(text, chr(10)) THEN chr(10) ELSE '' END END AS block
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n FROM documents)""")
def slice_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", select.slice_lines(F.col("text"), F.lit(2), F.lit(3)).alias("block"))


@query("line_range_parse", "FN-20", r"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a:b.py:3-9' WHEN 1 THEN 'x.py:7' WHEN 2 THEN url ELSE 'c.py:12-4' END AS s FROM pages)
SELECT page_id, regexp_extract(s, '^(.+):([0-9]+)-([0-9]+)$', 1) AS path, TRY_CAST(regexp_extract(s, '^(.+):([0-9]+)-([0-9]+)$', 2) AS BIGINT) AS start, TRY_CAST(regexp_extract(s, '^(.+):([0-9]+)-([0-9]+)$', 3) AS BIGINT) AS stop FROM r""")
def line_range_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 4
    s = F.when(i == 0, "a:b.py:3-9").when(i == 1, "x.py:7").when(i == 2, F.col("url")).otherwise("c.py:12-4")
    part = lambda k: F.regexp_extract(s, r"^(.+):([0-9]+)-([0-9]+)$", k)
    return table(spark, d, "pages").select("page_id", part(1).alias("path"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("stop"))


@query("context_statistics", "AGG-03,PRJ-04", WITH_FILES + f"""SELECT {duck_language('path')} AS language, count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars,
  sum(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS n_lines FROM files GROUP BY 1""")
def context_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return files(spark, d).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"), F.sum(F.length(t)).alias("n_chars"), F.sum(text.line_count(t)).alias("n_lines"))


def _index(name: str, ids: str, sql: str, run):
    query(name, ids, WITH_STATES + sql)(lambda spark, d: run(*states(spark, d)))


_BOTH = "prev p JOIN cur c ON p.path = c.path"
_SAME = "p.sha256 = c.sha256 AND p.size_bytes = c.size_bytes AND p.language IS NOT DISTINCT FROM c.language"
_index("index_added", "JOIN-03", "SELECT path FROM cur WHERE path NOT IN (SELECT path FROM prev)", lambda p, c: index.added(p, c).select("path"))
_index("index_deleted", "JOIN-05", "SELECT path FROM prev WHERE path NOT IN (SELECT path FROM cur)", lambda p, c: index.deleted(p, c).select("path"))
_index("index_changed", "JOIN-04", f"SELECT c.path FROM {_BOTH} WHERE NOT ({_SAME})", lambda p, c: index.compared(p, c).filter("changed").select("path"))
_index("index_unchanged", "JOIN-04", f"SELECT c.path FROM {_BOTH} WHERE {_SAME}", lambda p, c: index.compared(p, c).filter("not changed").select("path"))
_index("index_status", "JOIN-07", f"SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS status FROM prev p FULL JOIN cur c ON p.path = c.path", index.status)
_index("drift", "JOIN-08,SET-04", f"SELECT coalesce(p.path, c.path) AS path FROM prev p FULL JOIN cur c ON p.path = c.path WHERE p.path IS NULL OR c.path IS NULL OR NOT ({_SAME})", lambda p, c: index.status(p, c).filter("status <> 'unchanged'").select("path"))
_index("index_stale", "JOIN-06", f"SELECT * FROM (SELECT p.path, CASE WHEN NOT ({_SAME}) THEN 'source' WHEN p.analyzer <> 'v2' THEN 'analyzer' END AS reason FROM {_BOTH}) WHERE reason IS NOT NULL", lambda p, c: index.stale(p, c, "v2"))
_index("reuse_plan", "JOIN-27", f"SELECT c.path, CASE WHEN p.path IS NOT NULL AND {_SAME} AND p.analyzer = 'v2' AND p.status = 'complete' THEN 'reused' ELSE 'extracted' END AS action FROM cur c LEFT JOIN prev p ON p.path = c.path", lambda p, c: index.reuse(p, c, "v2"))
_index("semantic_reuse", "JOIN-28", f"""SELECT c.path, min(place)::BIGINT AS place FROM cur c LEFT JOIN (SELECT *, 0 AS place FROM prev WHERE doc_id % 3 = 0 UNION ALL SELECT *, 1 AS place FROM prev) p ON p.path = c.path AND {_SAME} GROUP BY c.path""",
       lambda p, c: index.first_reusable(c, [p.filter("doc_id % 3 = 0"), p]))
_index("index_statistics", "AGG-04", "SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes, count(*) FILTER (status = 'complete') AS n_complete, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'failed') AS n_failed FROM prev", lambda p, c: index.statistics(p))
_index("snapshot_digest", "AGG-19,FN-11,FN-12", "SELECT sha256('[' || string_agg('{\"path\":\"' || path || '\",\"sha256\":\"' || sha256 || '\"}', ',' ORDER BY path) || ']') AS digest FROM cur",
       lambda p, c: index.ordered_digest(c, "path", F.concat(F.lit('{"path":"'), F.col("path"), F.lit('","sha256":"'), F.col("sha256"), F.lit('"}'))))
_index("manifest_assembly", "SNK-17,FLT-24", "SELECT analyzer, count(*) AS n, count(*) - count(DISTINCT path) AS n_repeated, min(path) AS first_path FROM prev GROUP BY analyzer",
       lambda p, c: p.groupBy("analyzer").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("path")).alias("n_repeated"), F.min("path").alias("first_path")))
_index("benchmark_drift", "WF-08", f"SELECT count(*) FILTER (NOT ({_SAME})) AS n_changed FROM (SELECT path, CASE WHEN path = (SELECT min(path) FROM cur) THEN sha256(sha256) ELSE sha256 END AS sha256, size_bytes, language FROM cur) p JOIN cur c ON p.path = c.path",
       lambda p, c: index.compared(c.join(F.broadcast(c.agg(F.min("path").alias("least"))), F.lit(True)).withColumn("sha256", F.when(F.col("path") == F.col("least"), F.sha2("sha256", 256)).otherwise(F.col("sha256"))).drop("least"), c).agg(F.count_if("changed").alias("n_changed")))


@query("stable_ids", "FN-12,WIN-08", WITH_FILES + """SELECT path, 'file:' || sha256('["file","' || path || '","' || n::VARCHAR || '"]') AS id FROM (SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) AS n FROM files)""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).orderBy("path"))
    return files(spark, d).select("path", n.cast("string").alias("n")).select("path", text.stable_id("file", F.col("path"), F.col("n")).alias("id"))
