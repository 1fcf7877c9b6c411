"""Facts of a Python repository bound to `documents`: a file a document, its imports, symbols, calls and keys, with their SQL.

Modules import neighbours absolutely and relatively, some of which are missing, ambiguous or external; some tests import what
they test, others carry its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.plans.binding import table

# One text for both engines: the expressions below mean the same in Spark and DuckDB.
_CODE = """SELECT doc_id AS i, CASE WHEN doc_id % 30 = 1 THEN concat('lib/p', CAST((doc_id - 1) % 12 AS {s}), '/m', CAST(doc_id - 1 AS {s}), '.py') WHEN doc_id % 12 = 11 THEN concat('tests/m', CAST(doc_id - 1 AS {s}), '_test.py')
    WHEN doc_id % 6 = 5 THEN concat('tests/test_m', CAST(doc_id - 1 AS {s}), '.py') ELSE concat('src/p', CAST(doc_id % 12 AS {s}), '/m', CAST(doc_id AS {s}), '.py') END AS path,
  CASE WHEN doc_id % 17 = 1 THEN 'partial' WHEN doc_id % 19 = 2 THEN NULL ELSE 'parsed' END AS status FROM documents"""
_IMPORTS = """SELECT path, 1 AS n, 0 AS level, concat('p', CAST((i + 6) % 12 AS {s}), '.m', CAST(i + 6 AS {s})) AS module, 'helper' AS name, CAST(NULL AS {s}) AS alias, CAST(NULL AS {s}) AS inside FROM code WHERE i % 6 <> 5
  UNION ALL SELECT path, 2, 1, concat('m', CAST(i + 12 AS {s})), 'run', 'r', CASE WHEN i % 4 = 0 THEN concat(path, '#run') WHEN i % 4 = 1 THEN concat(path, '#other') END FROM code WHERE i % 6 <> 5
  UNION ALL SELECT path, 3, 0, 'os.path', NULL, CASE WHEN i % 2 = 0 THEN 'osp' END, NULL FROM code
  UNION ALL SELECT path, 4, 0, concat('p', CAST((i - 1) % 12 AS {s}), '.m', CAST(i - 1 AS {s})), NULL, CASE WHEN i % 24 = 5 THEN 'mod' END, NULL FROM code WHERE i % 12 = 5
  UNION ALL SELECT path, 5, 2, concat('p', CAST((i + 1) % 12 AS {s}), '.m', CAST(i + 1 AS {s})), '*', NULL, NULL FROM code WHERE i % 6 = 2
  UNION ALL SELECT path, 6, 4, 'deep', 'x', NULL, NULL FROM code WHERE i % 6 = 3"""
_SYMBOLS = """SELECT path, concat(path, '#helper') AS symbol, 'helper' AS name, CAST(NULL AS {s}) AS parent FROM code WHERE i % 6 <> 5
  UNION ALL SELECT path, concat(path, '#run'), 'run', NULL FROM code UNION ALL SELECT path, concat(path, '#C.run'), 'run', concat(path, '#C') FROM code WHERE i % 5 = 0
  UNION ALL SELECT path, concat(path, '#helper2'), 'helper', NULL FROM code WHERE i % 6 <> 5 AND i % 8 = 0"""
_CALLS = """SELECT path, concat(path, '#run') AS symbol, 'helper' AS observed, i % 9 = 0 AS shadowed, {a}('x', 'y') AS params FROM code WHERE i % 6 <> 5
  UNION ALL SELECT path, concat(path, '#run'), 'r', false, CASE WHEN i % 10 = 4 THEN {a}('r') ELSE {a}('x') END FROM code WHERE i % 6 <> 5
  UNION ALL SELECT path, concat(path, '#run'), 'dyn.method', false, {a}('x') FROM code WHERE i % 3 = 0
  UNION ALL SELECT path, concat(path, '#run'), 'mod.helper', false, {a}('x') FROM code WHERE i % 12 = 5
  UNION ALL SELECT path, concat(path, '#run'), concat('p', CAST((i - 1) % 12 AS {s}), '.m', CAST(i - 1 AS {s}), '.run'), false, {a}('x') FROM code WHERE i % 12 = 5"""
_KEYS = """SELECT path, concat('K', CAST(i % 40 AS {s})) AS key FROM code WHERE i % 4 = 0 UNION ALL SELECT path, concat('L', CAST(i % 7 AS {s})) FROM code WHERE i % 9 = 0"""
_TEXT = {"code": _CODE, "imports": _IMPORTS, "symbols": _SYMBOLS, "calls": _CALLS, "keys": _KEYS}
FACTS_SQL = ",\n".join(f"{k} AS ({v.format(s='VARCHAR', a='list_value')})" for k, v in _TEXT.items())


def facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """code (i, path, status), imports, symbols, calls and keys."""
    out = {"code": spark.sql(_CODE.format(s="STRING", a="array").replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents").select("doc_id"))}
    for k in ("imports", "symbols", "calls", "keys"):
        out[k] = spark.sql(_TEXT[k].format(s="STRING", a="array").replace("FROM code", "FROM {code}"), code=out["code"])
    return out


RESOLVED_SQL = f"""{FACTS_SQL},
bare AS (SELECT path, regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', '') AS b FROM code),
mods AS (SELECT DISTINCT path, unnest(list_distinct([replace(b, '/', '.'), replace(regexp_replace(b, '^(src|lib)/', ''), '/', '.')])) AS module FROM bare),
bases AS (SELECT path, n, level, name, coalesce(module, '') AS base FROM imports WHERE level = 0
  UNION SELECT i.path, n, level, name, array_to_string(list_concat(string_split(s.module, '.')[1:len(string_split(s.module, '.')) - level], string_split(i.module, '.')), '.') FROM imports i JOIN mods s ON i.path = s.path WHERE level > 0 AND level <= len(string_split(s.module, '.'))),
cands AS (SELECT path, n, base AS module FROM bases UNION SELECT path, n, CASE WHEN base = '' THEN name ELSE base || '.' || name END FROM bases WHERE name IS NOT NULL AND name <> '*'),
hits AS (SELECT c.path, c.n, count(DISTINCT m.path) AS k, min(m.path) AS target FROM cands c JOIN mods m ON c.module = m.module GROUP BY ALL),
resolved AS (SELECT i.*, CASE WHEN k = 1 THEN 'internal' WHEN k IS NULL AND level = 0 THEN 'external' ELSE 'unresolved' END AS resolution, CASE WHEN k = 1 THEN target END AS target FROM imports i LEFT JOIN hits h ON i.path = h.path AND i.n = h.n),
tops AS (SELECT path AS target_path, name, min(symbol) AS target_symbol FROM symbols WHERE parent IS NULL GROUP BY ALL HAVING count(*) = 1),
asked AS (SELECT c.path, c.symbol, c.observed, r.target AS target_path, CASE WHEN r.name IS NOT NULL THEN r.name ELSE regexp_extract(c.observed, '([^.]*)$', 1) END AS name FROM calls c JOIN resolved r ON c.path = r.path AND r.resolution = 'internal' AND (r.inside IS NULL OR r.inside = c.symbol)
  WHERE NOT shadowed AND NOT list_contains(params, split_part(observed, '.', 1)) AND CASE WHEN r.name IS NOT NULL THEN observed = coalesce(alias, r.name) ELSE contains(observed, '.') AND regexp_extract(observed, '^(.*)\\.[^.]*$', 1) = coalesce(alias, r.module) END),
called AS (SELECT path, symbol, observed, min(target_path) AS target_path, min(target_symbol) AS target_symbol FROM asked JOIN tops USING (target_path, name) GROUP BY ALL HAVING count(DISTINCT target_symbol) = 1),
rcalls AS (SELECT c.path, c.symbol, c.observed, target_path, target_symbol FROM calls c LEFT JOIN called USING (path, symbol, observed)),
istest AS (SELECT *, list_contains(string_split(path, '/'), 'tests') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test(\\.[^./]*)?$') AS test, regexp_extract(path, '([^/]*)$', 1) AS file FROM code),
lone AS (SELECT file, min(path) AS target FROM istest WHERE NOT test GROUP BY file HAVING count(*) = 1),
linked AS (SELECT source, target, min(rank) AS rank FROM (
  SELECT t.path AS source, r.target, 1 AS rank FROM istest t JOIN resolved r ON t.path = r.path AND r.resolution = 'internal' WHERE t.test AND t.status = 'parsed'
  UNION ALL SELECT t.path, l.target, 2 FROM istest t JOIN lone l ON l.file = CASE WHEN starts_with(t.file, 'test_') THEN substr(t.file, 6) WHEN ends_with(t.file, '_test.py') THEN regexp_replace(t.file, '_test\\.py$', '.py') END WHERE t.test AND t.status = 'parsed')
  WHERE target IN (SELECT path FROM istest WHERE NOT test AND status = 'parsed') GROUP BY ALL),
links AS (SELECT 'tests' AS kind, source, target, CASE rank WHEN 1 THEN 'python_unambiguous_test_import' ELSE 'python_test_path_convention' END AS method FROM linked
  UNION SELECT 'tested_by', target, source, CASE rank WHEN 1 THEN 'python_unambiguous_test_import' ELSE 'python_test_path_convention' END FROM linked
  UNION SELECT 'test_reference', c.path, c.target_symbol, 'python_resolved_test_call' FROM rcalls c JOIN istest t ON c.path = t.path AND t.test AND t.status = 'parsed' JOIN istest o ON o.path = c.target_path AND NOT o.test)"""
