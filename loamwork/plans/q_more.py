"""Queries over extraction, excerpts, responses and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import text
from loamwork.functions.paths import ancestors, preorder_key
from loamwork.operators import excerpt, extract, render, responses
from loamwork.plans.binding import FILES_SQL, files, table
from loamwork.plans.registry import duck_language, duck_tokens, query

_I = "doc_id::VARCHAR"


_CLEAN = r"""regexp_replace(text, '["\\\\\x00]', '', 'g')"""


@query("python_facts", "UDT-01,UDT-02,UDT-03", f"""WITH {FILES_SQL}, t AS (SELECT doc_id AS i, path, {_CLEAN} AS c, ends_with(path, '.py') AS py FROM files),
p AS (SELECT *, 2 + length(c) - length(replace(c, chr(10), '')) AS l, i % 4 AS k, i % 7 = 0 AS bad FROM t WHERE py), g AS (SELECT *, l + 1 + 2 * k AS s FROM p WHERE NOT bad), f AS (SELECT *, unnest(range(k)) AS j FROM g), o AS (SELECT * FROM g WHERE i % 3 = 0)
SELECT path, 'docstring' AS kind, 'module' AS qualified_name, 1::BIGINT AS start, 1::BIGINT AS stop FROM g WHERE regexp_matches(c, '\\S') UNION ALL SELECT path, 'import', 'os.path', l, l FROM g
UNION ALL SELECT path, 'function', 'fn_' || j, l + 1 + 2 * j, l + 2 + 2 * j FROM f UNION ALL SELECT path, 'call', 'fn_' || j || '.helper_' || j, l + 2 + 2 * j, l + 2 + 2 * j FROM f
UNION ALL SELECT path, 'class', 'C' || {_I.replace('doc_id', 'i')}, s, s + 4 FROM o UNION ALL SELECT path, 'method', 'C' || i || '.run', s + 3, s + 4 FROM o UNION ALL SELECT path, 'raise', 'C' || i || '.run.ValueError', s + 4, s + 4 FROM o
UNION ALL SELECT path, 'call', 'C' || i || '.run.' || n, s + 4, s + 4 FROM o, (SELECT unnest(['ValueError', 'self.go']) AS n)
UNION ALL SELECT path, 'diagnostic', 'syntax_error', l + 1 + 2 * k + CASE WHEN i % 3 = 0 THEN 5 ELSE 0 END, l + 1 + 2 * k + CASE WHEN i % 3 = 0 THEN 5 ELSE 0 END FROM p WHERE bad UNION ALL SELECT path, 'diagnostic', 'no_structural_extractor', 1, 1 FROM t WHERE NOT py""")
def python_facts(spark: SparkSession, d: str) -> DataFrame:
    """Files of differing code below their whole text, which is their docstring."""
    i = F.col("doc_id")
    doc = F.regexp_replace("text", r'["\\\x00]', "")
    functions = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < i % 4), lambda j: F.concat(F.lit("def fn_"), j.cast("string"), F.lit("(x):\n    return helper_"), j.cast("string"), F.lit("(x)\n"))), "")
    held = F.when(i % 3 == 0, F.concat(F.lit("class C"), i.cast("string"), F.lit(":\n    LIMIT = 1\n\n    async def run(self):\n        raise ValueError(self.go())\n"))).otherwise("")
    code = F.concat(F.lit('"""'), doc, F.lit('"""\nfrom os import path\n'), functions, held, F.when(i % 7 == 0, "def broken(:\n").otherwise(""))
    return extract.extract(files(spark, d).select("path", code.alias("text"))).select("path", "kind", "qualified_name", "start", "stop")


@query("source_excerpt", "WIN-13")
def source_excerpt(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path", "text", F.array(F.lit(2).cast("long"), (F.col("doc_id") % 5 + 1).cast("long")).alias("declared"))
    return excerpt.excerpts(f, 1200).select("path", F.octet_length("excerpt").cast("long").alias("n_bytes"), "ranges", "truncated")


@query("repair_plan", "FN-16,FN-17", """SELECT event_id, event_id % 7 + 1 AS attempt, CASE event_id % 7 + 1 WHEN 1 THEN 'exact_paths_and_schema' WHEN 2 THEN 'correct_previous_full_object' WHEN 3 THEN 'allowed_ids_required_template' WHEN 4 THEN 'plain_json_local_validation' ELSE 'smallest_task_valid_object' END AS strategy,
  event_id % 7 + 1 = 2 AS shows_previous, event_id % 7 + 1 >= 4 AS plain_json, CASE event_id % 7 + 1 WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS delay, event_type = 'error' AS retryable FROM events""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("event_id") % 7 + 1).alias("attempt")
    code = F.when(F.col("event_type") == "error", "provider_timeout").otherwise("invalid_request")
    return table(spark, d, "events").select("event_id", a, responses.repair_strategy(a).alias("strategy"), responses.shows_previous(a).alias("shows_previous"), responses.is_plain_json(a).alias("plain_json"), responses.retry_delay(a).alias("delay"), responses.retryable(code).alias("retryable"))


@query("response_validation", "FN-15,FN-14,SRC-12,SRC-19", """SELECT event_id AS id, event_id % 6 IN (0, 1) AS ok, CASE event_id % 6 WHEN 2 THEN 'duplicate_key' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'unknown_field' WHEN 5 THEN 'wrong_type' END AS code,
  CASE WHEN event_id % 6 IN (0, 1) THEN '{"paths":["a"],"schema_version":1}' END AS json FROM events""")
def response_validation(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 6
    r = F.when(i == 0, ' {"paths": ["a"]} ').when(i == 1, '```json\n{"schema_version": 1, "paths": ["a"]}\n```').when(i == 2, '{"paths": ["a"], "paths": []}').when(i == 3, '{"paths": ').when(i == 4, '{"paths": [], "more": 1}').otherwise('{"paths": "a"}')
    return responses.validate_all(table(spark, d, "events").select(F.col("event_id").alias("id"), r.alias("response")), responses.Contract({"paths": list}))


@query("json_pointer", "FN-13,SRC-17", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("semantic_tokens", "FN-03", f"SELECT p_partkey, array_to_string(list_sort({duck_tokens('p_name || chr(32) || p_type')}), ' ') AS tokens FROM part")
def semantic_tokens(spark: SparkSession, d: str) -> DataFrame:
    summary = F.to_json(F.struct(F.col("p_name").alias("claim"), F.struct(F.col("p_type").alias("name")).alias("symbol"), F.col("p_brand").alias("other")))
    said = F.array_join(F.regexp_extract_all(summary, F.lit(r'"(?:claim|name|qualified_name)":"([^"]*)"'), F.lit(1)), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.ranking_tokens(said)), " ").alias("tokens"))


@query("package_sections", "SNK-08", f"""WITH {FILES_SQL}, t AS (SELECT path, replace(text, '. ', repeat('`', (doc_id % 6)::INT)) AS text FROM files),
f AS (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))::INT) AS fence FROM t)
SELECT path, sha256('## `' || path || '`' || chr(10) || chr(10) || fence || lower(coalesce({duck_language('path')}, 'text')) || chr(10) || text || CASE WHEN ends_with(text, chr(10)) OR text = '' THEN '' ELSE chr(10) END || fence || chr(10)) AS sha256 FROM f""")
def package_sections(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")))
    return render.file_sections(files(spark, d).select("path", t.alias("text"))).select("path", F.sha2("markdown", 256).alias("sha256"))


@query("tree_render", "SNK-07,TOP-01", f"""WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/') AS p FROM files), dirs AS (SELECT DISTINCT unnest(list_transform(generate_series(1, len(p) - 1), lambda i: array_to_string(p[1:i], '/'))) AS path FROM p),
n AS (SELECT path, false AS is_dir FROM p UNION ALL SELECT path, true FROM dirs), k AS (SELECT path, is_dir, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN is_dir THEN '0' ELSE '1' END || regexp_extract(path, '([^/]*)$', 1) AS key FROM n)
SELECT path, repeat('|   ', len(string_split(path, '/')) - 1) || CASE WHEN row_number() OVER (PARTITION BY parent ORDER BY key DESC) = 1 THEN '`-- ' ELSE '|-- ' END || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM k""")
def tree_render(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path")
    nodes = f.select("path", F.lit(False).alias("is_dir")).union(f.select(F.explode(ancestors(F.col("path"))), F.lit(True)).distinct())
    name = F.substring_index("path", "/", -1)
    parts = nodes.select("path", "is_dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), name.alias("name"), F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), name).alias("key"))
    return render.tree_lines(parts)


@query("prompt_budgets", "SNK-11", """WITH p AS (SELECT conv_id AS prompt, CASE role WHEN 'user' THEN 'source' WHEN 'assistant' THEN 'diff' ELSE 'instructions' END AS category, repeat(text, 150) AS text, conv_id % 2 = 0 AS pinned FROM conversations),
e AS (SELECT prompt, category, sum(strlen(text))::BIGINT AS n_bytes, sum(CASE WHEN pinned THEN 0 ELSE strlen(text) END)::BIGINT AS free FROM p GROUP BY ALL)
SELECT prompt, category, n_bytes, CASE category WHEN 'source' THEN free <= 1048576 WHEN 'diff' THEN n_bytes <= 262144 ELSE n_bytes <= 65536 END AS fits FROM e UNION ALL SELECT prompt, 'total', sum(n_bytes)::BIGINT, sum(n_bytes) <= 2097152 FROM e GROUP BY prompt""")
def prompt_budgets(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("role") == "user", "source").when(F.col("role") == "assistant", "diff").otherwise("instructions")
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt"), category.alias("category"), F.repeat("text", F.lit(150)).alias("text"), (F.col("conv_id") % 2 == 0).alias("pinned"))
    return render.prompt_budgets(parts)


@query("file_summary", "JOIN-19", f"WITH {FILES_SQL} SELECT path, size_bytes, l.quality = 1 AS interpreted FROM files f LEFT JOIN labels l ON f.doc_id = l.doc_id")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("interpreted")), "doc_id", "left").select("path", "size_bytes", "interpreted")


@query("preorder_keys", "TOP-01", f"WITH {FILES_SQL} SELECT path, array_to_string(list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i = len(string_split(path, '/')) THEN '1' ELSE '0' END || x), chr(1)) AS key FROM files")
def preorder_keys(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", preorder_key(F.col("path")).alias("key"))
