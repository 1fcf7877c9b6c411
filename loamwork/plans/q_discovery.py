"""Queries over candidate ranking, facets, searches and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import fixed, paths, text
from loamwork.operators import budget, rank
from loamwork.operators.cut import cut
from loamwork.plans.binding import FILES_SQL, TASK, files, table
from loamwork.plans.registry import duck_list, duck_name, duck_tokens, query

WANTS = text.task_tokens(TASK)
FOUND = rank.facets(TASK)
PINS = (3, 14)

_TEST = r"(regexp_matches(lower(path), '^tests?/') OR regexp_matches(lower(path), '(^|/)test_[^/]*$') OR regexp_matches(lower(path), '(_test\.py|\.test\.ts|\.spec\.ts)$'))"
_CODE = f"(NOT {_TEST} AND list_contains({duck_list(fixed.IMPLEMENTATION_EXTENSIONS)}, lower(regexp_extract(path, '([^.]*)$', 1))))"
_STEM = f"regexp_extract({duck_name('path')}, '^([^.]*)', 1)"
_PARENT = duck_tokens("regexp_extract(lower(path), '^(.*)/[^/]*$', 1)")
_ROLE = f"""(CASE WHEN {_STEM} = 'server' OR ({_STEM} IN ('main', 'app') AND NOT list_has_any({_PARENT}, ['browser', 'client', 'public', 'web'])) THEN 22.0 ELSE 0.0 END
  + CASE WHEN {_STEM} IN ('config', 'configuration', 'setting', 'settings') OR list_contains({_PARENT}, 'config') THEN 20.0 ELSE 0.0 END + CASE WHEN {_TEST} THEN 10.0 ELSE 0.0 END)"""
_N = lambda tokens, wants: f"len(list_intersect({tokens}, {duck_list(wants)}))"
CAND_SQL = f"""{FILES_SQL},
cand AS (SELECT f.doc_id, path, {duck_tokens('d.source')} AS symbols, {duck_tokens('f.text')} AS summary, f.doc_id % 4 = 0 AS semantic, f.doc_id % 50 = 0 AS entry, f.doc_id % 21 = 0 AS direct_test, f.doc_id IN {PINS} AS pinned
  FROM files f JOIN documents d USING (doc_id)),
hit AS (SELECT *, {_N(duck_tokens('path'), WANTS)} AS mp, {_N('symbols', WANTS)} AS ms, {_N('summary', WANTS)} AS mu FROM cand),
scored AS (SELECT *, greatest(0.0, 1.0 + mp * 12.0 + ms * 8.0 + mu * 6.0 + CASE WHEN pinned THEN 10000.0 ELSE 0.0 END + CASE WHEN semantic THEN 0.5 ELSE 0.0 END
  + CASE WHEN entry THEN 10.0 WHEN {_CODE} THEN 3.0 ELSE 0.0 END + {_ROLE} + CASE WHEN NOT {_TEST} THEN 0.0 WHEN direct_test THEN 10.0 WHEN mp + ms + mu > 0 THEN 2.0 ELSE -12.0 END)::DOUBLE AS score FROM hit),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored)"""


def candidates(spark: SparkSession, d: str, *more: str) -> DataFrame:
    i = F.col("doc_id")
    return files(spark, d).select(
        "path", text.ranking_tokens(F.col("source")).alias("symbols"), text.ranking_tokens(F.col("text")).alias("summary"),
        (i % 4 == 0).alias("semantic"), (i % 50 == 0).alias("entry"), (i % 21 == 0).alias("direct_test"), i.isin(*PINS).alias("pinned"), *more,
    )


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank.rank(rank.score(candidates(spark, d), TASK))


@query("candidate_rank", "WIN-04,FN-01", f"""WITH {CAND_SQL}, i AS (SELECT *, sha256(path) AS h FROM ranked)
SELECT path, score, rank, 'c-' || substr(h, 1, 10 + 2 * (row_number() OVER (PARTITION BY substr(h, 1, 10) ORDER BY rank) - 1)) AS candidate_id FROM i""")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("path", "score", "rank", "candidate_id")


@query("ranking_tokens", "FN-01,FN-02", f"SELECT doc_id, array_to_string(list_sort({duck_tokens('text')}), ' ') AS tokens FROM documents")
def ranking_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.ranking_tokens(F.col("text"))), " ").alias("tokens"))


@query("role_score", "FN-04", f"WITH {FILES_SQL} SELECT path, {_ROLE}::DOUBLE AS score FROM files")
def role_score(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", paths.role_score(F.col("path"), WANTS).alias("score"))


@query("metadata_penalty", "FLT-11", rf"""WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'LICENSE.md' WHEN 1 THEN 'x/.gitignore' WHEN 2 THEN '.env.local.example' WHEN 3 THEN 'deploy/run_' || page_id::VARCHAR || '.sh' WHEN 4 THEN 'copying' WHEN 5 THEN 'src/setup_tool.py' ELSE 'src/a.py' END AS path FROM pages)
SELECT page_id, (CASE WHEN regexp_matches({duck_name('path')}, '^(license|copying)') THEN 0 WHEN {duck_name('path')} IN ('.gitignore', '.dockerignore', '.npmignore', '.ignore') THEN -100 WHEN regexp_matches({duck_name('path')}, '^\.env\.(.*)(example|sample|template)$') THEN -100
  WHEN list_has_any({duck_tokens('path')}, {duck_list(fixed.OPERATIONAL)}) THEN -60 ELSE 0 END)::DOUBLE AS penalty FROM p""")
def metadata_penalty(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    p = F.when(i % 7 == 0, "LICENSE.md").when(i % 7 == 1, "x/.gitignore").when(i % 7 == 2, ".env.local.example").when(i % 7 == 3, F.concat(F.lit("deploy/run_"), i.cast("string"), F.lit(".sh"))).when(i % 7 == 4, "copying").when(i % 7 == 5, "src/setup_tool.py").otherwise("src/a.py")
    return table(spark, d, "pages").select("page_id", paths.metadata_penalty(p, ["license"]).alias("penalty"))


_FACET = {
    "application startup": f"CASE WHEN entry THEN 36.0 WHEN {_STEM} IN ('app', 'bootstrap', 'index', 'main', 'server', 'startup') THEN 14.0 ELSE 0.0 END",
    "configuration": f"CASE WHEN entry THEN 12.0 ELSE 0.0 END + CASE WHEN {_STEM} IN ('config', 'configuration', 'setting', 'settings') THEN 28.0 ELSE 0.0 END",
    "relevant tests/files": f"CASE WHEN entry THEN 12.0 ELSE 0.0 END + CASE WHEN {_TEST} THEN 8.0 ELSE 0.0 END",
}


def facet_sql(found: list[rank.Facet]) -> str:
    laid = " UNION ALL ".join(
        f"SELECT '{f.label}' AS facet, path, rank, ({_N(duck_tokens('path'), sorted(f.tokens))} * 12.0 + {_N('symbols', sorted(f.tokens))} * 8.0 + {_N('summary', sorted(f.tokens))} * 6.0 + {_FACET.get(f.label, 'CASE WHEN entry THEN 12.0 ELSE 0.0 END')})::DOUBLE AS facet_score,"
        f" {'NOT ' if f.label == 'relevant tests/files' else ''}{_TEST} AS mismatch FROM ranked"
        for f in found
    )
    return f"""{CAND_SQL}, laid AS ({laid}),
by_facet AS (SELECT facet, path, facet_score, row_number() OVER (PARTITION BY facet ORDER BY mismatch, facet_score DESC, rank, path) AS facet_rank FROM laid WHERE facet_score >= 8.0)"""


FACET_SQL = facet_sql(FOUND)
#: Facets of another task, whose files the best of TASK need not have.
FAR = rank.facets("compare the src11 rows, then the src12 rows, then the src13 rows, then the src16 rows")


def _facets(spark: SparkSession, d: str, found: list[rank.Facet] = FOUND) -> DataFrame:
    return cut(rank.in_facets(rank.score(candidates(spark, d), TASK, rank.FACET_COLUMNS), found))


@query("facet_rank", "WIN-05,FN-05", f"WITH {FACET_SQL} SELECT * FROM by_facet")
def facet_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank.facet_ranking(_facets(spark, d))


_SUBSTANTIAL = duck_list([f.label for f in FOUND if f.substantial])
_MATCH = "(mp + ms + mu > 0)"
_RELEVANT = f"CASE WHEN {_TEST} AND NOT direct_test AND mp + ms + mu = 0 THEN pinned ELSE pinned OR entry OR direct_test AND {_TEST} OR {_STEM} = 'server' OR {_STEM} IN ('config', 'configuration', 'setting', 'settings') OR list_contains({_PARENT}, 'config') OR ({_STEM} IN ('main', 'app') AND NOT list_has_any({_PARENT}, ['browser', 'client', 'public', 'web'])) END"


@query("facet_preselect", "WIN-06,FLT-12", f"""WITH {FACET_SQL}, firsts AS (SELECT DISTINCT path FROM by_facet WHERE facet_rank = 1 AND list_contains({_SUBSTANTIAL}, facet)),
best AS (SELECT greatest(4.0, max(score) * 0.25) AS f FROM ranked WHERE NOT pinned),
tiers AS (SELECT path, rank, 0 AS tier FROM ranked WHERE path IN (SELECT path FROM firsts) UNION ALL SELECT path, rank, 1 FROM ranked, best WHERE path NOT IN (SELECT path FROM firsts) AND ({_RELEVANT} OR {_MATCH} OR score >= f AND {_CODE})),
chosen AS (SELECT path, rank, tier FROM tiers ORDER BY tier, rank LIMIT 40),
neutral AS (SELECT path, rank, 2 AS tier FROM ranked WHERE path NOT IN (SELECT path FROM chosen) ORDER BY rank LIMIT 1)
SELECT path, tier::BIGINT AS tier FROM (SELECT * FROM chosen UNION ALL SELECT * FROM neutral) ORDER BY tier, rank LIMIT 40""")
def facet_preselect(spark: SparkSession, d: str) -> DataFrame:
    return rank.preselect(_facets(spark, d), FOUND, 40).select("path", F.col("tier").cast("long").alias("tier"))


# Some files have the names of a server's entry and of settings.
_NAMED = "CASE WHEN doc_id % 40 = 2 THEN regexp_replace(path, '[^/]*$', 'server.py') WHEN doc_id % 40 = 4 THEN regexp_replace(path, '[^/]*$', 'settings.toml') ELSE path END"
ROLE_SQL = CAND_SQL.replace(FILES_SQL, FILES_SQL.replace("files AS", "base AS", 1) + f", files AS (SELECT * REPLACE ({_NAMED} AS path) FROM base)")


@query("fallback_roles", "WIN-07,TOP-02", f"""WITH {ROLE_SQL}, r AS (SELECT 0 AS n, 'server_entry_role' AS signal, path, rank FROM ranked WHERE {_STEM} = 'server' UNION ALL SELECT 1, 'configuration_role', path, rank FROM ranked WHERE {_STEM} = 'settings' UNION ALL SELECT 2, 'requested_test_role', path, rank FROM ranked WHERE {_TEST}),
f AS (SELECT n, signal, arg_min(path, rank) AS path FROM r GROUP BY n, signal) SELECT arg_min(signal, n) AS signal, path FROM f GROUP BY path""")
def fallback_roles(spark: SparkSession, d: str) -> DataFrame:
    i, path = F.col("doc_id"), F.col("path")
    named = F.when(i % 40 == 2, F.regexp_replace(path, "[^/]+$", "server.py")).when(i % 40 == 4, F.regexp_replace(path, "[^/]+$", "settings.toml")).otherwise(path)
    return rank.fallback_roles(rank.score(candidates(spark, d, "doc_id").withColumn("path", named), TASK), TASK)


@query("pick_confidence", "AGG-20", f"WITH {CAND_SQL} SELECT path, round(least(0.99, 0.5 + score / (2 * (score + 1))), 12) AS model_pick, round(least(0.8, 0.4 + score / (2 * (score + 1))), 12) AS fallback_pick FROM ranked")
def pick_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = rank.score(candidates(spark, d), TASK)
    return s.select("path", F.round(rank.pick_confidence(F.col("score"), False), 12).alias("model_pick"), F.round(rank.pick_confidence(F.col("score"), True), 12).alias("fallback_pick"))


@query("fallback_select", "WIN-10,WF-03", f"""WITH RECURSIVE {CAND_SQL}, o AS MATERIALIZED (SELECT path, strlen(text)::BIGINT AS size, row_number() OVER (ORDER BY pinned DESC, rank) AS n FROM ranked JOIN (SELECT doc_id AS i, text FROM documents) ON doc_id = i),
fold AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, ''::VARCHAR AS path, false AS taken UNION ALL SELECT o.n, CASE WHEN f.used + o.size <= 60000 THEN f.used + o.size ELSE f.used END, o.path, f.used + o.size <= 60000 FROM fold f JOIN o ON o.n = f.n + 1)
SELECT path FROM fold WHERE taken""")
def fallback_select(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d, "size_bytes")
    s = rank.score(c, TASK, ("size_bytes",)).select("path", "size_bytes", "score", F.array_contains("signals", "manual_pin").alias("pinned"))
    return budget.greedy_all(s, [~F.col("pinned"), -F.col("score"), F.col("path")], "size_bytes", 60_000).select("path")


@query("greedy_by_user", "WIN-10", """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
fold AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS used, -1::BIGINT AS event_id, false AS taken FROM e UNION ALL SELECT e.user_id, e.n, CASE WHEN f.used + e.size <= 400 THEN f.used + e.size ELSE f.used END, e.event_id, f.used + e.size <= 400 FROM fold f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, taken FROM fold WHERE n > 0""")
def greedy_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("size"))
    return budget.greedy(e, ["user_id"], ["event_id"], "size", 400).select("user_id", "event_id", "taken")


@query("budget_fail_point", "WIN-09,SRC-10", """WITH r AS (SELECT user_id, event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events)
SELECT user_id, min(event_id) AS fails_at, arg_min(running, event_id)::BIGINT AS total FROM r WHERE running > 900 GROUP BY user_id""")
def budget_fail_point(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("size"))
    return budget.fail_point(e, ["user_id"], ["event_id"], "size", 900)


@query("note_prefix_budget", "WIN-11", """WITH r AS (SELECT user_id, event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events) SELECT user_id, event_id FROM r WHERE running <= 500""")
def note_prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("size"))
    return budget.prefix(e, ["user_id"], ["event_id"], "size", 500).select("user_id", "event_id")


@query("page_fit", "WIN-12", """WITH r AS (SELECT user_id, event_id, floor(value)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
p AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY n) AS running FROM r WHERE n BETWEEN 11 AND 40) SELECT user_id, event_id FROM p WHERE running <= 700""")
def page_fit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("size"))
    return budget.page(e, ["user_id"], ["event_id"], "size", 10, 30, 700).select("user_id", "event_id")


@query("retry_shrink", "WIN-14,PRJ-02", """WITH RECURSIVE s AS (SELECT doc_id, strlen(text)::BIGINT AS n, 0::BIGINT AS k FROM documents UNION ALL SELECT doc_id, n // 2, k + 1 FROM s WHERE n > 300) SELECT doc_id, max(k) AS halvings FROM s GROUP BY doc_id""")
def retry_shrink(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", budget.halvings(F.octet_length("text").cast("long"), 300).alias("halvings"))


@query("text_search_topk", "FLT-13,TOP-03", f"""WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM l WHERE contains(text, 'the ')) SELECT path, line::BIGINT AS line, substr(text, 1, 500) AS snippet FROM h WHERE n <= 2 ORDER BY path, line LIMIT 100""")
def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    lines = files(spark, d).select("path", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("path", (F.col("p") + 1).cast("long").alias("line"), "text")
    return rank.text_search(lines, "the ", per_file=2)


@query("facet_coverage", "JOIN-25", f"""WITH {facet_sql(FAR)}, sel AS (SELECT path FROM ranked WHERE rank <= 5), covered AS (SELECT DISTINCT facet FROM by_facet WHERE path IN (SELECT path FROM sel)),
open AS (SELECT facet, arg_min(path, facet_rank) AS path, min(facet_rank) AS r FROM by_facet WHERE facet NOT IN (SELECT facet FROM covered) AND list_contains({duck_list([f.label for f in FAR if f.substantial])}, facet) GROUP BY facet) SELECT facet, path FROM open ORDER BY facet LIMIT 2""")
def facet_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rank.covered(_facets(spark, d, FAR), FAR)


GROUPS = [["item", "py"], ["config", "json"]]


@query("task_exclusions", "FLT-06", "WITH " + FILES_SQL + ", t AS (SELECT path, regexp_extract_all(lower(replace(path, '_', ' ')), '[a-z0-9]+') AS w FROM files) SELECT path FROM t WHERE starts_with(path, 'docs/') OR " + " OR ".join(f"list_has_all(w, {duck_list(g)})" for g in GROUPS))
def task_exclusions(spark: SparkSession, d: str) -> DataFrame:
    w = text.words(F.col("path"))
    hit = F.col("path").startswith("docs/")
    for g in GROUPS:
        hit = hit | F.forall(F.array(*map(F.lit, g)), lambda t: F.array_contains(w, t))
    return files(spark, d).filter(hit).select("path")
