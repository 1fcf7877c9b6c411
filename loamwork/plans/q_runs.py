"""Queries over benchmark runs, progress events, settings and packaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import paths
from loamwork.operators import budget, events, metrics
from loamwork.plans.binding import FILES_SQL, PROGRESS_SQL, RUNS_SQL, files, progress, runs, table
from loamwork.plans.registry import query

R, P = f"WITH {RUNS_SQL} ", f"WITH {PROGRESS_SQL} "


@query("run_grid", "AGG-29", "SELECT item_id, mode, rep FROM benchmark, (SELECT unnest(['fresh', 'indexed', 'hybrid']) AS mode), (SELECT unnest(generate_series(1, 3)) AS rep)")
def run_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grid(table(spark, d, "benchmark").select("item_id"), ["fresh", "indexed", "hybrid"], 3)


@query("mode_overrides", "AGG-23,FLT-25,PRJ-05", """WITH g AS (SELECT item_id, unnest(['fresh', 'indexed']) AS mode FROM benchmark)
SELECT item_id, mode, coalesce(CASE WHEN mode = 'fresh' AND item_id % 3 = 0 THEN 31 END, CASE WHEN item_id % 2 = 0 THEN 16 END, 12)::BIGINT AS max_files FROM g""")
def mode_overrides(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.grid(table(spark, d, "benchmark").select("item_id"), ["fresh", "indexed"], 1)
    i = F.col("item_id")
    value, _ = events.precedence([("mode", F.when((F.col("mode") == "fresh") & (i % 3 == 0), 31)), ("task", F.when(i % 2 == 0, 16)), ("default", F.lit(12))])
    return g.select("item_id", "mode", value.cast("long").alias("max_files"))


@query("cohort_metrics", "AGG-07,AGG-08,AGG-13,AGG-14", R + """SELECT cohort, count(*) AS n_total, count(*) FILTER (ok) AS n_complete, (count(*) FILTER (ok) * (count(*) FILTER (ok) - 1) // 2)::BIGINT AS n_pairs,
  CASE WHEN count(*) FILTER (ok) < 2 THEN 'insufficient_data' WHEN bool_and(fallback) FILTER (ok) THEN 'deterministic_fallback_repeatability' ELSE 'semantic_stability' END AS stability,
  avg(duration_ms) FILTER (ok) AS mean_ms, min(duration_ms) FILTER (ok) AS min_ms, max(duration_ms) FILTER (ok) AS max_ms,
  CASE WHEN count(*) FILTER (ok) >= 2 THEN quantile_disc(duration_ms, 0.5) FILTER (ok) END AS p50_ms, CASE WHEN count(*) FILTER (ok) >= 2 THEN quantile_disc(duration_ms, 0.9) FILTER (ok) END AS p90_ms, CASE WHEN count(*) FILTER (ok) >= 2 THEN quantile_disc(duration_ms, 0.95) FILTER (ok) END AS p95_ms
FROM (SELECT *, status = 'complete' AS ok FROM runs) GROUP BY cohort""")
def cohort_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cohorts(runs(spark, d))


@query("confidence_summary", "AGG-12", R + "SELECT cohort, round(avg(confidence), 12) AS mean, min(confidence) AS least, max(confidence) AS most, round(max(confidence) - min(confidence), 12) AS spread FROM (SELECT cohort, CASE WHEN status = 'complete' THEN confidence END AS confidence FROM runs) GROUP BY cohort")
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confidence(runs(spark, d))


@query("pair_rates", "AGG-09,AGG-11,JOIN-31", R + """, v AS (SELECT cohort, rep, files, list_sort(list_distinct(files)) AS s FROM runs WHERE status = 'complete'), k AS (SELECT cohort, files, s, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
p AS (SELECT a.cohort, CASE WHEN a.files = b.files THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS n, a.s = b.s AS e, a.files = b.files AS o, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM k a JOIN k b ON a.cohort = b.cohort AND a.files <= b.files)
SELECT cohort, round(sum(CASE WHEN e THEN n ELSE 0 END) / nullif(sum(n), 0), 9) AS exact_set, round(sum(CASE WHEN o THEN n ELSE 0 END) / nullif(sum(n), 0), 9) AS exact_order, round(sum(j * n) / nullif(sum(n), 0), 9) AS jaccard FROM p GROUP BY cohort""")
def pair_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_rates(runs(spark, d))


@query("quality_rates", "AGG-10", R + "SELECT cohort, round(sum(CASE WHEN status = 'complete' AND list_contains(files, 'f1') THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END), 0), 12) AS recall FROM runs GROUP BY cohort")
def quality_rates(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "complete"
    rate = metrics.quality_rate(F.when(ok & F.array_contains("files", "f1"), 1).otherwise(0), F.when(ok, 1).otherwise(0))
    return runs(spark, d).groupBy("cohort").agg(F.round(rate, 12).alias("recall"))


@query("integer_ranges", "AGG-14", R + "SELECT cohort, min(len(list_distinct(files)))::BIGINT AS least_files, max(len(list_distinct(files)))::BIGINT AS most_files FROM runs GROUP BY cohort")
def integer_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.array_distinct("files")).cast("long")
    return runs(spark, d).groupBy("cohort").agg(F.min(n).alias("least_files"), F.max(n).alias("most_files"))


@query("expectation_eval", "JOIN-30", R + """SELECT cohort, rep, array_to_string(list_sort(list_filter(['f0', 'f1'], lambda x: NOT list_contains(files, x))), ',') AS missing, len(list_intersect(files, ['f3']))::BIGINT AS n_forbidden,
  list_contains(files, 'f0') AND list_contains(files, 'f1') AND list_has_any(files, ['f2', 'f0']) AND NOT list_contains(files, 'f3') AS passed FROM runs""")
def expectation_eval(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(runs(spark, d), ["f0", "f1"], [["f2", "f0"]], ["f3"]).select("cohort", "rep", "missing", "n_forbidden", "passed")


@query("budget_eval", "AGG-22,AGG-21", R + "SELECT cohort, rep, len(list_distinct(files)) <= 2 AND duration_ms <= 400 AS within FROM runs")
def budget_eval(spark: SparkSession, d: str) -> DataFrame:
    ok = metrics.within({"files": F.size(F.array_distinct("files")), "ms": F.col("duration_ms"), "http": F.col("rep")}, {"files": 2, "ms": 400, "http": None})
    return runs(spark, d).select("cohort", "rep", ok.alias("within"))


@query("suite_passed", "AGG-29", R + "SELECT split_part(cohort, '-', 1) AS suite, bool_and(status = 'complete' OR rep > 2) AS passed, count(*) AS n FROM runs GROUP BY 1")
def suite_passed(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy(F.substring_index("cohort", "-", 1).alias("suite")).agg(F.bool_and((F.col("status") == "complete") | (F.col("rep") > 2)).alias("passed"), F.count("*").alias("n"))


@query("required_model_calls", "AGG-24,AGG-25", f"""WITH RECURSIVE {FILES_SQL}, c AS (SELECT sum(ceil(n / 2.0))::BIGINT AS c FROM (SELECT regexp_extract(path, '^([^/]*)', 1) AS p, count(*) AS n FROM files GROUP BY 1)),
r AS (SELECT c AS n, c AS calls FROM c UNION ALL SELECT ceil(n / 2.0)::BIGINT, calls + ceil(n / 2.0)::BIGINT FROM r WHERE n > 1) SELECT (max(calls) + 2)::BIGINT AS calls FROM r""")
def required_model_calls(spark: SparkSession, d: str) -> DataFrame:
    n = files(spark, d).groupBy(F.substring_index("path", "/", 1).alias("package")).agg(F.count("*").alias("n"))
    return metrics.model_calls(n, 2, 2)


@query("route_totals", "AGG-26", f"""WITH {FILES_SQL}, r AS (SELECT path, CASE WHEN size_bytes = 0 THEN 'skipped' WHEN regexp_matches(path, '\\.(json|toml)$') THEN 'deterministic' WHEN regexp_matches(path, '\\.py$') THEN 'rich' ELSE 'generic' END AS route FROM files),
n AS (SELECT route, CASE WHEN route IN ('rich', 'generic') AND row_number() OVER (PARTITION BY route ORDER BY path) > 30 THEN true ELSE false END AS deferred FROM r) SELECT route, deferred, count(*) AS n FROM n GROUP BY ALL""")
def route_totals(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    route = F.when(F.col("size_bytes") == 0, "skipped").when(p.rlike(r"\.(json|toml)$"), "deterministic").when(p.rlike(r"\.py$"), "rich").otherwise("generic")
    r = files(spark, d).select("path", route.alias("route"))
    # the first 30 by path: a top-k a route instead of a ranking of all
    total = r.groupBy("route").agg(F.count("*").alias("n"))
    model = F.col("route").isin("rich", "generic")
    now = total.select("route", F.lit(False).alias("deferred"), F.when(model, F.least("n", F.lit(30))).otherwise(F.col("n")).cast("long").alias("n"))
    later = total.filter(model & (F.col("n") > 30)).select("route", F.lit(True), (F.col("n") - 30).cast("long"))
    return now.union(later)


@query("repeat_action_streaks", "WIN-15", P + """, e AS (SELECT *, sum(CASE WHEN event = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY operation ORDER BY seq) AS epoch FROM progress) SELECT operation, seq, row_number() OVER (PARTITION BY operation, epoch, event ORDER BY seq) AS streak FROM e""")
def repeat_action_streaks(spark: SparkSession, d: str) -> DataFrame:
    return events.streaks(progress(spark, d), ["operation"], "seq", F.col("event"), F.col("event") == "purchase").select("operation", "seq", "streak")


@query("failure_circuit", "WIN-17", P + """, e AS (SELECT *, sum(CASE WHEN event <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY operation ORDER BY seq) AS epoch FROM progress), s AS (SELECT operation, seq, event, row_number() OVER (PARTITION BY operation, epoch, event ORDER BY seq) AS n FROM e)
SELECT operation, min(seq) AS breaks_at FROM s WHERE event = 'error' AND n >= 3 GROUP BY operation""")
def failure_circuit(spark: SparkSession, d: str) -> DataFrame:
    s = events.streaks(progress(spark, d), ["operation"], "seq", F.col("event"), F.col("event") != "error")
    return s.filter("event = 'error' and streak >= 3").groupBy("operation").agg(F.min("seq").alias("breaks_at"))


@query("stagnation_streaks", "WIN-16", P + """, e AS (SELECT *, sum(CASE WHEN event = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY operation ORDER BY seq) AS epoch FROM progress) SELECT operation, seq, (sum(CASE WHEN event = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY operation, epoch ORDER BY seq))::BIGINT AS stagnant FROM e""")
def stagnation_streaks(spark: SparkSession, d: str) -> DataFrame:
    return events.stagnation(progress(spark, d), ["operation"], "seq", F.col("event") == "purchase").select("operation", "seq", "stagnant")


@query("progress_monotonic", "WIN-18", P + """, l AS (SELECT operation, seq, coalesce(value < lag(value) OVER (PARTITION BY operation ORDER BY seq), false) AS decreased, coalesce(max(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY operation ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS late FROM progress) SELECT * FROM l WHERE decreased OR late""")
def progress_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return events.progress_faults(progress(spark, d), ["operation"], "seq", F.col("value"), F.col("event") == "error").select("operation", "seq", "decreased", "late")


@query("progress_scale", "WIN-19,WIN-20", P + "SELECT operation, seq, round(20.0::DOUBLE + least(value, 100) * 45.0::DOUBLE / 100, 9) AS percent FROM progress")
def progress_scale(spark: SparkSession, d: str) -> DataFrame:
    return progress(spark, d).select("operation", "seq", F.round(events.scaled(F.least(F.col("value"), F.lit(100.0)), 20.0, 65.0), 9).alias("percent"))


@query("unit_tracker", "WIN-20", P + "SELECT operation, seq, count(*) FILTER (event = 'purchase') OVER w AS succeeded, count(*) FILTER (event = 'error') OVER w AS failed, count(*) OVER w AS processed FROM progress WINDOW w AS (PARTITION BY operation ORDER BY seq)")
def unit_tracker(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("operation").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return progress(spark, d).select("operation", "seq", F.count_if(F.col("event") == "purchase").over(w).alias("succeeded"), F.count_if(F.col("event") == "error").over(w).alias("failed"), F.count("*").over(w).alias("processed"))


@query("last_20_observations", "WIN-21", P + "SELECT operation, seq, event FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY seq DESC) AS n FROM progress) WHERE n <= 20")
def last_20_observations(spark: SparkSession, d: str) -> DataFrame:
    return events.last_rows(progress(spark, d), ["operation"], "seq", 20).select("operation", "seq", "event")


@query("operation_summary", "AGG-18", P + """SELECT operation, count(*) AS n_events, count(*) FILTER (event = 'error') AS n_errors, max(seq) FILTER (event = 'error') AS last_error, arg_max(value, seq) FILTER (event = 'error') AS last_error_value,
  greatest((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000, max(floor(value))::BIGINT) AS duration_ms, count(DISTINCT event) AS n_kinds FROM progress GROUP BY operation""")
def operation_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.summaries(progress(spark, d), ["operation"])


@query("seen_budgets", "SET-05,AGG-18", P + ", f AS (SELECT operation, floor(value)::BIGINT % 30 AS budget, min(seq) AS first_at FROM progress GROUP BY ALL) SELECT operation, budget, place FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY first_at) AS place FROM f) WHERE place <= 10")
def seen_budgets(spark: SparkSession, d: str) -> DataFrame:
    p = progress(spark, d).withColumn("budget", F.floor("value").cast("long") % 30)
    return events.first_wins(p, ["operation"], "budget", "seq", 10)


@query("latest_run", "TOP-04,SRC-21", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "event_type", "user_id")


@query("threshold_resolve", "SNK-14", """WITH c AS (SELECT DISTINCT 'Brand' || (p_size % 5)::VARCHAR || '.' || lower(p_type) || '.p' || (p_partkey % 50)::VARCHAR AS component FROM part), l(prefix, level) AS (VALUES ('', 'info'), ('Brand1', 'debug'), ('Brand1.economy', 'error'), ('Brand2.small.p3', 'trace')),
m AS (SELECT component, level, row_number() OVER (PARTITION BY component ORDER BY length(prefix) DESC) AS n FROM c JOIN l ON prefix = '' OR component = prefix OR starts_with(component, prefix || '.')) SELECT component, level FROM m WHERE n = 1""")
def threshold_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.concat(F.lit("Brand"), (F.col("p_size") % 5).cast("string"), F.lit("."), F.lower("p_type"), F.lit(".p"), (F.col("p_partkey") % 50).cast("string")).alias("component")).distinct()
    levels = spark.createDataFrame([("", "info"), ("Brand1", "debug"), ("Brand1.economy", "error"), ("Brand2.small.p3", "trace")], "prefix string, level string")
    return events.threshold(c, F.broadcast(levels))


@query("config_precedence", "SRC-18", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'cli' END, CASE WHEN c_custkey % 5 = 0 THEN 'env' END, CASE WHEN c_custkey % 3 = 0 THEN 'local' END, CASE WHEN c_custkey % 2 = 0 THEN 'shared' END, 'default') AS source FROM customer")
def config_precedence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    layers = [(n, F.when(i % k == 0, i)) for n, k in (("cli", 7), ("env", 5), ("local", 3), ("shared", 2))]
    return table(spark, d, "customer").select("c_custkey", events.precedence([*layers, ("default", F.lit(0))])[1].alias("source"))


@query("durations", "FN-21", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE greatest(0, (event_id % 5 - 1) * 1500 + 250) END::BIGINT AS ms FROM events")
def durations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    end = F.timestamp_micros(1_700_000_000_000_000 + ((i % 5 - 1) * 1500 + 250) * 1000)
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return table(spark, d, "events").select("event_id", events.duration_ms(F.when(i % 6 == 0, "never").otherwise(text(F.timestamp_micros(F.lit(1_700_000_000_000_000)))), text(end)).alias("ms"))


@query("review_budget", "WIN-10", f"""WITH RECURSIVE {FILES_SQL}, c AS (SELECT doc_id % 20 AS g, path, size_bytes, doc_id % 40 = 3 AS pinned, CASE WHEN doc_id % 40 = 3 THEN 0 WHEN doc_id % 9 = 0 THEN 1 WHEN regexp_matches(path, '(^|/)(tests?/|test_[^/]*$)') THEN 4 ELSE 2 END AS prio FROM files),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY prio, path) AS n FROM c), f AS (SELECT DISTINCT g, 0::BIGINT AS n, 0::BIGINT AS used, ''::VARCHAR AS path, false AS taken FROM o
  UNION ALL SELECT o.g, o.n, CASE WHEN o.pinned OR f.used + o.size_bytes <= 20000 THEN f.used + o.size_bytes ELSE f.used END, o.path, o.pinned OR f.used + o.size_bytes <= 20000 FROM f JOIN o ON o.g = f.g AND o.n = f.n + 1) SELECT path, taken FROM f WHERE n > 0""")
def review_budget(spark: SparkSession, d: str) -> DataFrame:
    i, p = F.col("doc_id"), F.col("path")
    prio = F.when(i % 40 == 3, 0).when(i % 9 == 0, 1).when(p.rlike("(^|/)(tests?/|test_[^/]*$)"), 4).otherwise(2)
    c = files(spark, d).select((i % 20).alias("g"), "path", "size_bytes", (i % 40 == 3).alias("pinned"), prio.alias("prio"))
    return budget.greedy(c, ["g"], ["prio", "path"], "size_bytes", 20_000, "pinned").select("path", "taken")


@query("note_overlap", "JOIN-29", R + "SELECT cohort, rep, array_to_string(list_sort(list_intersect(list_distinct(files), ['f1', 'f2'])), ',') AS shared FROM runs WHERE list_has_any(files, ['f1', 'f2'])")
def note_overlap(spark: SparkSession, d: str) -> DataFrame:
    chosen = F.array(F.lit("f1"), F.lit("f2"))
    return runs(spark, d).filter(F.arrays_overlap("files", chosen)).select("cohort", "rep", F.array_join(F.array_sort(F.array_intersect("files", chosen)), ",").alias("shared"))


@query("request_budget", "FN-10", "SELECT conv_id, (sum((strlen(coalesce(text, '')) + 2) // 3) + 512 + 64 + 16 * count(*) + 256)::BIGINT AS total, sum((strlen(coalesce(text, '')) + 2) // 3) + 512 + 64 + 16 * count(*) + 256 <= 4096 AS fits FROM conversations GROUP BY conv_id")
def request_budget(spark: SparkSession, d: str) -> DataFrame:
    t = F.floor((F.octet_length(F.coalesce("text", F.lit(""))) + 2) / 3)
    g = table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(t) + 512 + 64 + 16 * F.count("*") + 256).cast("long").alias("total"))
    return g.withColumn("fits", F.col("total") <= 4096)


@query("final_context", "WF-02", "SELECT user_id, floor(value)::BIGINT % 20 AS file, arg_max(event_type, event_id) AS action FROM events GROUP BY ALL")
def final_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", (F.floor("value").cast("long") % 20).alias("file")).agg(F.max_by("event_type", "event_id").alias("action"))


@query("benchmark_report", "SNK-10", R + "SELECT cohort, coalesce(printf('%.3f', round(sum(CASE WHEN status = 'complete' AND rep % 2 = 1 AND NOT starts_with(cohort, 'view') THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN status = 'complete' AND NOT starts_with(cohort, 'view') THEN 1 ELSE 0 END), 0), 3)), 'n/a') AS rate FROM runs GROUP BY cohort")
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    counts = (F.col("status") == "complete") & ~F.col("cohort").startswith("view")  # a kind of cohort without a denominator
    rate = metrics.quality_rate(F.when(counts & (F.col("rep") % 2 == 1), 1).otherwise(0), F.when(counts, 1).otherwise(0))
    return runs(spark, d).groupBy("cohort").agg(F.coalesce(F.format_number(rate, 3), F.lit("n/a")).alias("rate"))


@query("scan_report", "SNK-06", f"WITH {FILES_SQL} SELECT path, '{{\"path\":\"' || path || '\",\"size_bytes\":' || size_bytes::VARCHAR || '}}' AS json FROM files WHERE size_bytes > 2000")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).filter("size_bytes > 2000").select("path", F.to_json(F.struct("path", "size_bytes"), {"ignoreNullFields": "false"}).alias("json"))


@query("map_inputs_match", "JOIN-36,JOIN-26", f"WITH {FILES_SQL} SELECT path, sha256 = sha256(text) AND doc_id % 6 <> 0 AND size_bytes = strlen(text) AS fresh FROM files")
def map_inputs_match(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", ((F.col("sha256") == F.sha2("text", 256)) & (F.col("doc_id") % 6 != 0) & (F.col("size_bytes") == F.octet_length("text"))).alias("fresh"))


@query("fallback_maps", "UDT-03", f"WITH {FILES_SQL} SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'no_structural_extractor' END AS extractor FROM files")
def fallback_maps(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.when(paths.extension(F.col("path")) == ".py", "python").otherwise("no_structural_extractor").alias("extractor"))
