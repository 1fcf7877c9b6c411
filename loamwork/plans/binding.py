"""Virtual relations of a code repository, derived from the driver's tables (see SURVEY 7.3), with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The task that ranking queries rank for.
TASK = "Trace the server start and the config settings, then find regression tests of item files and the deploy setup"
EXTENSIONS = (".py", ".md", ".json", ".js", ".ts", ".toml", ".txt", ".sql", ".rs", ".xyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, path, size_bytes, sha256, text: a document a file, its path made of its id, source and language."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = (
        F.when(i % 5 == 0, F.concat(F.lit("src/"), "source")).when(i % 5 == 1, F.concat(F.lit("tests/"), "source")).when(i % 5 == 2, F.concat(F.lit("docs/"), "lang"))
        .when(i % 5 == 3, F.concat(F.lit("lib/"), "source", F.lit("/"), "lang")).otherwise("public")
    )
    stem = F.when(i % 7 == 0, "test_").when(i % 7 == 1, "config_").otherwise("item_")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 10 + 1).cast("int"))
    return d.select("doc_id", "source", F.concat(folder, F.lit("/"), stem, i.cast("string"), ext).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), "text")


FILES_SQL = f"""files AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src/' || source WHEN 1 THEN 'tests/' || source WHEN 2 THEN 'docs/' || lang WHEN 3 THEN 'lib/' || source || '/' || lang ELSE 'public' END
    || '/' || CASE doc_id % 7 WHEN 0 THEN 'test_' WHEN 1 THEN 'config_' ELSE 'item_' END || doc_id::VARCHAR
    || [{", ".join(f"'{x}'" for x in EXTENSIONS)}][(doc_id % 10 + 1)::INT] AS path,
    strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256, text
  FROM documents
)"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current) file states: path, sha256, size_bytes, language number, status, analyzer."""
    f = files(spark, sf_dir).drop("text")
    i = F.col("doc_id")
    lang = F.when(i % 10 == 9, F.lit(None)).otherwise(i % 10)
    status = F.when(i % 17 == 0, "failed").when(i % 17 == 1, "partial").otherwise("complete")
    f = f.withColumn("language", lang).withColumn("status", status)
    was = f.filter(i % 7 != 0).withColumn("sha256", F.when(i % 11 == 0, F.sha2(F.concat("sha256", F.lit("~")), 256)).otherwise(F.col("sha256"))).withColumn("analyzer", F.when(i % 19 == 0, "v1").otherwise("v2"))
    return was, f.filter(i % 13 != 0)


STATES_SQL = f"""{FILES_SQL},
base AS (SELECT doc_id, path, size_bytes, sha256, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE doc_id % 10 END AS language, CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 17 = 1 THEN 'partial' ELSE 'complete' END AS status FROM files),
prev AS (SELECT doc_id, path, size_bytes, CASE WHEN doc_id % 11 = 0 THEN sha256(sha256 || '~') ELSE sha256 END AS sha256, language, status, CASE WHEN doc_id % 19 = 0 THEN 'v1' ELSE 'v2' END AS analyzer FROM base WHERE doc_id % 7 <> 0),
cur AS (SELECT * FROM base WHERE doc_id % 13 <> 0)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, start, stop: line ranges of a user's events."""
    e = table(spark, sf_dir, "events")
    start = F.hour("ts").cast("long") * 5 + 1
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), start.alias("start"), (start + F.floor("value").cast("long") % 3).alias("stop"))


RANGES_SQL = "ranges AS (SELECT 'u/' || user_id::VARCHAR AS path, hour(ts) * 5 + 1 AS start, hour(ts) * 5 + 1 + floor(value)::BIGINT % 3 AS stop FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: task, cohort, rep, status, duration_ms, files (ordered array), confidence, fallback."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.col("user_id") % 3).orderBy("event_id")
    v = F.floor("value").cast("long")
    return e.select(
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("cohort"), F.row_number().over(w).cast("long").alias("rep"),
        F.when(F.col("event_id") % 9 == 0, "failed").otherwise("complete").alias("status"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.array(*(F.concat(F.lit("f"), (m % (2 + F.col("user_id") % 3)).cast("string")) for m in (v, v + 1, F.floor(v / 2) + F.col("user_id")))).alias("files"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise((v % 100) / F.lit(100.0)).alias("confidence"), (F.col("event_id") % 4 == 0).alias("fallback"),
    )


RUNS_SQL = """runs AS (
  SELECT event_type || '-' || (user_id % 3)::VARCHAR AS cohort, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS rep,
    CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'complete' END AS status, floor(value * 10)::BIGINT AS duration_ms,
    ['f' || (floor(value)::BIGINT % (2 + user_id % 3))::VARCHAR, 'f' || ((floor(value)::BIGINT + 1) % (2 + user_id % 3))::VARCHAR, 'f' || ((floor(floor(value)::BIGINT / 2)::BIGINT + user_id) % (2 + user_id % 3))::VARCHAR] AS files,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE (floor(value)::BIGINT % 100) / 100.0::DOUBLE END AS confidence, event_id % 4 = 0 AS fallback
  FROM events
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, source, target: parts import suppliers, orders call parts, suppliers are contained in nations."""
    line = table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    imports = line.select(F.lit("import").alias("kind"), name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"))
    calls = line.select(F.lit("call").alias("kind"), name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target"))
    held = table(spark, sf_dir, "supplier").select(F.lit("contains").alias("kind"), name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target"))
    return imports.unionByName(calls).unionByName(held).distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'import' AS kind, 'p' || l_partkey::VARCHAR AS source, 's' || l_suppkey::VARCHAR AS target FROM lineitem
    UNION ALL SELECT 'call', 'o' || l_orderkey::VARCHAR, 'p' || l_partkey::VARCHAR FROM lineitem
    UNION ALL SELECT 'contains', 'n' || s_nationkey::VARCHAR, 's' || s_suppkey::VARCHAR FROM supplier
  )
)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """operation, seq, event, value, ts: a user's events in order."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("operation"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_type").alias("event"), "value", "ts")


PROGRESS_SQL = "progress AS (SELECT user_id AS operation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS event, value, ts FROM events)"
