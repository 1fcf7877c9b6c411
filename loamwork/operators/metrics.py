"""Benchmark metrics: cohorts, pairs of runs, budgets, expectations, warnings, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import fixed


def grid(tasks: DataFrame, modes: list[str], repeat: int) -> DataFrame:
    """A run a task, mode and repetition."""
    return tasks.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repeat).cast("long"))))


def cohorts(runs: DataFrame) -> DataFrame:
    """cohort -> total, complete, pairs, stability, mean and range of durations, nearest-rank percentiles (from two on)."""
    ok = F.col("status") == "complete"
    d = F.when(ok, F.col("duration_ms"))
    n = F.count_if(ok)
    pct = lambda p: F.when(n >= 2, F.expr(f"percentile_disc({p}) within group (order by case when status = 'complete' then duration_ms end)")).cast("long")
    kind = F.when(n < 2, "insufficient_data").when(F.bool_and(F.when(ok, F.col("fallback"))), "deterministic_fallback_repeatability").otherwise("semantic_stability")
    return runs.groupBy("cohort").agg(
        F.count("*").alias("n_total"), n.alias("n_complete"), (n * (n - 1) / 2).cast("long").alias("n_pairs"), kind.alias("stability"), F.avg(d).alias("mean_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"),
        *(pct(p).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.9, 0.95)),
    )


def confidence(runs: DataFrame) -> DataFrame:
    """cohort -> mean, least, most and spread of the known confidences of complete runs; null if there is none."""
    c = F.when(F.col("status") == "complete", F.col("confidence"))
    return runs.groupBy("cohort").agg(F.round(F.avg(c), 12).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.max(c) - F.min(c), 12).alias("spread"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def pair_rates(runs: DataFrame) -> DataFrame:
    """cohort -> over all unordered pairs of complete runs: the share of equal sets and of equal sequences of files, and
    the mean Jaccard similarity; null without pairs.

    Runs with the same files are one variant with a count, so that pairs are of variants: a cohort of any size has few
    of those if it is stable at all.
    """
    v = runs.filter("status = 'complete'").withColumn("s", F.array_sort(F.array_distinct("files"))).groupBy("cohort", "files", "s").agg(F.count("*").alias("n"))
    a, b = v.alias("a"), v.alias("b")
    order = lambda t: F.col(f"{t}.files")
    both = a.join(b, (F.col("a.cohort") == F.col("b.cohort")) & (order("a") <= order("b")))
    same = order("a") == order("b")
    n = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    set_same = F.col("a.s") == F.col("b.s")
    rows = both.select(F.col("a.cohort").alias("cohort"), n.alias("n"), set_same.alias("e"), same.alias("o"), jaccard(F.col("a.s"), F.col("b.s")).alias("j"))
    part = lambda x: F.try_divide(F.sum(x), F.sum("n"))
    out = rows.groupBy("cohort").agg(part(F.when(F.col("e"), F.col("n")).otherwise(0.0)).alias("exact_set"), part(F.when(F.col("o"), F.col("n")).otherwise(0.0)).alias("exact_order"), part(F.col("j") * F.col("n")).alias("jaccard"))
    return out.select("cohort", *(F.round(c, 9).alias(c) for c in ("exact_set", "exact_order", "jaccard")))


def quality_rate(numerator: Column, denominator: Column) -> Column:
    """A ratio of sums; null, not 1, on nothing."""
    return F.try_divide(F.sum(numerator), F.sum(denominator))


def evaluate(runs: DataFrame, required: list[str], any_of: list[list[str]], forbidden: list[str]) -> DataFrame:
    """runs with missing (sorted, joined), n_forbidden and passed."""
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    f = F.col("files")
    missing, bad = F.array_except(arr(required), f), F.array_intersect(f, arr(forbidden))
    groups = reduce(Column.__and__, (F.arrays_overlap(f, arr(g)) for g in any_of), F.lit(True))
    return runs.select("*", F.array_join(F.array_sort(missing), ",").alias("missing"), F.size(bad).cast("long").alias("n_forbidden"), ((F.size(missing) == 0) & groups & (F.size(bad) == 0)).alias("passed"))


def within(actual: dict[str, Column], limits: dict[str, int | None]) -> Column:
    """Whether every actual stays within its limit; a limit of None is none."""
    return reduce(Column.__and__, (actual[k] <= v for k, v in limits.items() if v is not None), F.lit(True))


def canonical_warnings(warnings: DataFrame) -> DataFrame:
    """(code, path, related, message, ordinal): the last record of each (code, path, related) holds."""
    return warnings.groupBy("code", "path", "related").agg(F.max_by("message", "ordinal").alias("message"))


def warning_groups(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings as one a key: records, records without a path, and the distinct paths and related paths, counted."""
    return warnings.groupBy(*keys).agg(F.count("*").alias("n_records"), F.count_if(F.col("path").isNull()).alias("n_pathless"), F.count_distinct("path").alias("n_paths"), F.count_distinct("related").alias("n_related"))


def penalty(code: Column, severity: Column, confidence_: Column) -> Column:
    """What a warning takes from a result's confidence: by its code, half if it only informs, times its own confidence
    (a half if unknown)."""
    base = F.lit(fixed.OTHER_PENALTY)
    for name, value in fixed.CODE_PENALTIES.items():
        base = F.when(code == name, value).otherwise(base)
    heavy = reduce(Column.__or__, (F.contains(code, F.lit(p)) for p in fixed.HEAVY_CODE_PARTS))
    base = F.when(heavy, fixed.HEAVY_PENALTY).otherwise(base)
    return base * F.when(severity == "info", 0.5).otherwise(1.0) * F.coalesce(confidence_, F.lit(0.5))


def result_confidence(base: Column, penalties: Column, verified: Column, fallback: Column) -> Column:
    """base, times 0.35 if unverified, 0.85 if fallback, and 1 - penalty (0.9 at most) of each code in the array's order;
    within 0 and 1."""
    start = base * F.when(verified, 1.0).otherwise(0.35) * F.when(fallback, 0.85).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(penalties, start, lambda a, p: a * (1 - F.least(F.lit(0.9), p)))))


def model_calls(counts: DataFrame, files_per_call: int, summaries_per_call: int) -> DataFrame:
    """(package, n) -> one row: calls for the packages' files, two more, and for reducing summaries until one is left."""
    first = counts.agg(F.sum(F.ceil(F.col("n") / files_per_call)).cast("long").alias("c"))
    step = lambda a, _: F.when(a["n"] > 1, F.struct(F.ceil(a["n"] / summaries_per_call).cast("long").alias("n"), (a["calls"] + F.ceil(a["n"] / summaries_per_call)).cast("long").alias("calls"))).otherwise(a)
    return first.select((F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.col("c").alias("n"), F.col("c").alias("calls")), step)["calls"] + 2).cast("long").alias("calls"))
