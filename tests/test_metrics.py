"""The hand-computed example of three runs."""

import pytest
from pyspark.sql import functions as F

from loamwork.operators import metrics

RUNS = "cohort string, rep long, status string, duration_ms long, files array<string>, confidence double, fallback boolean"
THREE = [("c", 1, "complete", 10, ["a.py", "b.py"], 0.6, False), ("c", 2, "complete", 20, ["b.py", "a.py"], 0.8, True), ("c", 3, "complete", 40, ["a.py", "c.py"], 1.0, False)]


def test_three_runs(spark):
    runs = spark.createDataFrame([*THREE, ("c", 4, "failed", 999, [], None, False)], RUNS)
    c = metrics.cohorts(runs).first()
    assert (c.n_total, c.n_complete, c.n_pairs, c.stability, c.p50_ms, c.p90_ms, c.p95_ms, c.min_ms, c.max_ms) == (4, 3, 3, "semantic_stability", 20, 40, 40, 10, 40)
    assert c.mean_ms == pytest.approx(70 / 3)
    p = metrics.pair_rates(runs).first()
    assert (p.exact_set, p.exact_order, p.jaccard) == (pytest.approx(1 / 3), 0, pytest.approx(5 / 9))
    s = metrics.confidence(runs).first()
    assert (s.mean, s["least"], s.most, s.spread) == (0.8, 0.6, 1.0, 0.4)
    ok = F.col("status") == "complete"
    found = F.size(F.array_intersect("files", F.array(F.lit("a.py"), F.lit("b.py"))))
    recall = runs.filter(ok).agg(metrics.quality_rate(found, F.lit(2)).alias("r")).first()["r"]
    assert recall == pytest.approx(5 / 6)
    told = {r.rep: r for r in metrics.evaluate(runs.filter(ok), ["a.py", "b.py"], [["b.py", "z"]], ["x.py"]).collect()}
    assert told[1].passed and told[3].missing == "b.py" and not told[3].passed


def test_one_run_and_fallback_runs(spark):
    one = spark.createDataFrame(THREE[:1], RUNS)
    c = metrics.cohorts(one).first()
    assert (c.stability, c.p50_ms, c.n_pairs, c.mean_ms) == ("insufficient_data", None, 0, 10)
    assert metrics.pair_rates(one).first().jaccard is None
    two = spark.createDataFrame([("c", i, "complete", 1, [], None, True) for i in (1, 2)], RUNS)
    assert metrics.cohorts(two).first().stability == "deterministic_fallback_repeatability"
    assert metrics.pair_rates(two).first().jaccard == 1.0
    assert metrics.confidence(two).first()["mean"] is None
    assert one.limit(0).agg(metrics.quality_rate(F.lit(1), F.lit(1)).alias("r")).first()["r"] is None


def test_penalties_and_confidence(spark):
    w = spark.createDataFrame([("stale-index", "warning", 0.3), ("incomplete-parse-data", "info", None), ("other", "warning", 1.0)], "code string, severity string, c double")
    got = [r[0] for r in w.select(metrics.penalty(F.col("code"), F.col("severity"), F.col("c"))).collect()]
    assert got == [pytest.approx(0.24), pytest.approx(0.02), pytest.approx(0.1)]
    one = spark.range(1).select(metrics.result_confidence(F.lit(0.8), F.array(F.lit(0.5), F.lit(2.0)), F.lit(False), F.lit(True)).alias("x")).first()["x"]
    assert one == pytest.approx(0.8 * 0.35 * 0.85 * 0.5 * 0.1)
