"""Resolution, review, views and sessions on small hand-made repositories."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.operators import budget, codemap, resolve, review, session

IMPORTS = "path string, n int, level int, module string, name string, alias string, inside string"
CALLS = "path string, symbol string, observed string, shadowed boolean, params array<string>"
SYMBOLS = "path string, symbol string, name string, parent string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_imports_resolve_by_package_level_and_uniqueness(spark):
    files = frame(spark, [(p,) for p in ("pkg/__init__.py", "pkg/app.py", "pkg/impl.py", "src/pkg2/shared.py", "lib/pkg2/shared.py", "src/pkg2/use.py", "notes.md")], "path string")
    rows = [
        ("pkg/app.py", 1, 1, "impl", "helper", "run_helper", None), ("pkg/app.py", 2, 0, "external.library", None, "library", None), ("pkg/app.py", 3, 1, None, "impl", None, None),
        ("pkg/app.py", 4, 3, "impl", None, None, None), ("pkg/__init__.py", 5, 1, "impl", "*", None, None), ("src/pkg2/use.py", 6, 0, "pkg2.shared", "value", None, None),
        ("src/pkg2/use.py", 7, 1, "missing", None, None, None), ("src/pkg2/use.py", 8, 0, "src.pkg2.shared", None, None, None), ("pkg/app.py", 9, 0, "pkg", None, None, None),
    ]
    got = {r.n: (r.resolution, r.target) for r in resolve.imports(frame(spark, rows, IMPORTS), files).collect()}
    assert got == {
        1: ("internal", "pkg/impl.py"), 2: ("external", None), 3: ("unresolved", None), 4: ("unresolved", None), 5: ("internal", "pkg/impl.py"), 6: ("unresolved", None),
        7: ("unresolved", None), 8: ("internal", "src/pkg2/shared.py"), 9: ("internal", "pkg/__init__.py"),
    }


def test_calls_follow_aliases_scopes_and_unique_symbols(spark):
    facts = [("a.py", 1, 0, "b", "helper", "h", None), ("a.py", 2, 0, "c", None, None, None), ("a.py", 3, 0, "d.e", None, None, None), ("a.py", 4, 0, "b", None, "bee", "a#other"), ("a.py", 5, 0, "b", "twice", None, None)]
    files = frame(spark, [("a.py",), ("b.py",), ("c.py",), ("d/e.py",)], "path string")
    symbols = frame(spark, [("b.py", "b#helper", "helper", None), ("b.py", "b#C.m", "m", "b#C"), ("b.py", "b#t1", "twice", None), ("b.py", "b#t2", "twice", None), ("c.py", "c#go", "go", None), ("d/e.py", "e#go", "go", None)], SYMBOLS)
    observed = {"h": "b#helper", "helper": None, "c.go": "c#go", "c.x.go": None, "d.e.go": "e#go", "e.go": None, "bee.helper": None, "twice": None, "m": None, "dyn": None}
    calls = [("a.py", "a#f", o, False, ["p"]) for o in observed] + [("a.py", "a#other", "bee.helper", False, []), ("a.py", "a#g", "h", True, []), ("a.py", "a#k", "h", False, ["h"])]
    got = {(r.symbol, r.observed): r.target_symbol for r in resolve.imported_calls(frame(spark, calls, CALLS), resolve.imports(frame(spark, facts, IMPORTS), files), symbols).collect()}
    assert got == {("a#f", o): t for o, t in observed.items()} | {("a#other", "bee.helper"): "b#helper", ("a#g", "h"): None, ("a#k", "h"): None}


def test_tests_link_by_import_and_by_name(spark):
    files = frame(spark, [("src/pkg/service.py", "parsed"), ("tests/test_service.py", "parsed"), ("util.py", "parsed"), ("tests/util_test.py", "parsed"), ("tests/test_both.py", "parsed"), ("a/both.py", "parsed"), ("b/both.py", "parsed"), ("tests/test_bad.py", "partial"), ("bad.py", "parsed"), ("tests/test_worse.py", "parsed"), ("worse.py", "partial")], "path string, status string")
    imports = frame(spark, [("tests/test_service.py", "internal", "src/pkg/service.py"), ("tests/test_service.py", "internal", "util.py"), ("tests/test_service.py", "external", None)], "path string, resolution string, target string")
    calls = frame(spark, [("tests/test_service.py", "src/pkg/service.py", "s#run"), ("util.py", "a/both.py", "x"), ("tests/test_service.py", None, None)], "path string, target_path string, target_symbol string")
    got = {(r.kind, r.source, r.target, r.method.split("_")[1]) for r in resolve.test_links(files, imports, calls).collect()}
    forth = {("tests/test_service.py", "src/pkg/service.py", "unambiguous"), ("tests/test_service.py", "util.py", "unambiguous"), ("tests/util_test.py", "util.py", "test")}
    assert got == {("tests", a, b, m) for a, b, m in forth} | {("tested_by", b, a, m) for a, b, m in forth} | {("test_reference", "tests/test_service.py", "s#run", "resolved")}


def test_review_names_what_a_selection_lacks(spark):
    selected = frame(spark, [("core.py",), ("gone.py",)], "path string")
    edges = frame(spark, [("use.py", "core.py"), ("core.py", "base.py"), ("core.py", "gone.py"), ("other.py", "use.py")], "source string, target string")
    rows = [tuple(r) for r in review.neighbours(selected, edges, "in").collect()] + [tuple(r) for r in review.neighbours(selected, edges, "out", "target", "source").collect()]
    assert sorted(rows) == [("in", "core.py", "base.py", 0.6), ("out", "core.py", "use.py", 0.6)]
    many = frame(spark, [(f"f{i:03d}.py", "K") for i in range(120)] + [("core.py", "K"), ("core.py", "L"), ("z.py", "L")], "path string, key string")
    (only,) = review.consumers(selected, many).collect()
    assert only.path == "core.py" and only.related.split(",") == [f"f{i:03d}.py" for i in range(50)]
    states = review.states(selected, frame(spark, [("core.py", "partial")], "path string, status string"), frame(spark, [("core.py", 2)], "path string, n long"), frame(spark, [("core.py", 0.3), ("core.py", 0.1)], "path string, confidence double"))
    assert {(r.code, r.path, r.confidence) for r in states.collect()} == {("structural-record-unavailable", "gone.py", 0.2), ("incomplete-parse-data", "core.py", 0.2), ("dynamic-or-unresolved-calls", "core.py", 0.35), ("semantic-uncertainty", "core.py", 0.1)}
    touched, none = frame(spark, [("core.py",), ("new.py",)], "path string"), frame(spark, [], "path string")
    assert {(r.code, r.related) for r in review.overall(selected, touched, none, none, True).collect()} == {("diff-file-omitted", "new.py"), ("documentation-not-selected", "")}
    assert {r.code for r in review.overall(selected, None, selected, selected, False).collect()} == {"stale-index-coverage", "structural-coverage-limitations", "indexed-source-not-read"}
    assert review.overall(selected.limit(0), touched.limit(0), none, none, True).count() == 0


@pytest.mark.parametrize("at_once", [3, 1000])
def test_greedy_over_a_whole_table(spark, at_once):
    rng = random.Random(4)
    rows = [(i, rng.choice((0, 1, 3, 9, 40, 200))) for i in range(300)]
    want, left = set(), 150
    for i, n in sorted(rows, key=lambda r: -r[0]):
        if n <= left:
            want, left = want | {i}, left - n
    assert {r.i for r in budget.greedy_all(frame(spark, rows, "i long, n long"), [-F.col("i")], "n", 150, at_once).collect()} == want
    assert budget.greedy_all(frame(spark, [], "i long, n long"), [F.col("i")], "n", 5).count() == 0


def test_views_are_cut_and_say_so(spark):
    files = frame(spark, [("a",), ("b",)], "path string")
    symbols = frame(spark, [("a", f"s{i:02d}", "x" * 200) for i in range(30)] + [("b", "s", "short")], "path string, symbol string, signature string")
    edges = frame(spark, [("a", "import", f"t{i:02d}") for i in range(40)], "path string, kind string, target string")
    got = {r.path: r for r in codemap.projection(files, symbols, edges).collect()}
    assert len(got["a"].symbols.split(",")) == 24 and len(got["a"].relationships.split(",")) == 32 and got["a"].kinds == "import=40" and got["a"].truncated
    assert (got["b"].symbols, got["b"].relationships, got["b"].truncated) == ("s=short", "", False) and got["a"].symbols.split(",")[0] == "s00=" + "x" * 160
    part = {"symbols": (symbols, F.col("symbol")), "imports": (edges, F.col("target")), "exports": (symbols.limit(0), F.col("symbol"))}
    sizes = [[len(r.symbols.split(",")), r.truncated] for k in (0, 2, 9) for r in codemap.compact(files.limit(1), part, k).collect()]
    assert sizes == [[30, False], [25, True], [1, True]]


def test_records_are_canonical(spark):
    symbols = frame(spark, [("a", "s2", "n"), ("a", "s1", 'q"')], "path string, symbol string, name string")
    r = codemap.serialise(frame(spark, [("a", "parsed"), ("b", None)], "path string, status string"), symbols)
    told = {x.path: x.record for x in r.collect()}
    assert told["b"] == '{"schema_version":1,"path":"b","status":null,"symbols":[]}'
    bad = [("a", told["a"].replace(":1,", ": 1,")), ("a", told["b"]), ("c", '{"schema_version":2,"path":"c","status":null,"symbols":[]}'), ("d", "nonsense"), ("e", '{"schema_version":1,"path":"e","status":null,"symbols":[],"more":1}'), ("f", None)]
    assert all(x.valid for x in codemap.deserialise(r).collect()) and not any(x.valid for x in codemap.deserialise(frame(spark, bad, "path string, record string")).collect())


def test_session_tools_and_context_actions(spark):
    tools = {"list": session.Tool({"n": int}, lambda n: spark.range(n), most=3)}
    got = session.execute(tools, [("list", {"n": 2}), ("list", {"n": 9}), ("list", {"n": True}), ("list", {}), ("drop", {})])
    assert [(o.ok, o.code, o.n_rows, o.truncated) for o in got] == [(True, "ok", 2, False), (True, "ok", 3, True), (False, "wrong_type", 0, False), (False, "invalid_arguments", 0, False), (False, "unknown_tool", 0, False)]
    rows = [("add", "a", 5), ("add", "a", 5), ("add", "x", 1), ("add", "b", 90), ("add", "b", 9), ("add", "c", 1), ("add", "p", 1), ("remove", "p", 1), ("remove", "a", 5), ("remove", "a", 5), ("add", "c", 1), ("rename", "c", 1)]
    schema = "session long, seq long, action string, path string, size long, pinned boolean, excluded boolean"
    d = frame(spark, [(1, k, a, p, n, p == "p", p == "x") for k, (a, p, n) in enumerate(rows)], schema)
    told = [(r.outcome, r.used) for r in session.context_actions(d.union(d.withColumn("session", F.lit(2))), 2, 20).orderBy("session", "seq").collect()]
    want = [("added", 5), ("unchanged", 5), ("excluded", 5), ("rolled_back", 5), ("added", 14), ("rolled_back", 14), ("added", 15), ("pinned", 15), ("removed", 10), ("unchanged", 10), ("rolled_back", 10), ("invalid", 10)]
    assert told == want * 2
