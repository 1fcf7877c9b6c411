"""Sources, publication, extraction, responses, patterns and streams on small fixtures."""

import fnmatch
import itertools
import json
import os
import random
import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.functions import fixed, paths, text
from loamwork.operators import budget, events, excerpt, extract, rank, responses, select
from loamwork.sources import documents, publish, repository


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.py", ["a.py", "x/y/a.py"], ["a.pyc", "py"]), ("src/*.py", ["src/a.py"], ["src/x/a.py", "y/src/a.py"]), ("src/**/a", ["src/a", "src/x/y/a", "src/a/b"], ["srca"]),
        ("**/t", ["t", "x/t"], ["xt"]), ("d/**", ["d/x", "d/x/y"], ["e/d"]), ("a?[0-2]", ["ab1", "x/ab2"], ["a/1", "ab3"]), ("[!a]b", ["cb"], ["ab", "/b"]), ("build/", ["build/x", "y/build/z"], ["build"]), ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_glob(pattern, yes, no):
    regex = re.compile(select._gitwild(pattern))
    assert all(regex.search(x) for x in yes) and not any(regex.search(x) for x in no)


def test_glob_refuses_what_is_not_relative():
    for bad in ("/a", "!a", "a/../b", ""):
        with pytest.raises(ValueError):
            select.glob_regex(bad)


@settings(max_examples=300, deadline=None)
@given(st.text("ab/.*?[]!-", max_size=7), st.text("ab/.", max_size=7))
def test_fnmatch(pattern, name):
    assert bool(re.match(select.fnmatch_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def _tree(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_repository_scan(spark, tmp_path):
    _tree(tmp_path, {
        "src/a.py": b"x = 1\r\n", "src/b.bin": b"\x00\x01", "src/bad.txt": b"\xff\xfe", "big.md": b"#" * 2000, "build/out.py": b"", "docs/.gitignore": b"*.txt\n!keep.txt\n", "docs/n.txt": b"n", "docs/keep.txt": b"k",
        ".git/config": b"c", "src/.GIT/x": b"x", ".gitignore": b"*.log\ndocs/secret/\n", "x.log": b"l", "docs/secret/keep.txt": b"s", "empty": b"", "tool.ignore/z": b"",
    })
    os.symlink(tmp_path / "big.md", tmp_path / "link.md")
    got = {k: {tuple(r) for r in v.collect()} for k, v in repository.scan(spark, str(tmp_path), max_bytes=1000).items()}
    assert {r[0] for r in got["files"]} == {"src/a.py", "docs/.gitignore", "docs/keep.txt", ".gitignore", "empty", "tool.ignore/z"}
    assert got["skipped"] == {("src/b.bin", "binary"), ("src/bad.txt", "invalid_encoding"), ("big.md", "too_large"), ("link.md", "symlink")}
    assert {(p, s) for p, s, _ in got["ignored"]} == {("build/out.py", "default"), ("docs/n.txt", "gitignore"), (".git/config", "protected"), ("src/.GIT/x", "protected"), ("x.log", "gitignore"), ("docs/secret/keep.txt", "gitignore")}
    files = repository.scan(spark, str(tmp_path), max_bytes=1000)["files"].filter("path = 'src/a.py'").select("path", "sha256")
    kept = spark.createDataFrame([tuple(r) for r in files.collect()], "path string, sha256 string")
    assert repository.verified_texts(str(tmp_path), kept).first()["text"] == "x = 1\n"
    (tmp_path / "src/a.py").write_bytes(b"y")
    with pytest.raises(Exception, match="changed since"):
        repository.verified_texts(str(tmp_path), kept).collect()
    with pytest.raises(FileNotFoundError):
        repository.validate_root(str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        repository.validate_root(str(tmp_path / "empty"))


def test_git_changes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@x.org", *a], check=True, capture_output=True)
    git("init", "-q")
    _tree(tmp_path, {"a": b"1", "b": b"1", "c": b"1"})
    git("add", ".")
    git("commit", "-qm", "x")
    _tree(tmp_path, {"a": b"2", "n": b"1"})
    (tmp_path / "b").unlink()
    assert {(r.path, r.status) for r in repository.git_changes(spark, str(tmp_path)).collect()} == {("a", "modified"), ("b", "deleted"), ("n", "untracked")}
    assert [tuple(r) for r in repository.git_changes(spark, str(tmp_path), base="no-such").collect()] == [(None, None, False)]


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    one = publish.publish({"files": df}, str(tmp_path))
    assert publish.publish({"files": df.orderBy(F.desc("id"))}, str(tmp_path)) == one
    two = publish.publish({"files": df.limit(1)}, str(tmp_path))
    assert two != one and publish.load(spark, str(tmp_path), "files").count() == 1 and publish.load(spark, str(tmp_path), "files", one).count() == 2
    manifest = tmp_path / "generations" / two / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"files": "1:', '"files": "9:'))
    with pytest.raises(ValueError, match="manifest"):
        publish.load(spark, str(tmp_path), "files")
    with publish.writer_lock(str(tmp_path)), pytest.raises(publish.Locked):
        publish.publish({"files": df}, str(tmp_path))
    (tmp_path / "lock").write_text(json.dumps({"pid": 2**22 + 1, "host": __import__("socket").gethostname(), "nonce": "x"}))
    with pytest.raises(publish.Locked), publish.writer_lock(str(tmp_path)):
        pass
    with publish.writer_lock(str(tmp_path), recover=True):
        pass
    assert publish.clean(str(tmp_path)) == [one]
    publish.write_atomic(str(tmp_path / "f"), b"1")
    with pytest.raises(FileExistsError):
        publish.write_atomic(str(tmp_path / "f"), b"2")
    publish.write_atomic(str(tmp_path / "f"), b"2", force=True)
    assert (tmp_path / "f").read_bytes() == b"2" and not list(tmp_path.glob(".f*"))
    assert publish.append_summary(str(tmp_path), {"operation_id": "o"}) and not publish.append_summary(str(tmp_path), {})


def test_strict_documents(tmp_path):
    fields = {"schema_version": int, "files": list}
    assert documents.strict_json(b'{"schema_version":1,"files":[]}', 100, fields)["files"] == []
    for data, code in ((b"[]", "not_an_object"), (b'{"files":[],"files":[],"schema_version":1}', "duplicate_key"), (b'{"schema_version":1,"files":NaN}', "non_finite_number"), (b"\xff", "invalid_encoding"), (b"{", "invalid_json"), (b'{"schema_version":2,"files":[]}', "unsupported_version"), (b'{"schema_version":true,"files":[]}', "wrong_type"), (b'{"files":[]}', "missing_field"), (b" " * 200, "too_large")):
        with pytest.raises(documents.DocumentError) as e:
            documents.strict_json(data, 100, fields)
        assert e.value.code == code
    assert documents.pointer_values({"a": [{"b": 1}, {"b": 2}], "c~/": {"x": 3}}, "/a/*/b") == [1, 2]
    assert documents.pointer_values({"c~/": {"x": 3}}, "/c~0~1/*") == [3]
    assert documents.json_shape({"a": [1, 2, "x", None], "b": True}) == {"a": ["integer", "string", "null"], "b": "boolean"}
    (tmp_path / "config.toml").write_text("size = 3\nname = 'shared'\n")
    (tmp_path / "config.local.toml").write_text("name = 'local'\n")
    got = documents.settings(str(tmp_path), {"size": 1, "name": "d", "rate": 0.5, "mode": "m"}, {"LOAMWORK_RATE": "0.75"}, command_line={"mode": "cli"})
    assert got == {"size": (3, "shared"), "name": ("local", "local"), "rate": (0.75, "environment"), "mode": ("cli", "command line")}


def test_python_facts():
    code = '"""Doc."""\nimport os as o\nfrom . import x\n__all__ = ["C"]\nLIMIT = 3\nclass C(Base):\n    async def m(self, a: int) -> int:\n        if a:\n            raise ValueError("no")\n        return self.n(a)\ndef f():\n    def g():\n        pass\n'
    rows = {(k, q): (p, a, b, d) for k, _, q, p, a, b, d in extract.python_facts(code)}
    assert rows["class", "C"] == (None, 6, 10, "Base") and rows["method", "C.m"] == ("C", 7, 10, "async (self, a: int) -> int")
    assert rows["function", "f.g"][0] == "f" and rows["import", "os"][3] == "o" and ("import", ".x") in rows
    assert ("export", "C") in rows and ("constant", "LIMIT") in rows and ("raise", "C.m.ValueError") in rows and ("call", "C.m.self.n") in rows and rows["docstring", "module"][3] == "Doc."
    (bad,) = extract.python_facts("def (")
    assert bad[:2] == ("diagnostic", "syntax_error")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", max_size=9), max_size=12), st.integers(1, 60), st.lists(st.integers(1, 12), max_size=3))
def test_excerpt_is_bounded_and_ordered(lines, limit, declared):
    source = "\n".join(lines)
    got, ranges, cut = excerpt.excerpt(source, declared, limit)
    assert len(got.encode()) <= limit and cut == (len(source.encode()) > limit)
    assert all(a <= b for a, b in ranges) and all(b + 1 < c for (_, b), (c, _) in itertools.pairwise(ranges))
    if not cut:
        assert got == source


def _answer(prompt, attempt):
    return '{"paths": ["%s"]}' % prompt if attempt >= 3 else "no json"


def test_scripted_provider(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    got = responses.ask(asked, _answer, responses.Contract({"paths": list})).collect()
    assert [(r.ok, r.used, r.json) for r in got] == [(True, 3, '{"paths":["a"],"schema_version":1}'), (True, 3, '{"paths":["b"],"schema_version":1}')]
    assert not any(r.ok for r in responses.ask(asked, _answer, responses.Contract({"paths": list}), attempts=2).collect())


def test_facets():
    got = rank.facets("Trace the server start, the config settings and then find regression tests plus deploy setup, more things here")
    assert [f.label for f in got] == ["application startup", "configuration", "relevant tests/files", "deploy setup"]
    assert rank.facets("the")[0].label == "task"


def test_ranges_and_lines(spark):
    r = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", 6, 6), ("a", 6, 6), ("a", 2, 3), ("b", 1, 9), ("b", 2, 3)], "path string, start long, stop long")
    assert sorted(map(tuple, select.merge_ranges(r, ["path"]).select("path", "start", "stop").collect())) == [("a", 1, 4), ("a", 6, 6), ("b", 1, 9)]
    t = spark.createDataFrame([("a\nb\nc",), ("a\nb\n",), ("",), ("a",)], "t string")
    got = [tuple(x) for x in t.select(select.slice_lines(F.col("t"), F.lit(2), F.lit(2)), text.line_count(F.col("t"))).collect()]
    assert got == [("b\n", 3), ("b\n", 2), (None, 0), (None, 1)]


def test_greedy_budget_equals_fold(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 50), rng.random() < 0.1) for g in range(5) for i in range(100)]
    got = {(r.g, r.i): r.taken for r in budget.greedy(spark.createDataFrame(rows, "g long, i long, size long, pin boolean"), ["g"], ["i"], "size", 300, "pin").collect()}
    for g in range(5):
        used = 0
        for _, i, size, pin in (r for r in rows if r[0] == g):
            fits = pin or used + size <= 300
            used += size * fits
            assert got[g, i] == fits


def test_paths(spark):
    names = ["src/pkg/a.py", "tests/unit/test_a.py", "tests/x.js", "Makefile", "a.tar.gz", ".env", "x/.env.example", "src", "lib/b/c.spec.ts", "q_test.py", "noext", "x/README"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    p = F.col("path")
    got = {r.path: r for r in df.select("path", paths.language(p).alias("lang"), paths.package_key(p).alias("key"), paths.is_test_strict(p).alias("s"), paths.is_test_any(p).alias("m"), paths.is_test_ranked(p).alias("r"), paths.extension(p).alias("e")).collect()}
    assert [got[n].lang for n in names] == ["Python", "Python", "JavaScript", "Makefile", None, "Dotenv", "Dotenv template", None, "TypeScript", "Python", None, "Markdown"]
    assert [got[n].key for n in names[:4]] == ["src/pkg", "tests/unit", "tests", "repository-root"]
    assert got["q_test.py"].s and got["lib/b/c.spec.ts"].r and not got["lib/b/c.spec.ts"].s and got["tests/x.js"].m and got[".env"].e == ""
    assert len(fixed.STOP_WORDS) == 54 and len(fixed.TOKEN_ALIASES) == 12


def test_streamed_streaks_equal_batch(spark, tmp_path):
    from loamwork.streaming.progress import repeated_actions

    rng = random.Random(4)
    rows = [(i % 3, rng.choice(["click", "view", "purchase"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "operation long, event string, n long").withColumn("ts", F.timestamp_seconds("n"))
    want = events.streaks(df, ["operation"], "ts", F.col("event"), F.col("event") == "purchase").filter("streak >= 3").select("operation", "event", "streak").collect()
    for part in range(2):
        df.filter(F.col("n").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = repeated_actions(stream).writeStream.format("memory").queryName("streaks").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("streaks").collect())) == sorted(map(tuple, want))


def test_handoff_of_a_tree(spark, tmp_path):
    from loamwork.plans import handoff

    _tree(tmp_path, {
        "src/app/server.py": b"from app.config import load\nimport app.util\n\ndef start_server(port):\n    return load(port)\n", "src/app/config.py": b"def load(x):\n    return x\n", "src/app/util.py": b"LIMIT = 1\n",
        "src/app/big.py": b"# server start\n" * 200, "tests/test_server.py": b"from app.server import start_server\n", "LICENSE": b"MIT License\n", "docs/start.md": b"# start\n",
    })
    got = handoff.discover(spark, str(tmp_path), "trace the server start and the config settings", limits=handoff.Limits(files=4, source_bytes=1500), excludes=(("directory", "docs"),))
    selected = {r.path for r in got.selected.collect()}
    assert {"src/app/server.py", "src/app/config.py"} <= selected and not {"src/app/big.py", "docs/start.md", "LICENSE"} & selected
    warned = {(r.code, r.path, r.related) for r in got.warnings.collect()}
    if "src/app/util.py" not in selected:
        assert ("direct-import-omitted", "src/app/server.py", "src/app/util.py") in warned
    assert {r.path for r in got.sections.collect()} == selected
    packages = {r.package: r for r in handoff.overview(got.scan["files"], got.facts).collect()}
    assert packages["src/app"].n_files == 4 and packages["src/app"].n_entry_points == 1 and packages["tests"].n_tests == 1
    got.release()
    assert [handoff.gate(*x) for x in ((0, 3, False), (2, 1, False), (2, 1, True), (2, 0, False))] == ["correct", "review", "final", "final"]


def test_logs_hide_secrets():
    from loamwork.functions import logs

    try:
        try:
            raise KeyError("https://u:p@h/?token=abc")
        except KeyError as e:
            raise ValueError("Bearer abc.def\nnext") from e
    except ValueError as e:
        told = logs.safe_error(e, "bad", stack=True)
    assert told["message"] == "Bearer [REDACTED] next" and told["causes"][0]["type"] == "KeyError" and "abc" not in json.dumps(told["causes"]) and told["stack"]
    line = json.loads(logs.record("a.b", "e", "m", {"password": "x", "deep": {"a": {"b": {"c": {"d": {"e": 1}}}}}}))
    assert line["data"]["password"] == "[REDACTED]" and "[...]" in json.dumps(line) and logs.record("a", "e", "m", {"k": 1}, form="plain") == "INFO a e: m k=1"
