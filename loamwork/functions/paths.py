"""Expressions over repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions import fixed
from loamwork.functions.text import any_of, ranking_tokens


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def extension(path: Column) -> Column:
    """The last suffix with its dot; none for a name that only begins with one or ends in one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    """By file name, then by extension; null if neither is known."""
    return F.coalesce(F.try_element_at(_map(fixed.LANGUAGE_BY_NAME), file_name(path)), F.try_element_at(_map(fixed.LANGUAGE_BY_EXTENSION), extension(path)))


def is_portable(path: Column) -> Column:
    """Relative, without backslash, control character, drive, or an empty, . or .. segment."""
    return ~(path.rlike(r"[\\\x00-\x1f\x7f]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|/)\.{0,2}(/|$)"))


def is_test_strict(path: Column) -> Column:
    """A part named tests, a name test_..., or a stem ..._test; case matters."""
    name = F.substring_index(path, "/", -1)
    return F.array_contains(F.split(path, "/"), "tests") | name.startswith("test_") | F.regexp_replace(name, r"(.)\.[^.]*$", "$1").endswith("_test")


def is_test_any(path: Column) -> Column:
    """The rule of several languages, in lower case."""
    low = F.lower(path)
    return low.rlike(r"^tests?/") | low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"(_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts)$")


def is_test_ranked(path: Column) -> Column:
    """The rule that ranking uses: without the .js suffixes."""
    low = F.lower(path)
    return low.rlike(r"^tests?/") | low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"(_test\.py|\.test\.ts|\.spec\.ts)$")


def is_implementation(path: Column) -> Column:
    return ~is_test_ranked(path) & F.lower(F.substring_index(path, ".", -1)).isin(*fixed.IMPLEMENTATION_EXTENSIONS) & path.contains(".")


def package_key(path: Column) -> Column:
    """src and lib by two parts, tests by two from three parts on, a lone name is the root, else the first part."""
    parts = F.split(path, "/")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, 1, 2), "/")
    first = parts[0]
    return F.when(first.isin("src", "lib") & (n >= 2), two).when(first == "tests", F.when(n < 3, "tests").otherwise(two)).when(n == 1, "repository-root").otherwise(first)


def semantic_category(path: Column) -> Column:
    name, ext = file_name(path), extension(path)
    return (
        F.when(name.rlike("^(license|copying|notice)"), "license").when(name.startswith("readme"), "readme")
        .when(ext.isin(".json", ".toml", ".yaml", ".yml", ".xml", ".ini", ".cfg"), "config").when(ext.isin(".md", ".txt", ".rst", ".adoc"), "document").otherwise("source")
    )


def output_tokens(path: Column, size_bytes: Column, generic: Column, complexity: Column) -> Column:
    """The response size that a file's category, route, size and number of facts call for."""
    category = semantic_category(path)
    return (
        F.when(category == "license", 128).when(category.isin("readme", "document", "config"), F.when(size_bytes > 2048, 192).otherwise(160))
        .when(generic, F.when(size_bytes <= 8192, 192).otherwise(256))
        .when((size_bytes <= 2048) & (complexity <= 4), 256).when((size_bytes <= 32768) & (complexity <= 20), 320).otherwise(512)
    )


def metadata_penalty(path: Column, task: list[str]) -> Column:
    """Below zero for license, ignore, environment-template and operational files that the task does not ask for."""
    wants = set(task)
    name = F.lower(F.substring_index(path, "/", -1))
    cost = lambda asked, by: F.lit(0.0 if wants & set(asked) else by)
    return (
        F.when(name.rlike("^(license|copying)"), cost(("license", "licensing", "copyright"), -100.0))
        .when(name.isin(".gitignore", ".dockerignore", ".npmignore", ".ignore"), cost(("ignore", "gitignore"), -100.0))
        .when(name.rlike(r"^\.env\.(.*)(example|sample|template)$"), cost(("env", "environment", "example", "sample", "template"), -100.0))
        .when(any_of(ranking_tokens(path), fixed.OPERATIONAL), cost(fixed.OPERATIONAL, -60.0)).otherwise(0.0)
    )


def task_roles(path: Column, task: list[str]) -> dict[str, tuple[float, Column]]:
    """Role signal -> (its score, whether the path has it), for the roles that the task's tokens ask for."""
    wants = set(task)
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    stem = F.substring_index(name, ".", 1)
    parents = ranking_tokens(F.regexp_extract(low, r"^(.*)/[^/]*$", 1))
    own = ranking_tokens(path)
    test, no = is_test_ranked(path), F.lit(False)
    asks = lambda *words: bool(wants & set(words))
    page = name.isin("index.html", "index.htm")
    browser = asks("browser", "bootstrap", "document", "html")
    flow = {"media", "search"} <= wants and asks("core", "flow", "implementation", "integration", "request", "service")
    catalog = ("video", "library", "catalog")
    return {
        "startup_manifest_role": (24.0, name.isin("package.json", "pyproject.toml", "cargo.toml") if asks("start", "startup", "boot", "bootstrap") and asks("command", "manifest", "npm", "package") else no),
        "server_entry_role": (22.0, (stem == "server") | (stem.isin("main", "app") & ~any_of(parents, ("browser", "client", "public", "web"))) if asks("server", "node", "http", "socket", "api") else no),
        "browser_document_role": (22.0, page if browser else no),
        "browser_bootstrap_role": (18.0, ~page & stem.isin("app", "bootstrap", "index", "main") & any_of(parents, ("client", "public", "web")) if browser else no),
        "configuration_role": (20.0, stem.isin("config", "configuration", "setting", "settings") | F.array_contains(parents, "config") if asks("config", "setting") else no),
        "media_search_service_role": (26.0, ~test & F.array_contains(own, "media") & F.array_contains(own, "search") if flow else no),
        "media_client_role": (16.0, ~test & is_implementation(path) & any_of(own, catalog) if asks(*catalog) else no),
        "requested_test_role": (10.0, test if asks("test", "regression") else no),
    }


def role_score(path: Column, task: list[str]) -> Column:
    out = F.lit(0.0)
    for score, has in task_roles(path, task).values():
        out = out + F.when(has, score).otherwise(0.0)
    return out


def role_signals(path: Column, task: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(has, name) for name, (_, has) in task_roles(path, task).items())))


def ancestors(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def preorder_key(path: Column) -> Column:
    """Sorts directories before files at each level, each by name."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "1").otherwise("0"), x)), "\x01")
