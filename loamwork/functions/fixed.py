"""Fixed values that results depend on."""

# Languages by lower-cased file name, then by extension.
LANGUAGE_BY_NAME = {
    ".dockerignore": "Dockerfile", ".editorconfig": "EditorConfig", ".env": "Dotenv", ".env.example": "Dotenv template", ".env.sample": "Dotenv template",
    ".gitattributes": "Git attributes", ".gitignore": "Git ignore", "dockerfile": "Dockerfile", "gemfile": "Ruby", "makefile": "Makefile", "rakefile": "Ruby",
    "readme": "Markdown", "license": "License",
}
LANGUAGE_BY_EXTENSION = {
    ".c": "C", ".cc": "C++", ".cfg": "Configuration", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".cxx": "C++", ".bat": "Batch", ".cmd": "Batch", ".go": "Go",
    ".h": "C", ".hpp": "C++", ".htm": "HTML", ".html": "HTML", ".ini": "Configuration", ".java": "Java", ".js": "JavaScript", ".json": "JSON", ".jsx": "JavaScript",
    ".kt": "Kotlin", ".kts": "Kotlin", ".md": "Markdown", ".php": "PHP", ".ps1": "PowerShell", ".py": "Python", ".rb": "Ruby", ".rs": "Rust", ".scss": "SCSS",
    ".sh": "Shell", ".sql": "SQL", ".swift": "Swift", ".toml": "TOML", ".ts": "TypeScript", ".tsx": "TypeScript", ".txt": "Text", ".xml": "XML", ".yaml": "YAML",
    ".yml": "YAML",
}

# Ignore patterns that hold before any file's own.
PROTECTED_PATTERNS = (".git/", ".hg/", ".svn/")
DEFAULT_PATTERNS = (
    ".venv/", "venv/", "env/", "__pycache__/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".uv-cache/", ".tox/", ".nox/", "node_modules/", "build/", "dist/",
    "htmlcov/", "*.egg-info/", "*.py[cod]", ".coverage",
)

# Ranking tokens, their aliases and the words that are none.
TOKEN_ALIASES = {
    "applications": "application", "clients": "client", "configuration": "config", "configurations": "config", "libraries": "library", "providers": "provider",
    "services": "service", "settings": "setting", "started": "start", "starts": "start", "tests": "test", "videos": "video",
}
STOP_WORDS = (
    "about", "across", "after", "all", "also", "and", "are", "both", "covering", "current", "diagnostic", "diagnostics", "drift", "explain", "file", "files", "find",
    "for", "from", "give", "how", "identify", "include", "including", "index", "into", "isolated", "its", "locate", "needed", "one", "only", "preserve", "published",
    "rather", "relevant", "report", "select", "selection", "show", "that", "the", "their", "this", "through", "trace", "under", "using", "where", "which", "with",
    "works", "verify", "verifying",
)

# Extensions of implementation files, license markers in order, operational words.
IMPLEMENTATION_EXTENSIONS = ("c", "cpp", "cs", "go", "java", "js", "kt", "php", "py", "rb", "rs", "swift", "ts", "tsx")
LICENSE_MARKERS = (("apache license", "Apache-2.0"), ("mit license", "MIT"), ("gnu general public license", "GPL"), ("mozilla public license", "MPL"), ("bsd 3-clause", "BSD-3-Clause"))
OPERATIONAL = ("deploy", "deployment", "install", "setup")

# Bytes sampled by the binary sniff, and the control bytes that text may hold.
SNIFF_BYTES, SNIFF_CONTROL_RATIO, TEXT_CONTROLS = 8192, 0.3, (8, 9, 10, 12, 13)

# Confidence penalties of warning codes (substring or name -> penalty) and their default.
HEAVY_CODE_PARTS, HEAVY_PENALTY = ("hash-mismatch", "missing", "source-not-read", "stale", "unread"), 0.8
CODE_PENALTIES = {"incomplete-parse-data": 0.08, "structural-coverage-limitations": 0.12, "dynamic-or-unresolved-calls": 0.15, "structural-record-unavailable": 0.5}
OTHER_PENALTY = 0.1

# The file roles that a task can ask for, in order; every group must have a word of the task.
_START = ("start", "startup", "boot", "bootstrap")
_BROWSER = ("browser", "client", "application", "document", "html")
REQUESTED_ROLES = (
    ("startup_manifest_role", (_START, ("npm", "command", "package"))),
    ("server_entry_role", (_START, ("server", "node", "http", "socket"))),
    ("browser_document_role", (_START, _BROWSER, ("document", "html"))),
    ("browser_bootstrap_role", (_START, _BROWSER)),
    ("media_search_service_role", (("media",), ("search",))),
    ("media_client_role", (("video", "library", "catalog"),)),
    ("configuration_role", (("config", "setting"),)),
    ("requested_test_role", (("test", "regression"),)),
)
