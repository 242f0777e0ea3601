"""The words that operators know: guards, loops, roles, effects, excludes. All can be replaced by arguments."""

from __future__ import annotations

# The tokens of a call's control breadcrumb and which of them guard or repeat it.
GUARDS = ("if", "if:elif", "if:else", "try:else", "try:except", "for", "for:else", "while", "while:else", "match:case", "comprehension", "comprehension:if", "bool", "ternary", "lambda", "type-checking")
LOOPS = ("for", "while", "while:test", "comprehension", "comprehension:if", "comprehension:test")
WITHIN_STATEMENT = ("bool", "ternary", "lambda", "comprehension", "comprehension:if", "comprehension:test", "assert")
ERROR_PATH = ("try:except", "try:finally")

# Folders that no scan enters, and globs that no question sees.
EXCLUDED_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", "build", "dist", "site-packages", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs")
EXCLUDED_GLOBS = (".pytest_tmp/**", "scratch/**", "**/__pycache__/**")

# What a path with tests looks like, and a file that a test runner collects.
TEST_PATH = r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[^/]*$|(^|/)tests?([-_]v\d+)?\.[^/]*$"
TEST_FILE = r"^(test_.*|.*_test)\.py$"

# Wrappers of annotations that are what they wrap, and annotations that say nothing.
TRANSPARENT = ("Optional", "Awaitable", "Coroutine")
SAYING_NOTHING = ("Any", "object", "None", "NoReturn", "Never")

# Top folders that hold no sources, where the folder of the packages is looked for.
NO_SOURCES = ("tests", "test", "docs", "doc", "examples", "example", "scripts", "benchmarks", "benches", "tools")

# A symbol gets the role of the first row that it fits in each part given; a decorator
# with dots may also be written as its last part.
ROLE_RULES: list[tuple[str, str | None, str | None, str | None]] = [
    ("test", None, r"^test_", TEST_PATH),
    ("fixture", "pytest.fixture", None, None),
    ("fixture", None, r"^(setup|teardown)(_module|_function|_class|_method)?$", TEST_PATH),
    ("fixture", None, r"^(setUp|tearDown)(Class|Module)?$", TEST_PATH),
    ("dunder", None, r"^__[a-z0-9_]+__$", None),
    ("property", "property", None, None),
    ("property", "cached_property", None, None),
    ("route", "app.route", None, None),
    ("route", "router.get", None, None),
    ("route", "router.post", None, None),
    ("route", "router.put", None, None),
    ("route", "router.delete", None, None),
    ("route", "app.get", None, None),
    ("route", "app.post", None, None),
    ("route", "app.put", None, None),
    ("route", "app.patch", None, None),
    ("route", "app.delete", None, None),
    ("route", "app.websocket", None, None),
    ("route", "app.middleware", None, None),
    ("command", "click.command", None, None),
    ("command", "click.group", None, None),
    ("command", "app.command", None, None),
    ("handler", "on", None, None),
    ("task", "work", None, None),
    ("task", "app.task", None, None),
    ("task", "shared_task", None, None),
]

# Effects as bits, and the dotted prefixes of external targets that have them.
EFFECTS = {"filesystem": 1, "network": 2, "process": 4, "env": 8, "console": 16, "nondeterminism": 32}
EFFECT_RULES: list[tuple[str, str]] = [
    ("open", "filesystem"), ("pathlib", "filesystem"), ("shutil", "filesystem"), ("socket", "network"), ("requests", "network"), ("httpx", "network"), ("urllib", "network"), ("subprocess", "process"),
    ("os.environ", "env"), ("print", "console"), ("logging", "console"), ("random", "nondeterminism"), ("time", "nondeterminism"), ("datetime.datetime", "nondeterminism"), ("datetime.now", "nondeterminism"),
]
