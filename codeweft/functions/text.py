"""Column functions on names, paths and short texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import SAYING_NOTHING, TEST_FILE, TEST_PATH, TRANSPARENT


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_test_path(path: Column | str) -> Column:
    return _c(path).rlike(TEST_PATH)


def is_collectible_test(path: Column | str) -> Column:
    """Whether a test runner would collect the file."""
    return F.element_at(F.split(_c(path), "/"), -1).rlike(TEST_FILE)


def last_segment(name: Column | str, by: str = r"\.") -> Column:
    return F.element_at(F.split(_c(name), by), -1)


def first_segment(name: Column | str, by: str = r"\.") -> Column:
    return F.split(_c(name), by)[0]


def parent_of(name: Column | str) -> Column:
    """A dotted name without its last segment; null at the top."""
    return F.nullif(F.regexp_replace(_c(name), r"\.?[^.]*$", ""), F.lit(""))


def first_paragraph(doc: Column | str) -> Column:
    return F.split(F.trim(_c(doc)), r"\n\n")[0]


def decorator_head(decorator: Column | str) -> Column:
    """What a decorator names, without @ and arguments."""
    return F.trim(F.split(F.regexp_replace(_c(decorator), r"^@", ""), r"\(")[0])


def plain_type(annotation: Column | str, depth: int = 4) -> Column:
    """The one dotted type that an annotation names, through up to ``depth`` transparent wrappers and one union with None; else null."""
    bare = F.regexp_replace(_c(annotation), "^[\\s'\"]+|[\\s'\"]+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, rf"^(?:(?:\w+\.)*(?:{'|'.join(TRANSPARENT)})\[(?:[^\[\]]*,)?\s*){{1,{depth}}}", ""), r"\s*\]+$", "")
    said = F.regexp_replace(inner, r"^(?:None\s*\|\s*)+|(?:\s*\|\s*None)+$", "")
    return F.nullif(F.regexp_extract(said, rf"^(?!(?:\w+\.)*(?:{'|'.join(SAYING_NOTHING)})$)\w+(?:\.\w+)*$", 0), F.lit(""))


def type_names(annotation: Column | str) -> Column:
    """Every dotted name in an annotation, those inside containers and unions with them."""
    return F.array_distinct(F.regexp_extract_all(_c(annotation), F.lit(r"([A-Za-z_]\w*(?:\.\w+)*)"), 1))


def truncated(text: Column | str, most: int = 80, dots: str = "...") -> Column:
    """White space made single; more than ``most`` characters are cut to that with dots."""
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - len(dots)), F.lit(dots))).otherwise(flat)


def normal_path(path: Column | str) -> Column:
    """Forward slashes, no leading ./ and no doubled slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(path), r"\\", "/"), r"/+", "/"), r"^(\./)+", "")


def module_name(path: Column | str, strip: str = "") -> Column:
    """The dotted module of a Python file's path: a package's __init__ is the package, odd characters become _."""
    p = _c(path)
    if strip:
        p = F.regexp_replace(p, "^" + re.escape(strip.rstrip("/")) + "/", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    return F.array_join(F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"\W", "_")), ".")


def location(path: Column | str, line: Column | str) -> Column:
    return F.concat_ws(":", _c(path), _c(line).cast("string"))


def slug_id(text: Column | str, size: int = 8) -> Column:
    """A readable slug and the start of the text's sha256."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.concat_ws("-", slug, F.substring(F.sha2(_c(text).cast("binary"), 256), 1, size))


def escaped(text: Column | str) -> Column:
    """For diagram labels: # first, then quotes and angle brackets as entities."""
    out = _c(text)
    for a, b in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_slice(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start`` to ``end`` of a text, from 1."""
    lines = F.split(_c(text), "\n")
    return F.array_join(F.slice(lines, _c(start), _c(end) - _c(start) + 1), "\n")


def glob_regex(glob: str, crossing: bool = False) -> str:
    """An anchored pattern for a glob: ** spans folders; * and ? stop at / unless ``crossing``."""
    out, i, any_ = "", 0, "." if crossing else "[^/]"
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + (any_ + "*" if ch == "*" else any_ if ch == "?" else re.escape(ch)), i + 1
    return f"^{out}$"


def matches_any(path: Column | str, globs: list[str], crossing: bool = False) -> Column:
    return F.lit(False) if not globs else _c(path).rlike("|".join(glob_regex(g, crossing) for g in globs))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Whole percents, halves up; null of nothing."""
    return F.when(_c(whole) > 0, F.floor(_c(part) * 100 / _c(whole) + 0.5))


def utc_time(seconds: Column | str) -> Column:
    """Seconds since 1970 as 2024-01-31T23:59:59Z."""
    return F.date_format(F.timestamp_seconds(_c(seconds)).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
