"""Path predicates: globs turned into regular expressions, extensions and wildcards.

``*`` and ``?`` cross slashes, ``**`` must be a whole path component and ``**/``
matches none or more components, classes negate with ``!``, braces are literal,
matching is case-sensitive and leading dots are nothing special.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension

MOST_CHARS, MOST_RECURSIVE, MOST_CLASS, MOST_EXTENSION = 1000, 5, 50, 10
_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


class GlobError(ValueError):
    """A pattern that can't be used."""


def normalize_glob(pattern: str) -> str:
    """Trimmed; one leading ./ stripped, // made /, a trailing / stripped, doubled recursion simplified."""
    out = pattern.strip().removeprefix("./")
    while "//" in out:
        out = out.replace("//", "/")
    if len(out) > 1:
        out = out.removesuffix("/")
    while "**/**" in out:
        out = out.replace("**/**", "**")
    while "**/*/**" in out:
        out = out.replace("**/*/**", "**/**")
    return out


def _escape(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


@lru_cache(maxsize=1000)
def glob_regex(pattern: str) -> str:
    """An anchored regular expression that Java and RE2 both read; GlobError if the pattern is malformed."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            if j - i == 1:
                out.append(r"[\s\S]*")
            elif j - i > 2 or (i and pattern[i - 1] != "/") or (j < n and pattern[j] != "/"):
                raise GlobError(f"'**' must be a whole path component: {pattern!r}")
            elif j < n:
                out.append(r"(?:[\s\S]*/)?")
                j += 1
            else:
                out.append(r"[\s\S]*")
            i = j
        elif c == "?":
            out.append(r"[\s\S]")
            i += 1
        elif c == "[":
            start = i + 2 if pattern[i + 1 : i + 2] == "!" else i + 1
            end = pattern.find("]", start + 1)
            if end < 0:
                raise GlobError(f"unclosed class: {pattern!r}")
            members = pattern[start:end]
            body = "".join("-" if c == "-" and 0 < k < len(members) - 1 else _escape(c) for k, c in enumerate(members))
            out.append(("[^" if start == i + 2 else "[") + body + "]")
            i = end + 1
        else:
            out.append(_escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def validate_glob(pattern: str) -> str:
    """The trimmed pattern, or GlobError."""
    p = pattern.strip()
    if not p:
        raise GlobError("the pattern is empty")
    if len(p.encode()) > MOST_CHARS:
        raise GlobError(f"the pattern is longer than {MOST_CHARS}")
    if re.search(r"[\x00-\x08\x0a-\x1f\x7f]", p):
        raise GlobError("the pattern has control characters")
    if "../" in p:
        raise GlobError("the pattern leaves its directory")
    if p.count("**") > MOST_RECURSIVE:
        raise GlobError(f"more than {MOST_RECURSIVE} recursive wildcards")
    first = re.search(r"\[(.*?)\]", p, re.S)
    if first and len(first[1].encode()) > MOST_CLASS:
        raise GlobError("a very long character class")
    glob_regex(p)
    return p


def matches(path: Column, pattern: str) -> Column:
    """Engine filter: the pattern as it is; a malformed one matches nothing. A literal prefix is pushed to the scan."""
    try:
        rx = glob_regex(pattern)
    except GlobError:
        return F.lit(False)
    prefix = re.match(r"[^*?\[]*", pattern)[0]
    test = path.rlike(rx)
    return path.startswith(prefix) & test if prefix else test


def matches_validated(path: Column, pattern: str) -> Column:
    """Result filter: normalised and validated; GlobError if malformed."""
    return matches(path, validate_glob(normalize_glob(pattern)))


def has_extension(path: Column, filetype: str) -> Column:
    """Engine filter: '.ext' exactly as given; no extension is ''."""
    own = extension(path)
    return F.when(own == "", F.lit("")).otherwise(F.concat(F.lit("."), own)) == filetype


def normalize_extension(text: str) -> str:
    """'.ext' in lower case; GlobError unless alphanumeric and of 2 to 10 bytes."""
    low = text.strip().lower()
    out = low if low.startswith(".") else f".{low}"
    if not out[1:].isalnum() or not 2 <= len(out.encode()) <= MOST_EXTENSION:
        raise GlobError(f"invalid extension: {text!r}")
    return out


def has_extension_any_case(path: Column, ext: str) -> Column:
    """Result filter: equal but for ASCII case; paths without an extension are dropped."""
    own = extension(path)
    return (own != "") & (F.lower(own) == ext.lstrip(".").lower())


def matches_wildcards(path: Column, patterns: list[str]) -> Column:
    """Any of simple patterns (*x*, *x, x*, x), all in lower case; none given matches all."""
    low, test = F.lower(path), None
    for p in map(str.lower, patterns):
        core = p.strip("*")
        if p.startswith("*") and p.endswith("*") or "*" not in (p[:1], p[-1:]):
            one = low.contains(core)
        else:
            one = low.endswith(core) if p.startswith("*") else low.startswith(core)
        test = one if test is None else test | one
    return F.lit(True) if test is None else test


def describe(glob: str | None, ext: str | None) -> str:
    parts = [f"Glob pattern: {glob}"] * bool(glob) + [f"File extension: {ext}"] * bool(ext)
    return ", ".join(parts) or "No filters active"
