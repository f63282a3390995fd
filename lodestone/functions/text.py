"""Text, path and label expressions, and their driver-side counterparts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "rs": "rust", "js": "javascript", "ts": "typescript", "py": "python", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "c",
    "go": "go", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "clj": "clojure", "hs": "haskell", "elm": "elm", "html": "html",
    "css": "css", "scss": "scss", "sass": "scss", "vue": "vue", "md": "markdown", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "sh": "bash", "bash": "bash",
}

# Common source, web, configuration and documentation extensions.
COMMON_EXTENSIONS = (
    "rs py js ts jsx tsx java cpp c h hpp cs go php rb swift kt scala clj hs elm "
    "html css scss sass less vue svelte json yaml yml toml xml ini cfg conf md rst txt"
).split()

# Error classes in order of test, with the phrases that mark them.
ERROR_CLASSES = (
    ("no_files_found", ("no files found",)),
    ("embedding_init", ("failed to initialize embedding generator",)),
    ("permission_denied", ("permission denied",)),
    ("disk_space", ("disk", "space")),
    ("network", ("timeout", "network")),
)

PLACEHOLDER = "[PLACEHOLDER_CONTENT_FROM:"


def line_count(text: Column) -> Column:
    """Lines without a last empty one."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; '' without one (a leading dot alone makes no extension)."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)


def language(path: Column) -> Column:
    """The language by extension, NULL if unknown."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(extension(path)))


def preview(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def cut_bytes(text: Column, n: int) -> Column:
    """At most the first ``n`` bytes of UTF-8; a character that would be cut in two is left out."""
    raw = F.encode(text, "UTF-8")
    ends = [F.substring(raw, 1, max(0, n - k)).cast("string") for k in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(e), e) for e in ends)))


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat_ws(":", path, index.cast("string"))


def squeezed(text: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def real_content(text: Column) -> Column:
    """NULL for a placeholder."""
    return F.when(~text.startswith(PLACEHOLDER), text)


def parse_filesize(text: str) -> int:
    """Bytes of '100', '100b', '2kb', '5mb', '1gb'; ValueError otherwise."""
    m = re.fullmatch(r"(\d+)(b|kb|mb|gb)?", text.lower(), re.ASCII)
    if not m:
        raise ValueError(f"invalid file size: {text!r}")
    return int(m[1]) * 1024 ** {None: 0, "b": 0, "kb": 1, "mb": 2, "gb": 3}[m[2]]


def filesize(text: Column) -> Column:
    """The same as a column; NULL where it is invalid."""
    low = F.lower(text)
    number = F.regexp_extract(low, r"^([0-9]+)(?:b|kb|mb|gb)?$", 1).try_cast("bigint")
    factor = F.when(low.endswith("kb"), 1 << 10).when(low.endswith("mb"), 1 << 20).when(low.endswith("gb"), 1 << 30).otherwise(1)
    return number * factor.cast("bigint")


def parse_memory_limit(text: str) -> int:
    """Bytes of '2GB', '512.5MB', '100B'; a bare number is an error."""
    m = re.fullmatch(r"(?:(\d+(?:\.\d+)?)\s*(GB|MB)|(\d+)\s*B)", text.strip().upper())
    if not m:
        raise ValueError(f"invalid memory limit: {text!r}")
    return int(m[3]) if m[3] else int(float(m[1]) * (1 << 30 if m[2] == "GB" else 1 << 20))


def parse_device(text: str) -> str:
    if (low := text.lower()) not in ("cpu", "gpu", "cuda", "metal"):
        raise ValueError(f"unknown device: {text!r}")
    return low


def format_bytes(n: Column, decimals: int = 1) -> Column:
    """B, KB, MB or GB in steps of 1024."""
    n = n.cast("double")
    show = lambda x, unit: F.concat(F.format_string(f"%.{decimals}f", x), F.lit(f" {unit}"))
    return F.when(n < 1 << 10, show(n, "B")).when(n < 1 << 20, show(n / (1 << 10), "KB")).when(n < 1 << 30, show(n / (1 << 20), "MB")).otherwise(show(n / (1 << 30), "GB"))


def error_class(message: Column) -> Column:
    low, out = F.lower(message), None
    for name, phrases in ERROR_CLASSES:
        test = low.contains(phrases[0])
        for p in phrases[1:]:
            test = test | low.contains(p)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def model_path(name: Column) -> Column:
    """A model's directory name."""
    return F.translate(name, '/:<>"|?*.', "_" * 9)


def is_model_name(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_.-]+/[\p{L}\p{N}_.-]+$")


def takes_instruction(name: Column) -> Column:
    return name.rlike("[qQ]wen3")


def instructed(instruction: Column, text: Column) -> Column:
    return F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text)


def effective_model(*choices: Column) -> Column:
    """The first given of command, global, configured and default model."""
    return F.coalesce(*choices)


def memory_estimate(size: Column, backend: Column) -> Column:
    """Size times 2, 3 or 4 by backend."""
    return size * F.when(backend == "fastembed", 2).when(backend == "candle", 3).otherwise(4)


def backoff_ms(attempt: Column, first: float, factor: float, cap: float) -> Column:
    """Delay before an attempt, without jitter; none before attempt 0."""
    return F.when(attempt <= 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.lit(float(first)) * F.pow(F.lit(float(factor)), attempt - 1)))
