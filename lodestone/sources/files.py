"""File discovery, decoding and small driver-side readers.

Git's list of tracked names comes from the driver; folders are walked, files looked at and contents read by tasks (git and
dotfiles are invisible to Spark's file sources).
"""

from __future__ import annotations

import json
import os
import subprocess
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.config import RETRIES
from . import ignore, walk

SAMPLE_BYTES, NUL_SHARE = 8000, 0.01
#: Bytes of contents that a task hands on at once.
BATCH_BYTES = 8 << 20
_OPENED = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

# The sample texts of the benchmark command are of our own making; it cycles through them.
SAMPLES = (
    "fn main() { println!(\"hello\"); }",
    "def add(a, b):\n    return a + b",
    "class Stack:\n    def __init__(self):\n        self.items = []",
    "SELECT name, count(*) FROM people GROUP BY name",
    "const sum = (xs) => xs.reduce((a, b) => a + b, 0);",
    "# Installation\n\nUnpack the archive and run the setup.",
    "struct Point { x: f64, y: f64 }",
    "if err != nil { return err }",
)


def _git(root: Path, *args: str) -> list[str] | None:
    try:
        out = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [x for x in out.stdout.decode("utf-8", "surrogateescape").split("\0") if x] if out.returncode == 0 else None


def _first_rules(root: Path) -> tuple[tuple[ignore.Rule, ...], ...]:
    """Rules that any ignore file in the tree overrides: the user's, then the repository's own."""
    out = []
    named = _git(root, "config", "-z", "--get", "--type=path", "core.excludesFile")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    own = _git(root, "rev-parse", "--git-path", "info/exclude")
    for name in ((named or [f"{config}/git/ignore"])[0], str(root / own[0].strip()) if own else None):
        if name and os.path.isfile(name):
            out.append(tuple(ignore.parsed(Path(name).read_text(errors="surrogateescape"))))
    return tuple(out)


def discover(spark: SparkSession, root: str, max_bytes: int | None = None, untracked: bool = False, leave: str | None = None, respect_gitignore: bool = True) -> DataFrame:
    """The files under ``root`` that git tracks, inside a repository (and untracked ones if asked, without the ignored ones
    unless ``respect_gitignore`` is off); else all that a walk finds. Tasks walk and look at files.

    A walk follows no links and includes dotfiles. What is below ``leave`` (the index itself) isn't listed.
    """
    base = Path(root)
    if not base.exists():
        raise FileNotFoundError(root)
    names = _git(base, "ls-files", "-z")
    shown = lambda found, tracked: found.where("error is null").select("path", "size_bytes", "last_modified", F.lit(tracked).alias("is_git_tracked"))
    if names is None:
        out = shown(walk.walked(spark, root, leave=leave), False)
    else:
        listed = spark.createDataFrame([(os.path.join(os.path.abspath(root), n),) for n in dict.fromkeys(names)], "path string")
        out = shown(walk.stated(listed), True)
        if untracked:
            top = (_git(base, "rev-parse", "--show-toplevel") or [root])[0].strip()
            rules = _first_rules(base) if respect_gitignore else None
            below = walk.walked(spark, root, ignored=rules, leave=leave) if not respect_gitignore or os.path.samefile(top, root) else visible(spark, top, walk.walked(spark, root, leave=leave).where("path not like '%/.git/%'"), tracked=False)
            out = out.unionByName(shown(below.where("path not like '%/.git/%'").join(listed, "path", "left_anti"), False))
    if leave is not None:
        out = out.where(~F.col("path").startswith(os.path.join(os.path.abspath(leave), "")))
    return out if max_bytes is None else out.where(F.col("size_bytes") <= max_bytes)


def visible(spark: SparkSession, root: str, rows: DataFrame, *, tracked: bool = True) -> DataFrame:
    """Those of the rows (path, absolute) below ``root`` that git doesn't ignore; all of them outside a repository. What it tracks is never
    ignored. Tasks read the ignore files."""
    base = Path(root)
    names = _git(base, "ls-files", "-z")
    top = os.path.join(os.path.abspath(root), "")
    below = rows.where(F.col("path").startswith(top))
    if names is None:
        return below
    first = _first_rules(base)

    def keep(batches):
        rules = ignore.Rules(top.rstrip("/"), first)
        for b in batches:
            flags = [not (p[len(top) :].startswith(".git/") or rules.ignores(p[len(top) :])) for p in b.column("path").to_pylist()]
            yield b.filter(pa.array(flags, pa.bool_()))

    kept = below.mapInArrow(keep, below.schema)
    if not tracked:
        return kept
    listed = spark.createDataFrame([(top + n,) for n in dict.fromkeys(names)], "path string")
    return kept.unionByName(below.join(listed, "path", "left_semi")).distinct() if below.columns == ["path"] else kept.unionByName(below.join(listed, "path", "left_semi").join(kept.select("path"), "path", "left_anti"))


def is_binary(content: Column) -> Column:
    """More than 1 % NUL bytes among the first 8000."""
    sample = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    nul = F.char_length(sample) - F.char_length(F.translate(sample, "\0", ""))
    return (F.char_length(sample) > 0) & (nul > NUL_SHARE * F.char_length(sample))


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (binary content) with text, encoding, is_binary, line_count and char_count.

    Byte order marks choose UTF-8 or UTF-16; otherwise UTF-8, with U+FFFD for what isn't. Binary files have no text.
    """
    c = F.col(content)
    mark = F.hex(F.substring(c, 1, 3))
    kind = F.when(is_binary(c) & ~mark.startswith("FFFE") & ~mark.startswith("FEFF"), "binary").when(mark.startswith("FFFE"), "UTF-16LE").when(mark.startswith("FEFF"), "UTF-16BE").otherwise("UTF-8")
    body = F.when(mark == "EFBBBF", F.substring(c, 4, 1 << 30)).otherwise(c)
    wide = F.substring(c, 3, 1 << 30)
    text = F.when(kind == "binary", "").when(kind == "UTF-16LE", F.decode(wide, "UTF-16LE")).when(kind == "UTF-16BE", F.decode(wide, "UTF-16BE")).otherwise(F.make_valid_utf8(body.cast("string")))
    out = files.withColumn("encoding", kind).withColumn("text", F.coalesce(text, F.lit("")))
    return out.withColumns({"is_binary": F.col("encoding") == "binary", "line_count": T.line_count(F.col("text")).cast("bigint"), "char_count": F.char_length("text").cast("bigint")}).drop(content)


def _content(path: str) -> bytes | OSError:
    """A file's bytes; an error that another try can't mend is returned instead of raised."""
    try:
        return Path(path).read_bytes()
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError, PermissionError) as e:
        return e


def read_files(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """Contents of a listing: path, size_bytes, text, encoding, language, counts, and an error where a file couldn't be read.

    Tasks open the files themselves, so one that can't be read is a row with an error and doesn't end the job; a batch holds
    about ``BATCH_BYTES``, whatever the listing's length. The paths must be visible to the executors.
    """

    def opened(batches):
        for b in batches:
            rows, held = [], 0
            for path in b.column("path").to_pylist():
                try:
                    content, error = RETRIES["file"].run(partial(_content, path)), None
                    if isinstance(content, OSError):
                        raise content
                except OSError as e:
                    content, error = None, f"read: {e.strerror or type(e).__name__}"
                rows.append({"path": path, "size_bytes": len(content or b""), "content": content, "error": error})
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _OPENED)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _OPENED)

    raw = listing.select("path").mapInArrow(opened, "path string, size_bytes bigint, content binary, error string")
    return decoded(raw).withColumn("language", T.language(F.col("path")))


def gguf_version(path: str) -> int:
    """Version of a model file; ValueError unless the extension, size, magic and version (1 to 3) are right."""
    p = Path(path)
    head = p.open("rb").read(12)
    if p.suffix != ".gguf" or len(head) < 12 or head[:4] != b"GGUF":
        raise ValueError(f"not a GGUF file: {path}")
    version = int.from_bytes(head[4:8], "little")
    if not 1 <= version <= 3:
        raise ValueError(f"unknown GGUF version {version}")
    return version


def directory_sizes(root: str) -> dict[str, int]:
    """Bytes below each directory of a model cache."""
    base = Path(root)
    return {d.name: sum(f.stat().st_size for f in d.rglob("*") if f.is_file()) for d in sorted(base.iterdir()) if d.is_dir()} if base.is_dir() else {}


def sample_texts(spark: SparkSession, n: int, path: str | None = None) -> DataFrame:
    """The first n lines that aren't blank of a file, or n built-in samples in turn."""
    if path is None:
        return spark.range(n).select(F.get(F.array(*map(F.lit, SAMPLES)), F.pmod("id", F.lit(len(SAMPLES))).cast("int")).alias("text"))
    lines = spark.read.text(path).where(F.trim("value") != "").limit(n).withColumnRenamed("value", "text")
    if lines.isEmpty():
        raise ValueError(f"no texts in {path}")
    return lines


def load_config(*candidates: str) -> dict:
    """The first of the files that exists, as YAML (if a reader is installed) or JSON; {} if there is none."""
    for name in candidates:
        p = Path(name)
        if p.is_file():
            if p.suffix in (".yml", ".yaml"):
                return _yaml(p.read_text())
            return json.loads(p.read_text())
    return {}


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def _plain_yaml(text: str) -> dict:
    """Sections of scalars, two levels deep: what the configuration uses."""
    out: dict = {}
    section = out
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body or body.lstrip().startswith("#"):
            continue
        key, _, value = body.strip().partition(":")
        if not body.startswith(" "):
            section = out
        value = value.strip()
        if not value:
            section = out.setdefault(key, {})
            continue
        try:
            section[key] = json.loads(value)
        except ValueError:
            section[key] = value.strip("'\"")
    return out
