"""Walking folders by tasks.

Each task explores the folders it is given, depth first, up to ``BUDGET`` entries, and hands on those it hasn't opened yet;
these are dealt to tasks again until none is left. So a small tree is one job, and a large one is dealt out as it unfolds; the
driver sees counts only. Links aren't followed. A folder that can't be listed is a row with an error.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ignore import Rule, Rules
from .shared import checkpointed

BUDGET = 20_000
FOUND = "path string, size_bytes bigint, last_modified timestamp, is_folder boolean, error string"
_FOUND = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_()), ("error", pa.string())])


def _entry(path: str) -> dict:
    s = os.lstat(path)
    return {"path": path, "size_bytes": s.st_size, "last_modified": s.st_mtime_ns // 1000, "is_folder": False, "error": None}


def _failed(path: str, error: str) -> dict:
    return {"path": path.encode("utf-8", "replace").decode(), "size_bytes": 0, "last_modified": None, "is_folder": False, "error": error}


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def stated(names: DataFrame) -> DataFrame:
    """``FOUND`` rows of the regular files among rows (path), looked at by tasks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column("path").to_pylist():
                if os.path.isfile(p) and not os.path.islink(p):
                    try:
                        rows.append(_entry(p))
                    except OSError:
                        continue  # it went meanwhile
            yield pa.RecordBatch.from_pylist(rows, _FOUND)

    return names.select("path").mapInArrow(look, FOUND)


def unfolded(folders: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``FOUND`` rows of the files below each of the folders (column path)."""
    spark = folders.sparkSession
    return _deal(spark, folders.select("path"), lambda: None, lambda rules, path, folder: False, lambda path: True, budget)


def walked(spark: SparkSession, root: str, *, ignored: tuple[tuple[Rule, ...], ...] | None = None, leave: str | None = None, budget: int = BUDGET) -> DataFrame:
    """``FOUND`` rows of the files below ``root``, and of folders that can't be listed.

    ``ignored``: leave out what git's ignore files say, with these rules before them; then .git and repositories within
    aren't entered either. ``leave``: a folder that isn't entered.
    """
    base, out_of = os.path.abspath(root), os.path.abspath(leave) if leave else None
    own = ignored is not None

    def hidden(rules: Rules | None, path: str, folder: bool) -> bool:
        return rules is not None and (os.path.basename(path) == ".git" or rules.ignores(os.path.relpath(path, base), folder))

    def entered(path: str) -> bool:
        return path != out_of and not (own and os.path.lexists(os.path.join(path, ".git")))

    return _deal(spark, spark.createDataFrame([(base,)], "path string"), lambda: Rules(base, ignored) if own else None, hidden, entered, budget)


def _deal(spark: SparkSession, frontier: DataFrame, rules_of: Callable[[], Rules | None], hidden: Callable[[Rules | None, str, bool], bool], entered: Callable[[str], bool], budget: int) -> DataFrame:
    """Explore the folders of ``frontier``, then what that has left, until nothing is left."""

    def explore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = rules_of()
        for b in batches:
            for start in b.column("path").to_pylist():
                rows, todo, seen = [], [start], 0
                while todo and seen < budget:
                    at = todo.pop()
                    try:
                        with os.scandir(at) as entries:
                            for e in entries:
                                seen += 1
                                path = os.path.join(at, e.name)
                                if not _is_text(path):
                                    rows.append(_failed(path, "list: the name isn't UTF-8"))
                                    continue
                                folder = e.is_dir(follow_symlinks=False)
                                if hidden(rules, path, folder):
                                    continue
                                if folder and entered(path):
                                    todo.append(path)
                                elif e.is_file(follow_symlinks=False):
                                    rows.append(_entry(path))
                    except OSError as error:
                        rows.append(_failed(at, f"list: {error.strerror or type(error).__name__}"))
                rows += [{"path": p, "size_bytes": 0, "last_modified": None, "is_folder": True, "error": None} for p in todo]
                yield pa.RecordBatch.from_pylist(rows, _FOUND)

    levels = []
    while True:
        found = checkpointed(frontier.mapInArrow(explore, FOUND))
        levels.append(found.where("not is_folder"))
        left = found.where("is_folder").select("path")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionByName, levels)
        frontier = left.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // 64)), F.xxhash64("path"))
