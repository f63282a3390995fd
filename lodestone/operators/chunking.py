"""Overlapping token windows over documents, in one pass over the text.

With E = min(target, most) > overlap and n > target tokens, windows start every
E - overlap tokens; a window after the first needs at least max(overlap + 1,
least) tokens (least counts only if target >= least), so up to least - 1 last
tokens may belong to no window. Texts of at most ``target`` tokens are one
window, verbatim. A target not above the overlap is allowed only for texts of at
most ``overlap`` tokens, which are tiled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..sources.shared import bounded_batches

TARGET, OVERLAP, MOST, LEAST = 300, 50, 500, 100
#: Characters of windows that a task hands on at once.
BATCH_CHARS = 1 << 20
#: Texts that it makes strings of at once.
ROWS = 256


@dataclass(frozen=True)
class ChunkConfig:
    target: int = TARGET
    overlap: int = OVERLAP
    most: int = MOST
    least: int = LEAST

    def validate(self) -> ChunkConfig:
        if self.target < 1 or self.most < 1:
            raise ValueError("target and most must be at least 1")
        if not self.least <= self.target <= self.most:
            raise ValueError("least <= target <= most must hold")
        if self.overlap >= self.target:
            raise ValueError("the overlap must be under the target")
        return self

    @property
    def size(self) -> int:
        return min(self.target, self.most)

    @property
    def shortest(self) -> int:
        """Tokens that a window after the first needs."""
        return max(self.overlap + 1, self.least if self.target >= self.least else 0)


def window_starts(n: int, c: ChunkConfig) -> np.ndarray:
    """First tokens of the windows of a text of n tokens."""
    if n <= c.target:
        return np.zeros(1, np.int64)
    if c.size <= c.overlap:
        if n > c.overlap:
            raise ValueError("the overlap must be under the target for long texts")
        return np.arange(0, n, c.size)
    step = c.size - c.overlap
    return np.arange(max(0, (n - c.shortest) // step) + 1) * step


def window_sizes(n: Column, c: ChunkConfig) -> Column:
    """The same from a count of tokens alone: tokens in each window."""
    step = c.size - c.overlap
    if step <= 0:
        raise ValueError("the overlap must be under the target")
    last = F.greatest(F.lit(0), F.floor((n - c.shortest) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.least(F.lit(c.size).cast("bigint"), n - k * step))
    return F.when(n <= c.target, F.array(n)).otherwise(cut)


_PLACES = ("start_line", "end_line", "start_char", "end_char")


def _schema(offsets: bool) -> str:
    return "id string, file_path string, content string, token_count bigint, chunk_index bigint, total_chunks bigint" + (", ".join(["", *(f"{c} bigint" for c in _PLACES)]) if offsets else "")


class _Windows:
    """Rows of windows, text after text."""

    def __init__(self, config: ChunkConfig, offsets: bool):
        self.config, self.offsets = config, offsets

    def rows(self, paths: list[str | None], w: S.Words) -> Iterator[tuple]:
        c, feeds = self.config, w.feeds() if self.offsets else None
        for i, (path, text) in enumerate(zip(paths, w.texts)):
            n = int(w.counts[i])
            whole = n <= c.target
            first = [0] if whole else window_starts(n, c).tolist()
            words = None if whole else w.of(i)
            for k, f in enumerate(first):
                size = n if whole else min(c.size, n - f)
                row = (None if path is None else f"{path}:{k}", path, text if whole else " ".join(words[f : f + size]), size, k, len(first))
                yield (*row, *self.places(w, feeds, i, f, size, whole)) if self.offsets else row

    @staticmethod
    def places(w: S.Words, feeds: np.ndarray, i: int, f: int, size: int, whole: bool) -> tuple[int, int, int, int]:
        at, text = int(w.at[i]), w.texts[i]
        if whole:
            lines = int(feeds[at + len(text)] - feeds[at]) + (not text.endswith("\n"))
            return 1, max(1, lines), 0, len(text)
        start, end = int(w.starts[w.first[i] + f]), int(w.ends[w.first[i] + f + size - 1])
        line = lambda x: 1 + int(feeds[at + x] - feeds[at])
        return line(start), line(end), start, end


def cutter(runs: tuple[np.ndarray, np.ndarray], config: ChunkConfig, offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of file_path and body to batches of windows; besides a batch and a text, what is held is bounded."""
    names = [x.split()[0] for x in _schema(offsets).split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows = S.Table(runs), _Windows(config, offsets)
        types = [pa.string()] * 3 + [pa.int64()] * (len(names) - 3)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                paths, bodies = batch.column("file_path").to_pylist(), batch.column("body").to_pylist()
                for lo, hi in S.slices(bodies):
                    held, chars = [], 0
                    for row in windows.rows(paths[lo:hi], S.Words(table, bodies[lo:hi])):
                        held.append(row)
                        chars += len(row[2])
                        if chars >= BATCH_CHARS:
                            yield packed(held)
                            held, chars = [], 0
                    if held:
                        yield packed(held)

    return cut


def chunks(files: DataFrame, config: ChunkConfig = ChunkConfig(), *, path: str = "path", text: str = "text", offsets: bool = True) -> DataFrame:
    """One row for each window: id, file_path, content, token_count, chunk_index, total_chunks (and lines and characters).

    Offsets are code points; lines are from 1. Null and empty texts have no window.
    """
    bounded_batches(files.sparkSession)
    df = files.select(F.col(path).alias("file_path"), F.col(text).alias("body")).where("body <> ''")
    return df.mapInArrow(cutter(S.ranges(), config, offsets), _schema(offsets))


def chunk_counts(files: DataFrame, config: ChunkConfig = ChunkConfig(), *, path: str = "path", text: str = "text") -> DataFrame:
    """file_path and token_count of each window, without the windows' texts."""
    bounded_batches(files.sparkSession)
    df = files.select(F.col(path).alias("file_path"), F.col(text).alias("body")).where("body <> ''")
    counted = df.select("file_path", S.word_count(F.col("body")).alias("n"))
    return counted.select("file_path", F.explode(window_sizes(F.col("n"), config)).alias("token_count"))
