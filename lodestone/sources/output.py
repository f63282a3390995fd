"""Result sinks: JSON lines, text, and the service's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SHOWN_LINES, PREVIEW = 3, 200


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON object a row: file, line_start, line_end, score, content, rank."""
    row = F.struct(F.col("file_path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.col("similarity").alias("score"), "content", "rank")
    return results.orderBy("rank").select(F.to_json(row).alias("value"))


def text_lines(results: DataFrame) -> DataFrame:
    """Numbered results with up to three lines of content each."""
    lines = F.split("content", "\n")
    shown = F.transform(F.slice(lines, 1, SHOWN_LINES), lambda x, i: F.concat(F.lpad((F.col("start_line") + i).cast("string"), 4, " "), F.lit("│ "), F.trim(x)))
    head = F.format_string("%d. %s:%d (similarity: %.1f%%)", F.col("rank") + 1, "file_path", "start_line", F.col("similarity") * 100)
    more = F.when(F.size(lines) > SHOWN_LINES, F.lit("\n    │ ...")).otherwise("")
    return results.orderBy("rank").select(F.concat(head, F.lit("\n"), F.array_join(shown, "\n"), more).alias("value"))


def no_result_hints(query: str) -> list[str]:
    return [f"No results for '{query}'.", "Try other words, a lower threshold, or fewer filters."]


def tool_rows(results: DataFrame, root: str) -> DataFrame:
    """Rows of the search tool: path below ``root``, extension or 'unknown', content or a preview of 200 characters."""
    path: Column = F.regexp_replace("file_path", "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.rstrip("/")) + "/", "")
    ext = T.extension(path)
    return results.select(path.alias("file_path"), F.when(ext == "", "unknown").otherwise(ext).alias("file_type"), "similarity", "rank", "start_line", "end_line", F.coalesce(T.real_content(F.col("content")), T.preview(F.col("content"), PREVIEW)).alias("content"), F.lit(None).cast("string").alias("context"))


def benchmark_csv(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.option("header", True).mode("overwrite").csv(path)
