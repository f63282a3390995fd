"""A JSON-RPC service over lines, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import replace
from typing import Any, TextIO

from ..functions import glob as G
from ..functions import text as T
from ..functions.vector import clamp_threshold
from ..operators import search
from ..operators.embedding import EMBEDDERS, embedded
from ..operators.statistics import benchmark_means
from ..sources import output
from ..sources.files import discover, load_config, sample_texts
from ..sources.index_store import IndexStore
from ..sources.vector_cache import VectorCache
from .config import MODELS, ConfigError, DiscoveryError, Settings, merged, model
from .pipeline import ask, build, fresh_content, update

MOST_LINE, PER_MINUTE, BURST = 1 << 20, 60, 10
CONFIG_FILES = (".lodestone.yml", ".lodestone.yaml", ".lodestone.json")
DEFAULT_LIMIT, MOST_LIMIT, MOST_CONTEXT, LONGEST_WORD = 10, 100, 10, 200
# JSON-RPC error codes, the last four our own.
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL, NOT_READY, TOO_MANY, NO_TOOL, FAILED = -32700, -32600, -32601, -32602, -32603, -32000, -32001, -32002, -32003


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Bucket:
    """Tokens that fill at ``per_minute`` up to ``burst``."""

    def __init__(self, per_minute: float = PER_MINUTE, burst: int = BURST, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock, self.left, self.at = per_minute / 60, burst, clock, float(burst), clock()

    def take(self) -> bool:
        now = self.clock()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            return False
        self.left -= 1
        return True


def tool_request(args: dict[str, Any], settings: Settings = Settings()) -> tuple[str, search.SearchRequest]:
    """The query and request of a tool call; RpcError if an argument is wrong."""

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise RpcError(BAD_PARAMS, message)

    query = args.get("query")
    need(isinstance(query, str), "query must be a string")
    need(not any(x in query for x in ("../", "..\\", "\0")) and all(len(w.encode()) <= LONGEST_WORD for w in query.split()), "the query isn't acceptable")
    try:
        query = search.validate_query(query)
    except ValueError as e:
        raise RpcError(BAD_PARAMS, str(e)) from e
    limit, threshold, ext, glob = args.get("limit", DEFAULT_LIMIT), args.get("threshold", settings.min_similarity), args.get("filetype"), args.get("filter")
    need(isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MOST_LIMIT, f"limit must be from 1 to {MOST_LIMIT}")
    need(isinstance(threshold, (int, float)) and not isinstance(threshold, bool) and 0 <= threshold <= 1, "threshold must be from 0 to 1")
    need(ext is None or (isinstance(ext, str) and len(ext) >= 2 and ext.startswith(".")), "filetype must start with a dot")
    context = args.get("context_lines", 0)
    need(isinstance(context, int) and 0 <= context <= MOST_CONTEXT, f"context_lines must be from 0 to {MOST_CONTEXT}")
    if glob is not None:
        try:
            G.validate_glob(glob)
        except G.GlobError as e:
            raise RpcError(BAD_PARAMS, str(e)) from e
    return query, search.SearchRequest(limit, clamp_threshold(float(threshold)), ext, glob)


class Service:
    """initialize, tools/list and tools/call with one tool, semantic_search; more may be registered."""

    def __init__(self, store: IndexStore, root: str, settings: Settings = Settings(), bucket: Bucket | None = None):
        self.store, self.root, self.settings, self.bucket, self.ready = store, root, settings, bucket or Bucket(), False
        self.tools: dict[str, tuple[str, Callable[[dict], Any]]] = {"semantic_search": ("Search the indexed files by meaning", self._search)}

    def register(self, name: str, description: str, run: Callable[[dict], Any]) -> None:
        self.tools[name] = description, run

    def _search(self, args: dict) -> dict:
        query, request = tool_request(args, self.settings)
        rows = [r.asDict() for r in output.tool_rows(ask(self.store, query, request), self.root).collect()]
        return {"results": rows, "total_results": len(rows), "query_info": {"query": query, "limit": request.limit, "threshold": request.threshold, "filters": G.describe(request.glob, request.filetype)}}

    def call(self, method: str, params: dict) -> Any:
        if method == "initialize":
            self.ready = True
            return {"serverInfo": {"name": "lodestone"}, "capabilities": {"tools": {}}}
        if not self.ready:
            raise RpcError(NOT_READY, "not initialized")
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d} for n, (d, _) in sorted(self.tools.items())]}
        if method == "tools/call":
            if params.get("name") not in self.tools:
                raise RpcError(NO_TOOL, f"no tool {params.get('name')!r}")
            return self.tools[params["name"]][1](params.get("arguments") or {})
        raise RpcError(NO_METHOD, f"no method {method!r}")

    def answer(self, line: str) -> dict | None:
        """The response to one line; None for a notification."""
        number = None
        try:
            if len(line.encode()) > MOST_LINE:
                raise RpcError(INVALID, "the message is too long")
            try:
                m = json.loads(line)
            except ValueError as e:
                raise RpcError(PARSE, "not JSON") from e
            if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
                raise RpcError(INVALID, "not a request")
            number = m.get("id")
            if not self.bucket.take():
                raise RpcError(TOO_MANY, "too many requests")
            result = self.call(m["method"], m.get("params") or {})
            return None if "id" not in m else {"jsonrpc": "2.0", "id": number, "result": result}
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": FAILED, "message": str(e).splitlines()[0] if str(e) else type(e).__name__}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        for line in source:
            if line.strip() and (out := self.answer(line)) is not None:
                sink.write(json.dumps(out, default=str) + "\n")
                sink.flush()


def benchmark(spark, backends: list[str], texts: int, iterations: int, file: str | None = None, form: str = "table") -> str:
    """Mean texts a second and milliseconds by backend over the iterations."""
    rows, samples = [], sample_texts(spark, texts, file).persist()
    n = samples.count()
    for name in backends:
        for _ in range(iterations):
            began = time.perf_counter()
            embedded(samples, EMBEDDERS.get(name), "text").write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            rows.append((name, n / took, took * 1000))
    samples.unpersist()
    means = benchmark_means(spark.createDataFrame(rows, "backend string, texts_per_s double, ms double"), "backend", "texts_per_s", "ms").collect()
    found = [r.asDict() for r in sorted(means, key=lambda r: r.backend)]
    if form == "json":
        return json.dumps(found, indent=2)
    if form == "csv":
        return "\n".join(["backend,texts_per_s,ms", *(f"{r['backend']},{r['texts_per_s']:.2f},{r['ms']:.2f}" for r in found)])
    return "\n".join(f"{r['backend']:<20} {r['texts_per_s']:>12.1f} texts/s {r['ms']:>10.1f} ms" for r in found)


def settings_for(path: str, a: argparse.Namespace) -> Settings:
    """Checked settings: the command line, then the file named by --config or found under ``path``, then defaults."""
    base = path.rstrip("/")
    if a.config and not os.path.isfile(a.config):
        raise FileNotFoundError(a.config)
    names = [a.config] if a.config else [f"{base}/{n}" for n in CONFIG_FILES]
    given = {"max_file_bytes": getattr(a, "max_filesize", None), "limit": getattr(a, "limit", None), "min_similarity": getattr(a, "threshold", None), "include_untracked": getattr(a, "untracked", None)}
    out = merged(given, load_config(*names))
    if isinstance(out.max_file_bytes, str):
        out = replace(out, max_file_bytes=T.parse_filesize(out.max_file_bytes))
    return out.validate()


def keep_up(spark, root: str, store: IndexStore, settings: Settings, every: float, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Look at the files every so many seconds and apply what changed; endless without ``rounds``."""
    while rounds is None or rounds > 0:
        sleep(every)
        update(spark, root, store, settings)
        rounds = None if rounds is None else rounds - 1


def main(argv: list[str] | None = None) -> int:
    """index PATH, list PATH, search PATH QUERY, serve PATH, benchmark, models."""
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "list", "search", "serve"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--index")
        c.add_argument("--config")
        if name in ("index", "list"):
            c.add_argument("--max-filesize")
            c.add_argument("--untracked", action="store_true", default=None)
        if name == "index":
            c.add_argument("--update", action="store_true")
            c.add_argument("--watch", type=float, metavar="SECONDS")
        if name == "search":
            c.add_argument("query")
            c.add_argument("--limit", type=int)
            c.add_argument("--threshold", type=float)
            c.add_argument("--filetype")
            c.add_argument("--filter")
            c.add_argument("--json", action="store_true")
    c = sub.add_parser("models")
    c.add_argument("--info", metavar="NAME")
    c.add_argument("--clear", metavar="NAME", help="forget the vectors of a model that an index keeps")
    c.add_argument("--index")
    b = sub.add_parser("benchmark")
    b.add_argument("--backend", action="append", default=None)
    b.add_argument("--texts", type=int, default=100)
    b.add_argument("--file")
    b.add_argument("--iterations", type=int, default=3)
    b.add_argument("--format", choices=("table", "json", "csv"), default="table")
    a = p.parse_args(argv)
    if a.command == "models" and not a.clear:
        for m in [model(a.info)] if a.info else MODELS.values():
            print(f"{m.name}\t{m.dimensions}\t{m.backend}\t{m.description}" + (f"\t{m.size_bytes}" if a.info else ""))
        return 0
    if a.command == "models" and not a.index:
        raise ConfigError("--clear needs --index")
    # what can be told without a session is told before one starts
    if getattr(a, "path", None) is not None and not os.path.isdir(a.path):
        raise DiscoveryError(f"no folder {a.path}")
    if getattr(a, "threshold", None) is not None and not 0 <= a.threshold <= 1:
        raise ConfigError("the threshold must be from 0 to 1")
    if a.command == "search":
        search.validate_query(a.query)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "models":
        VectorCache(spark, a.index, a.clear).clear()
        return 0
    if a.command == "benchmark":
        print(benchmark(spark, a.backend or ["mock"], a.texts, a.iterations, a.file, a.format))
        return 0
    settings = settings_for(a.path, a)
    store = IndexStore(spark, a.index or f"{a.path.rstrip('/')}/{settings.index_dir}")
    if a.command == "list":
        for r in discover(spark, a.path, settings.max_file_bytes, settings.include_untracked, leave=store.root, respect_gitignore=settings.respect_gitignore).orderBy("path").toLocalIterator():
            print(f"{r.size_bytes}\t{r.path}")
        return 0
    if a.command == "index":
        print((update if a.update and store.exists() else build)(spark, a.path, store, settings))
        if a.watch:
            keep_up(spark, a.path, store, settings, a.watch)
    elif a.command == "serve":
        Service(store, a.path, settings).serve()
    else:
        hits = ask(store, a.query, search.SearchRequest(settings.limit, a.threshold))  # min_similarity is the service's default
        hits = search.filter_results(hits, path="file_path", glob=a.filter, ext=a.filetype)
        hits = fresh_content(hits) if settings.rehydrate else hits
        rows = (output.json_lines(hits) if a.json else output.text_lines(hits)).collect()
        print("\n".join(r.value for r in rows) if rows or a.json else "\n".join(output.no_result_hints(a.query)))
    return 0
