"""End-to-end plans: build, update and search an index over files."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, search
from ..operators.chunking import ChunkConfig, chunks
from ..sources import files as S
from ..sources.index_store import IndexStore, Manifest
from ..sources.shared import checkpointed
from ..sources.vector_cache import VectorCache
from .config import DiscoveryError, IndexingError, Settings


def indexed(texts: DataFrame, settings: Settings, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks with vectors of rows (path, text)."""
    return embedding.embedded(chunks(texts, settings.chunk), embed)


def read(spark: SparkSession, listing: DataFrame, settings: Settings, embed: Callable[[Column], Column], cache: VectorCache | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Indexed chunks of a listing's text files, rejects (path, error) that couldn't be read, and figures of the run.

    The decoded texts are stored once, so files are opened once, and the figures are observed while that is written.
    """
    seen = Observation()
    opened = S.read_files(spark, listing).observe(
        seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("is_binary").alias("binary"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )
    began = time.monotonic()
    files = checkpointed(opened)
    figures = {k: int(v) for k, v in seen.get.items()} | {"read_seconds": round(time.monotonic() - began, 3)}
    if figures["files"] != figures["failed"] + files.where("error is null").count():
        raise IndexingError("files that were read and files that failed don't add up")
    cut = chunks(files.where(F.col("error").isNull() & ~F.col("is_binary")), settings.chunk)
    rows = cache.embedded(cut, embed) if cache else embedding.embedded(cut, embed)
    return rows, files.where(F.col("error").isNotNull()).select("path", "error"), figures


def kept_settings(settings: Settings) -> dict:
    """What an index must be searched and updated with."""
    c = settings.chunk
    return {"chunk": {"target": c.target, "overlap": c.overlap, "most": c.most, "least": c.least}}


def same_settings(m: Manifest, settings: Settings) -> Settings:
    """``settings`` with the chunk sizes the index was made with."""
    kept = m.settings
    return replace(settings, chunk=ChunkConfig(**kept["chunk"])) if kept else settings


def build(spark: SparkSession, root: str, store: IndexStore, settings: Settings = Settings(), embed: Callable[[Column], Column] = embedding.mock_embedding, model: str = "mock", cached: bool = True) -> Manifest:
    """Discover, decode, chunk, embed and save. No files is an error; nothing to index saves nothing. A bad file is a
    reject beside the result (``IndexStore.rejects``). Vectors of texts that were embedded before are taken from the
    index's cache, if ``cached``. The manifest's ``stats`` has the run's figures."""
    listing = S.discover(spark, root, settings.max_file_bytes, settings.include_untracked, leave=store.root, respect_gitignore=settings.respect_gitignore)
    if listing.isEmpty():
        raise DiscoveryError(f"no files found in {root}")
    rows, rejects, figures = read(spark, listing, settings, embed, VectorCache(spark, store.root, model) if cached else None)
    if figures["files"] == figures["failed"] + figures["binary"]:
        raise DiscoveryError(f"nothing to index in {root}")
    return store.save(rows, listing.select("path", F.col("last_modified").alias("mtime")), model=model, rejects=rejects, settings=kept_settings(settings), stats=figures)


def update(spark: SparkSession, root: str, store: IndexStore, settings: Settings = Settings(), embed: Callable[[Column], Column] = embedding.mock_embedding, cached: bool = True) -> Manifest:
    """Only new and changed files are read again, only their new chunks embedded, and a delta is written; the index's own chunk sizes hold."""
    m = store.manifest()
    settings = same_settings(m, settings)
    listing = S.discover(spark, root, settings.max_file_bytes, settings.include_untracked, leave=store.root, respect_gitignore=settings.respect_gitignore).withColumnRenamed("last_modified", "mtime")

    def make(todo: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
        return read(spark, todo, settings, embed, VectorCache(spark, store.root, m.model) if cached else None)

    return store.update(listing, make)


def ask(store: IndexStore, text: str, request: search.SearchRequest = search.SearchRequest(), embed: Callable[[Column], Column] | None = None, model: str | None = None) -> DataFrame:
    """Ranked chunks of the index for a text query, ties broken by path and chunk. The hits' texts are read from their own buckets.

    The query's vector comes from the embedder registered under the index's model, unless one is given."""
    embed = embed or embedding.EMBEDDERS.get(store.manifest().model)
    rows = store.load(model)
    hits = search.search_text(rows.drop("content"), text, embed, request.validate(), path="file_path", ties=["file_path", "chunk_index"], norm="norm")
    schema, found = hits.schema, hits.collect()  # at most the request's limit
    top = store.spark.createDataFrame(found, schema)
    texts = store.load(paths=sorted({r.file_path for r in found})).where(F.col("id").isin([r.id for r in found])).select("id", "content")
    return texts.join(F.broadcast(top), "id").orderBy("rank")


def fresh_content(hits: DataFrame) -> DataFrame:
    """``hits`` with their text as the files have it now; those of files that can't be read, or were cut, keep what the index has."""
    files = S.read_files(hits.sparkSession, hits.select(F.col("file_path").alias("path")).distinct()).where(F.col("error").isNull())
    now = search.rehydrated(hits.withColumn("kept", F.col("content")), files.select(F.col("path").alias("file_path"), "text"))
    return now.withColumn("content", F.when(F.col("content") == "", F.col("kept")).otherwise(F.col("content"))).drop("kept")
