"""Vectors that were made before, by model and text: a table that grows with each run and is kept over versions of an index.

Texts are known by their SHA-256. A run's distinct texts are looked up by an anti join, the missing ones are embedded once and
appended whole, and rows get their vectors by a join; texts that make up more than one in ``HOT`` rows, of which there can't be
more than ``HOT``, are broadcast, so that a common text isn't one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_path

SCHEMA = "digest binary, vector array<float>"
HOT = 1000


class VectorCache:
    """The vectors of one model, below ``root``/vectors. Parts of runs that died are never read: a run is added by one rename."""

    def __init__(self, spark: SparkSession, root: str, model: str):
        name = spark.range(1).select(model_path(F.lit(model)).alias("m")).first().m
        self.spark, self.root = spark, f"{root.rstrip('/')}/vectors/{name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _parts(self) -> list[str]:
        fs, path = self._fs()
        return sorted(str(s.getPath()) for s in fs.listStatus(path(self.root)) if not s.getPath().getName().startswith(("_", "."))) if fs.exists(path(self.root)) else []

    def table(self) -> DataFrame:
        """digest, vector; a digest once."""
        parts = self._parts()
        rows = self.spark.read.schema(SCHEMA).parquet(*parts).where("vector is not null") if parts else self.spark.createDataFrame([], SCHEMA)
        return rows if len(parts) < 2 else rows.dropDuplicates(["digest"])

    def add(self, rows: DataFrame) -> None:
        fs, path = self._fs()
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/_{name}")
        fs.rename(path(f"{self.root}/_{name}"), path(f"{self.root}/{name}"))

    def embedded(self, rows: DataFrame, embed: Callable[[Column], Column], text: str = "content", name: str = "embedding") -> DataFrame:
        """``rows`` with the embedding as ARRAY<FLOAT>; ``embed`` runs on each distinct text that isn't known, once. A text whose
        vector can't be made (null) isn't kept. Null texts have no vector."""
        key = "text_digest"
        while key in rows.columns:
            key = f"_{key}"
        keyed = rows.withColumn(key, F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
        counts = keyed.where(F.col(text).isNotNull()).groupBy(F.col(key).alias("digest")).agg(F.count("*").alias("n"), F.any_value(text).alias("t"))
        known = self.table()
        missing = counts.join(known.select("digest"), "digest", "left_anti")
        # no filter on the vector here: it would be pushed below, and the model run twice; nulls are left out when read
        self.add(missing.select("digest", embed(F.col("t")).cast("array<float>").alias("vector")))
        now = self.table().select(F.col("digest").alias(key), F.col("vector").alias(name))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        hot = [r.digest for r in counts.where(F.col("n") * HOT > total).select("digest").collect()] if total > HOT * HOT else []
        if not hot:
            return keyed.join(now, key, "left").drop(key)
        few = keyed.where(F.col(key).isin(hot)).join(F.broadcast(now.where(F.col(key).isin(hot))), key, "left")
        return keyed.where(~F.col(key).isin(hot) | F.col(key).isNull()).join(now, key, "left").unionByName(few).drop(key)

    def size(self) -> int:
        return self.table().count()

    def compact(self) -> None:
        """All runs' vectors as one part."""
        fs, path = self._fs()
        old = self._parts()
        if len(old) > 1:
            self.add(self.table())
            for p in old:
                fs.delete(path(p), True)

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)
