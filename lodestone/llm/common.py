"""Small Spark helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's text, modulo ``by``; it deals documents into folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one; a cluster must name its own."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = f"{tempfile.gettempdir()}/lodestone-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(here)
    return here


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows of the driver's as a table. Made from Arrow: from a list, every executor starts a second set of Python workers to unpickle them."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), schema)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sampled(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """About ``most`` of the rows, or all if there are no more, by a hash of ``by`` under a cut; no row leaves its task."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(by, F.lit(41)), 11) < int((1 << 53) * (most / n)))


#: Bits of a sieve: at least SIEVE_BITS for each key it is made of, between these bounds, so that it is 32 MB at most.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 16, 1 << 28


def _sieve_size(keys: int) -> int:
    return min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (SIEVE_BITS * keys).bit_length()))


def _sieve_words(places: DataFrame) -> DataFrame:
    """w, b: the words of a bitmap that are not zero, by the other columns; ``places``: p, the places of its bits."""
    others = [c for c in places.columns if c != "p"]
    return places.groupBy(*others, F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))


def sieve_arrays(keys: DataFrame, *n: int) -> list[np.ndarray]:
    """Two bitmaps over the low bits of hashes, as words, for tasks in Python; their sizes are bounded. ``keys``: hash, and whether it is one of the second's; ``n``: how many of each."""
    bits = [_sieve_size(x) for x in n]
    hashes, second = (F.col(f"`{c}`") for c in keys.columns)
    place = hashes.bitwiseAND(F.when(second, F.lit(bits[1] - 1)).otherwise(F.lit(bits[0] - 1)))
    t = _sieve_words(keys.select(second.alias("second"), place.alias("p"))).toArrow()
    out = []
    for which, size in enumerate(bits):
        mine = t.filter(t.column("second") if which else pa.compute.invert(t.column("second")))
        out.append(np.zeros(size // 64, np.int64))
        out[-1][mine.column("w").to_numpy()] = mine.column("b").to_numpy()
    return [x.view(np.uint64) for x in out]


def in_sieve(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among the sieve's keys; those that are always pass."""
    place = hashes & np.uint64(64 * len(words) - 1)
    return ((words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def sieve(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """The same as a condition on a column of hashes: the bitmap is stored, and a scalar subquery reads it, so rows that fail aren't shuffled."""
    bits = _sieve_size(n)
    spark = keys.sparkSession
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = spark.range(bits // 64).join(_sieve_words(keys.select(place.alias("p"))), F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
    listed = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("id", name))), lambda y: y[name]).alias(name)
    pages = words.groupBy(F.shiftright("id", 10).alias("page")).agg(listed("b")).select(F.col("page").alias("id"), "b")
    whole = stored(pages.agg(listed("b")).select(F.flatten("b").alias("x")), "sieve")

    def test(h: Column) -> Column:
        place = h.bitwiseAND(F.lit(bits - 1))
        return F.getbit(F.get(whole.scalar(), F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


SALTS = 16


def salted_join(rows: DataFrame, small: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with at most one row of ``small`` for each ``on``; a hot key's rows are dealt to SALTS tasks by ``by``.

    The join is always by merging, for its right side grows with the data and the copies would be broadcast on a guess.
    """
    salt, = fresh(rows, "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = small.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
    return left.join(right.hint("merge"), [on, salt], how).drop(salt)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names not among the columns of ``df``, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: The folder that holds the package, for the tasks' module path.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows and bytes of an Arrow batch that Python tasks take at once, so that long texts don't fill a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to these bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that a task has freed back to the system; workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: glibc's mallopt: parameters, and the greatest values that it sets by itself.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _TRIM_MOST, _MMAP_MOST = -1, -3, 64 << 20, 32 << 20


@contextlib.contextmanager
def holding(most: int = 512 << 20) -> Iterator[None]:
    """Freed memory, up to ``most``, stays with the process meanwhile: for steps that make and free the same arrays over and over, whose pages the system would clear each time."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc
        yield
        return
    mallopt(_MMAP_THRESHOLD, _MMAP_MOST)
    mallopt(_TRIM_THRESHOLD, most)
    try:
        yield
    finally:
        mallopt(_TRIM_THRESHOLD, _TRIM_MOST)
        trim()


def arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose tasks find this package and end lean."""
    env = df.sparkSession.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])

    def lean(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def plus(df: DataFrame, columns: list[str], more: str) -> StructType:
    """The schema of some columns and further ones, whatever the columns are called."""
    return StructType([*df.select([df[c] for c in columns]).schema.fields, *(StructType.fromDDL(more).fields if more else [])])
