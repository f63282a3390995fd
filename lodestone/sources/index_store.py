"""The index table: an ordered list of parts that a manifest names, merged on read.

The first part is the base, later ones are deltas. A part has ``chunks`` (chunk,
vector, norm), ``changes`` (one row for each path it sets or deletes: file time, number
of chunks, whether deleted, error) and ``sums`` (a checksum for each file written). Chunks and
changes lie in directories by path hash (``bucket``), so what concerns a few paths
reads and writes a few buckets. Of a path the newest part that
names it holds; its chunks in older parts are hidden by an anti join.

A commit writes its part whole, then its manifest under ``commits``, and then replaces the
pointer ``manifest.json`` by one rename, so a reader sees the state before or after,
and a writer that dies between leaves only files that nothing names, which
``sweep`` deletes. Deltas are merged by size: the newest parts are rewritten as
one as long as a part is less than ``RATIO`` times what follows it, so there are
logarithmically many parts and each row is rewritten as often. ``rollback`` goes back to the newest older commit
whose files are all sound.

All paths go through Hadoop's file system, so any store Spark reads will do.
There is one writer at a time; a commit on top of a manifest that has changed
meanwhile is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import diff

FORMAT = "2.0.0"
#: Buckets of a new index, the size ratio that merging keeps, and how many changed paths a broadcast may hold.
BUCKETS, RATIO, SMALL_PATHS = 64, 4, 100_000
#: Where chunks lie whose vector couldn't be made; they are never read but as rejects.
NO_VECTOR = -1
#: Seconds after which files that no commit names are left-overs.
GRACE = 3600.0


class StoreError(RuntimeError):
    """The index is missing, damaged, of another version, or doesn't fit the model."""


@dataclass(frozen=True)
class Part:
    name: str
    chunks: int
    paths: int
    deleted: int = 0

    @property
    def size(self) -> int:
        return self.chunks + self.paths


@dataclass(frozen=True)
class Manifest:
    version: str
    format: str
    model: str
    dimensions: int
    chunks: int
    files: int
    created_at: float
    batch: int = -1
    number: int = 0
    buckets: int = BUCKETS
    parts: tuple[Part, ...] = ()
    settings: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)

    @classmethod
    def parsed(cls, text: str) -> Manifest:
        raw = json.loads(text)
        if raw.get("format") != FORMAT:
            raise StoreError(f"the index has format {raw.get('format')}, not {FORMAT}; rebuild it")
        return cls(**{**raw, "parts": tuple(Part(**p) for p in raw["parts"])})


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, *, buckets: int = BUCKETS, ratio: float = RATIO):
        self.spark, self.root, self.buckets, self.ratio = spark, root.rstrip("/"), buckets, ratio

    # files and manifests

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _read_text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def _write_text(self, name: str, text: str) -> None:
        """A whole file at once: written aside, then renamed over its target."""
        fs, path = self._fs()
        new, final = path(f"{self.root}/.new-{uuid.uuid4().hex}"), path(f"{self.root}/{name}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        # FileContext's rename replaces its target in one step, so a reader always finds one manifest or the other
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, final, options)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.root}/manifest.json"))

    def manifest(self) -> Manifest:
        """Checks the format; StoreError if there is none or it is another."""
        if not self.exists():
            raise StoreError(f"no index at {self.root}")
        return Manifest.parsed(self._read_text("manifest.json"))

    def versions(self) -> list[str]:
        """Commits that can still be read, oldest first."""
        return [n.removesuffix(".json") for n in self._names("commits") if n.endswith(".json") and not n.startswith(".")]

    def _commit(self, m: Manifest, after: Manifest | None) -> Manifest:
        number = after.number + 1 if after else 1
        m = replace(m, number=number, version=f"c{number:09d}-{uuid.uuid4().hex[:8]}", created_at=time.time())
        if (self.manifest().version if self.exists() else None) != (after.version if after else None):
            raise StoreError("another writer has changed the index meanwhile")
        text = json.dumps(asdict(m))
        self._write_text(f"commits/{m.version}.json", text)
        self._write_text("manifest.json", text)
        return m

    # writing

    def _bucket(self, column: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame | None, changes: DataFrame, buckets: int, vector: str = "embedding") -> tuple[Part, int, dict[str, int]]:
        """One part, its dimensions (0 without vectors) and figures of its chunks. ``changes``: path, mtime, deleted, error; chunks are counted here."""
        name = f"p{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/parts/{name}"
        counts, unmade, low, high, chunks, figures = None, None, None, None, 0, {"chunks": 0}
        if rows is not None:
            placed = rows.drop("norm", "bucket").withColumns({"norm": V.norm(F.col(vector)), "bucket": F.when(F.col(vector).isNull(), NO_VECTOR).otherwise(self._bucket("file_path", buckets))})
            # in order of path, so that a lookup of a few paths skips row groups
            placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "file_path").write.partitionBy("bucket").parquet(f"{at}/chunks")
            if self._names(f"parts/{name}/chunks") not in ([], ["_SUCCESS"]):
                every = self.spark.read.parquet(f"{at}/chunks")
                stored, bad = every.where(F.col("bucket") != NO_VECTOR), every.where(F.col("bucket") == NO_VECTOR)
                unmade = bad.select(F.col("file_path").alias("path"), F.lit("embed: no vector").alias("unmade")).distinct()
                counts = stored.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"))
                r = stored.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.count("*").alias("n"), *([F.sum("token_count").alias("tokens")] if "token_count" in stored.columns else [])).first()
                low, high, chunks = r.low, r.high, r.n
                figures = {"chunks": r.n} | ({"tokens": r.tokens or 0} if "token_count" in stored.columns else {})
                if low != high:
                    raise StoreError(f"vectors of {low} to {high} dimensions in one index")
        named = changes.select("path", "mtime", "deleted", "error")
        # a path that has chunks is a change, whether it is listed or not: else its older chunks would stay visible
        named = named.join(counts, "path", "full").withColumn("deleted", F.coalesce("deleted", F.lit(False))) if counts is not None else named.withColumn("chunks", F.lit(0))
        if unmade is not None:
            named = named.join(unmade, "path", "left").withColumn("error", F.coalesce("error", "unmade")).drop("unmade")
        named = named.withColumns({"chunks": F.coalesce("chunks", F.lit(0)).cast("bigint"), "bucket": self._bucket("path", buckets)})
        named.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{at}/changes")
        r = self._changes(name).agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("int")).alias("d")).first()
        self._sums(name).write.parquet(f"{at}/sums")
        return Part(name, chunks, r.n, r.d or 0), low or 0, figures

    def _sums(self, name: str) -> DataFrame:
        """file, length and checksum of what lies in a part, by the executors."""
        at = f"{self.root}/parts/{name}"
        folders = [f"{at}/{x}" for x in ("chunks", "changes") if set(self._names(f"parts/{name}/{x}")) - {"_SUCCESS", "._SUCCESS.crc"}]
        if not folders:
            return self.spark.createDataFrame([], "file string, length bigint, checksum bigint")
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders)
        return raw.select(F.regexp_extract("path", f"/{name}/(.*)$", 1).alias("file"), "length", F.xxhash64("content").alias("checksum"))

    _CHUNKS_EMPTY = "file_path string"
    _CHANGES = "path string, mtime timestamp, deleted boolean, error string, chunks bigint, bucket int"

    def _changes(self, name: str) -> DataFrame:
        at = f"parts/{name}/changes"
        if set(self._names(at)) <= {"_SUCCESS", "._SUCCESS.crc"}:
            return self.spark.createDataFrame([], self._CHANGES)
        return self.spark.read.schema(self._CHANGES).parquet(f"{self.root}/{at}")

    def _rows(self, part: Part) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/parts/{part.name}/chunks").where(F.col("bucket") != NO_VECTOR) if part.chunks else None

    def save(self, rows: DataFrame, times: DataFrame | None = None, *, model: str = "mock", batch: int = -1, vector: str = "embedding", rejects: DataFrame | None = None, settings: dict | None = None, stats: dict | None = None) -> Manifest:
        """Write ``rows`` (file_path, ..., vector) as a new base and make it current; ``times``: path, mtime; ``rejects``: path, error."""
        before = self.manifest() if self.exists() else None
        if times is None:
            times = rows.select(F.col("file_path").alias("path")).distinct().withColumn("mtime", F.current_timestamp())
        began = time.monotonic()
        part, dimensions, figures = self._write(rows, self._listed(times, None, rejects), self.buckets, vector)
        files = self._changes(part.name).where("error is null").count()
        m = Manifest("", FORMAT, model, dimensions, part.chunks, files, 0.0, batch, 0, self.buckets, (part,), settings or {}, (stats or {}) | figures | {"write_seconds": round(time.monotonic() - began, 3)})
        return self._commit(m, before)

    @staticmethod
    def _listed(times: DataFrame, gone: DataFrame | None, rejects: DataFrame | None) -> DataFrame:
        out = times.select("path", "mtime", F.lit(False).alias("deleted"))
        if gone is not None:
            out = out.unionByName(gone.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(True).alias("deleted")))
        if rejects is None:
            return out.withColumn("error", F.lit(None).cast("string"))
        return out.join(rejects.groupBy("path").agg(F.min("error").alias("error")), "path", "left")

    def upsert(self, rows: DataFrame | None, times: DataFrame, gone: DataFrame | None = None, *, rejects: DataFrame | None = None, batch: int = -1, vector: str = "embedding", merge: bool = True, stats: dict | None = None) -> tuple[Manifest, dict[str, int]]:
        """Commit a delta: ``times`` (path, mtime) are set to the chunks in ``rows``, ``gone`` (path) are deleted.

        Counters: added, updated, removed, failed. A path may be in ``times`` or in ``gone``, once. What is rewritten
        besides is what merging by size asks for.
        """
        m, began = self.manifest(), time.monotonic()
        part, dimensions, figures = self._write(rows, self._listed(times, gone, rejects), m.buckets, vector)
        if dimensions and m.dimensions and dimensions != m.dimensions:
            raise StoreError(f"vectors of {dimensions} dimensions for an index of {m.dimensions}")
        new = self._changes(part.name)
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = self._listing(m).where(F.col("bucket").isin(buckets)).select("path", F.col("chunks").alias("had"), F.col("error").isNull().alias("sound"))
        touched = new if part.paths > SMALL_PATHS else F.broadcast(new)
        seen = old.join(touched, "path")
        r = seen.agg(F.sum("had").alias("had"), F.sum(F.col("sound").cast("int")).alias("files"), F.sum((F.col("deleted") & F.col("sound")).cast("int")).alias("removed"), F.sum((~F.col("deleted") & F.col("error").isNull() & F.col("sound")).cast("int")).alias("updated")).first()
        had, files, removed, updated = (x or 0 for x in (r.had, r.files, r.removed, r.updated))
        failed = new.where("error is not null").count()
        done = part.paths - part.deleted - failed
        counts = {"added": done - updated, "updated": updated, "removed": removed, "failed": failed}
        parts = (*m.parts, part)
        m2 = replace(m, chunks=m.chunks - had + part.chunks, files=m.files - files + done, dimensions=m.dimensions or dimensions, batch=batch if batch >= 0 else m.batch, parts=parts, stats=(stats or {}) | figures | counts | {"write_seconds": round(time.monotonic() - began, 3)})
        return self._commit(replace(m2, parts=self._merged(m2)) if merge else m2, m), counts

    def _merged(self, m: Manifest) -> tuple[Part, ...]:
        """The parts after the newest have been rewritten as one, if the ratio asks for it."""
        sizes = [p.size for p in m.parts]
        first = next((i for i in range(len(sizes) - 1) if sizes[i] < self.ratio * sum(sizes[i + 1 :])), None)
        return m.parts if first is None else (*m.parts[:first], self._rewritten(m, first))

    def _rewritten(self, m: Manifest, first: int) -> Part:
        """Parts from ``first`` on as one; deletions stay unless nothing older is left."""
        some = replace(m, parts=m.parts[first:])
        rows = self._visible(some)
        changes = self._newest(some.parts)
        if first == 0:
            changes = changes.where("not deleted")
        return self._write(rows, changes, m.buckets)[0]

    def optimize(self) -> Manifest:
        """Rewrite everything as one base."""
        m = self.manifest()
        return m if len(m.parts) == 1 and not m.parts[0].deleted else self._commit(replace(m, parts=(self._rewritten(m, 0),)), m)

    # reading

    def _newest(self, parts: tuple[Part, ...]) -> DataFrame:
        """The newest change of each path."""
        if len(parts) == 1:
            return self._changes(parts[0].name)
        every = None
        for i, p in enumerate(parts):
            rows = self._changes(p.name).withColumn("part", F.lit(i))
            every = rows if every is None else every.unionByName(rows)
        rest = [c for c in every.columns if c not in ("path", "bucket", "part")]
        # both keys, so that a filter on buckets reaches the scan
        return every.groupBy("bucket", "path").agg(F.max_by(F.struct(*rest), "part").alias("c")).select("path", *(f"c.{c}" for c in rest), "bucket")

    def _visible(self, m: Manifest) -> DataFrame | None:
        """Chunks that no newer part hides."""
        held = [(i, p) for i, p in enumerate(m.parts) if p.chunks]
        if not held:
            return None
        later = [(i, p) for i, p in enumerate(m.parts) if i > held[0][0]]
        out = None
        if later:
            changed = None
            for i, p in later:
                rows = self._changes(p.name).select(F.col("bucket").alias("b"), F.col("path").alias("p"), F.lit(i).alias("part"))
                changed = rows if changed is None else changed.unionByName(rows)
            changed = changed.groupBy("b", "p").agg(F.max("part").alias("newest"))
            if sum(p.paths for _, p in later) <= SMALL_PATHS:
                changed = F.broadcast(changed)
        for i, p in held:
            rows = self._rows(p)
            if later and i < later[-1][0]:
                rows = rows.join(changed, (F.col("bucket") == F.col("b")) & (F.col("file_path") == F.col("p")) & (F.col("newest") > i), "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def load(self, model: str | None = None, *, version: str | None = None, paths: list[str] | None = None) -> DataFrame:
        """The chunks; of some paths only, if given, from their buckets only. ``version``: an older commit."""
        m = self.manifest() if version is None else Manifest.parsed(self._read_text(f"commits/{version}.json"))
        if model is not None and model != m.model:
            raise StoreError(f"the index was made with {m.model}, not {model}")
        rows = self._visible(m)
        if rows is None:
            # some part's schema, or the least one, without rows
            names = [p.name for p in m.parts if set(self._names(f"parts/{p.name}/chunks")) - {"_SUCCESS", "._SUCCESS.crc"}]
            return self.spark.read.parquet(f"{self.root}/parts/{names[0]}/chunks").limit(0).drop("bucket") if names else self.spark.createDataFrame([], "id string, file_path string, content string, chunk_index bigint, embedding array<float>, norm double")
        if paths is not None:
            wanted = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
            buckets = [r.b for r in wanted.select(self._bucket("file_path", m.buckets).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets)).where(F.col("file_path").isin(paths))
        return rows.drop("bucket")

    def _listing(self, m: Manifest) -> DataFrame:
        return self._newest(m.parts).where("not deleted")

    def times(self) -> DataFrame:
        """path, mtime of every file the index knows, those that failed too."""
        return self._listing(self.manifest()).select("path", "mtime")

    def rejects(self) -> DataFrame:
        """path, error of the files that couldn't be indexed."""
        return self._listing(self.manifest()).where("error is not null").select("path", "error")

    # soundness

    def damaged(self, part: str) -> list[str]:
        """Files of a part that are missing or differ from their checksum."""
        try:
            # values instead of a read in place: a lost file must not fail the comparison
            known = self.spark.read.parquet(f"{self.root}/parts/{part}/sums")
            there = self._sums(part)
            wrong = known.join(there.select("file", F.col("length").alias("l"), F.col("checksum").alias("c")), "file", "left").where("c is null or c <> checksum or l <> length")
            return sorted(r.file for r in wrong.select("file").collect())
        except Exception as e:
            return [f"{part}: {str(e).splitlines()[0]}"]

    def validate(self, deep: bool = False) -> list[str]:
        """What is wrong with the index; nothing if it is sound. ``deep`` compares every file with its checksum."""
        try:
            m = self.manifest()
            n = self.load().count()
        except Exception as e:
            return [str(e).splitlines()[0]]
        wrong = [] if n == m.chunks else [f"{n} chunks, but the manifest says {m.chunks}"]
        return wrong + ([x for p in m.parts for x in self.damaged(p.name)] if deep else [])

    def rollback(self) -> Manifest:
        """Make the newest commit before the current one whose files are all sound current again; StoreError if there is none."""
        now = self.manifest() if self.exists() else None
        found: dict[str, bool] = {}
        for v in reversed(self.versions()):
            if now is not None and v >= now.version:
                continue
            m = Manifest.parsed(self._read_text(f"commits/{v}.json"))
            for p in m.parts:
                if p.name not in found:
                    found[p.name] = not self.damaged(p.name)
            if all(found[p.name] for p in m.parts):
                return self._commit(m, now)
        raise StoreError("no sound version to go back to")

    def recover(self) -> Manifest:
        """The current version if it is sound, else the newest sound one before it; left-overs are swept."""
        m = self.rollback() if self.validate(deep=True) else self.manifest()
        self.sweep()
        return m

    def sweep(self, grace: float = GRACE) -> list[str]:
        """Delete what no commit names and is older than ``grace`` seconds: parts and files of writers that died."""
        fs, path = self._fs()
        named = {p.name for v in self.versions() for p in Manifest.parsed(self._read_text(f"commits/{v}.json")).parts}
        gone = []
        for folder, keep in (("parts", lambda n: n in named), ("", lambda n: not n.startswith(".new-")), ("commits", lambda n: not n.startswith(".new-"))):
            at = path(f"{self.root}/{folder}" if folder else self.root)
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if not keep(s.getPath().getName()) and s.getModificationTime() / 1000 < time.time() - grace:
                    fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return sorted(gone)

    def compact(self, keep: int = 2) -> list[str]:
        """Forget all but the newest commits, and delete the parts that only they name; the current one always stays."""
        fs, path = self._fs()
        current = self.manifest().version
        gone = [v for v in self.versions()[:-keep] if v != current]
        parts = lambda vs: {p.name for v in vs for p in Manifest.parsed(self._read_text(f"commits/{v}.json")).parts}
        useless = parts(gone) - parts([v for v in self.versions() if v not in gone])
        for v in gone:
            fs.delete(path(f"{self.root}/commits/{v}.json"), False)
        for p in useless:
            fs.delete(path(f"{self.root}/parts/{p}"), True)
        return gone

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def update(self, current: DataFrame, make: Callable[[DataFrame], tuple[DataFrame, DataFrame | None, dict]], *, batch: int = -1) -> Manifest:
        """Incremental update: ``current`` (path, mtime, ...) is compared with the stored times; ``make`` turns new and
        changed rows into indexed chunks, rejects (path, error) and figures of the run. Without a difference nothing is written, unless a batch's number is to
        be kept."""
        old, m = self.times(), self.manifest()
        gone, fresh, edited = diff.removed(old, current), diff.added(old, current), diff.changed(old, current)
        todo = fresh.unionByName(edited)
        if batch < 0 and gone.isEmpty() and todo.isEmpty():
            return m
        wanted = current.join(todo, "path", "left_semi")
        rows, rejects, stats = make(wanted)
        return self.upsert(rows, wanted.select("path", "mtime"), gone, rejects=rejects, batch=batch, stats=stats)[0]
