"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has a variable-order byte context tree: for every context of up to
``order`` bytes the counts of the next byte, and an escape probability
d / (n + d) with d distinct next bytes among n. A byte costs -log2 of its
probability in the longest context that has seen it, plus the escapes on the way
there; a byte no context has seen costs 8 bits. Statistics are frozen after
training, so a text's code length is a sum of table look-ups and is exact. The
language with the shortest code wins.

Training is on a bounded sample of labelled rows: at most ``sample_docs`` documents
per language, whole, chosen by a hash of their id; texts of over ``long_chars``
characters are only taken where a language has too few others. There may be at most
``MOST_LANGUAGES`` languages, which is checked. Every text is scored whole.

Defined results: an empty table gives an empty result; a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Ties go to the first language in
order of name. Rows are scored one by one, repeated or not; other columns stay,
and a column named lang_pred or score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, fresh, plus, read, remainder, trim
from .textkit import LOWER, mix64, slices, utf8

ORDER = 4
SAMPLE_DOCS = 200
LONG_CHARS = 16_384
MOST_LANGUAGES = 1000
#: The score is the posterior as it would be from so many bytes at the text's mean code length per byte.
EVIDENCE_BYTES = 64
SLICE = 1 << 16


def _contexts(buf: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order the key of (last k bytes, byte) at each place; before a text stand zero bytes."""
    low = LOWER[buf].astype(np.uint64)
    keys = [low.copy()]
    place = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        prior = np.zeros_like(low)
        prior[k:] = low[:-k] if k < len(low) or k == len(low) else 0
        prior[place < k] = 0
        keys.append(keys[-1] | (prior << np.uint64(8 * k)))
    return keys


class Lookup:
    """A frozen open-addressing table from 64-bit keys to rows, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.probes = 0
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]] = left[won]
            self.keys[at[won]] = keys[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for those not there."""
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.slots[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at_ = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_
            hit = self.keys[at_] == keys[open_]
            out[open_[hit]] = self.slots[at_[hit]]
            open_ = open_[~hit & (self.slots[at_] >= 0)]
        return out


class Model:
    """The context trees of all languages, merged: each known (context, byte) has a code length by language."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        n_lang = len(self.languages)
        seen: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.languages:
            buf, offsets = utf8(pa.array(samples[lang], pa.string()))
            seen.append({k: np.unique(keys, return_counts=True) for k, keys in enumerate(_contexts(buf, offsets, order))} if len(buf) else {})
        self.base = np.full((256, n_lang), 8.0)
        self.tables: list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]] = []
        for k in range(order + 1):
            if not any(seen):
                break
            keys = np.unique(np.concatenate([s[k][0] for s in seen if s]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), n_lang))
            code = self._lower(keys, k)
            for j, s in enumerate(seen):
                if not s:
                    continue
                own, count = s[k]
                ctx, start = np.unique(own >> np.uint64(8), return_index=True)
                n, d = np.add.reduceat(count, start), np.diff(np.append(start, len(own)))
                where = np.searchsorted(contexts, ctx)
                escape[where, j] = np.log2((n + d) / d)
                code[:, j] += escape[np.searchsorted(contexts, keys >> np.uint64(8)), j]
                total = np.repeat(n + d, d)
                code[np.searchsorted(keys, own), j] = np.log2(total / count)
            self.tables.append((Lookup(keys), code.astype(np.float32), Lookup(contexts), escape.astype(np.float32)))

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the same bytes in contexts shorter by one."""
        mask = np.uint64((1 << (8 * k)) - 1 if k else 0xFF)
        return self.code_lengths([keys & np.uint64((1 << (8 * (j + 1))) - 1) for j in range(k)]) if k else self.base[(keys & mask).astype(np.int64)].copy()

    def code_lengths(self, keys: list[np.ndarray]) -> np.ndarray:
        """Bits of each place by language; keys[k] are the places' keys of order k."""
        out = np.zeros((len(keys[0]), len(self.languages)), np.float64 if len(keys) <= self.order else np.float32)
        left = np.arange(len(out))
        for k in range(len(keys) - 1, -1, -1):
            table, code, contexts, escape = self.tables[k]
            q = keys[k][left]
            row = table.find(q)
            hit = row >= 0
            out[left[hit]] += code[row[hit]]
            left, q = left[~hit], q[~hit]
            if not len(left):
                return out
            ctx = contexts.find(q >> np.uint64(8))
            some = ctx >= 0
            out[left[some]] += escape[ctx[some]]
        out[left] += 8
        return out

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each text by language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not self.tables:
            return out
        for first, last, part, at in slices(buf, offsets, SLICE):
            if len(part):
                each = self.code_lengths(_contexts(part, at, self.order))
                total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
                out[first:last] = total[at[1:]] - total[at[:-1]]
        return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, long_chars: int = LONG_CHARS) -> Model:
    """Learn from the rows given; only ids are ranked, and the texts of those chosen are fetched."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where("l is not null and t is not null and t <> ''")
    order_by = Window.partitionBy("l").orderBy("long", F.xxhash64("i"), "i")
    ranked = rows.select("i", "l", (F.char_length("t") > long_chars).alias("long")).withColumn("r", F.row_number().over(order_by))
    chosen = ranked.where(F.col("r") <= sample_docs).select("i", "l").distinct().limit(MOST_LANGUAGES * sample_docs + 1).toArrow()
    if chosen.num_rows > MOST_LANGUAGES * sample_docs:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = docs.sparkSession.createDataFrame(chosen) if chosen.num_rows else rows.select("i", "l").limit(0)
    picked = rows.join(F.broadcast(wanted), ["i", "l"], "left_semi").groupBy("i", "l").agg(F.min("t").alias("t"))
    samples: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():
        samples.setdefault(r.l, []).append(r.t)
    model = Model({k: sorted(v) for k, v in samples.items()}, order)
    trim()
    return model


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters, = fresh(docs, "has_letter")
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    df = docs.select(*keep).withColumn(letters, F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = plus(df, keep, "lang_pred string, score double")

    def predict(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            buf, offsets = utf8(b.column(text_col))
            bits = m.bits(buf, offsets)
            known = np.array(b.column(letters).to_pylist(), bool) & bool(m.tables)
            if bits.shape[1]:
                best = np.where(known, bits.argmin(axis=1), len(m.languages))
                more = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE_BYTES / np.maximum(1, np.diff(offsets)))[:, None]
                score = np.where(known, 1 / np.exp2(-more).sum(axis=1), 0.0)
            else:
                best, score = np.zeros(len(known), int), np.zeros(len(known))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.transform(arrow, predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = remainder(F.col("doc_id"), 5)
    model = train(docs.where(rest != 0))
    out = identify(docs.select("doc_id", (rest == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
