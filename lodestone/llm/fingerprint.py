"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs are its non-empty runs between line feeds. Each is hashed to
a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors:

* ``EXACT`` lanes of 64 bits, the paragraph's BLAKE2b digest of 512 bits, summed modulo 2^64;
* ``LIKE`` lanes of 16 bits, the signed count sketch of the paragraph's 2-word
  shingles (a lone word counts as one), summed modulo 2^16.

So equal texts, and texts with the same paragraphs in any order, have equal
fingerprints; ``combine`` adds or takes away paragraphs without the other text.
The cosine of the second parts estimates that of the shingle counts, with a
standard error of 1/16; ``likeness`` is that estimate held to 0..1, and exactly 1
for equal fingerprints.

Defined results: a null text is the empty text, whose fingerprint is all zeros;
the likeness of an empty text to another is 0. Documents follow each other by
id, nulls first, then by text; after the last comes the first. Repeated rows
stay. A lone document is its own successor. A text of any length is hashed whole. An empty
table gives an empty result. Other columns don't enter.

Plan: ids are cut into ranges by approximate quantiles, texts are shuffled once
to their range, and the first document of a range is also sent to the range
before it, so no task needs more than its own range and one more document.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, read
from .textkit import LOWER, NOT_SPACE, pair_hashes, slices, span_hashes, utf8, words

EXACT, LIKE = 8, 256
RANGE_ROWS = 4096
MOST_RANGES = 1 << 16
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint: (rows, EXACT) uint64 and (rows, LIKE) uint16."""
    rows = len(offsets) - 1
    exact, like = np.zeros((rows, EXACT), np.uint64), np.zeros((rows, LIKE), np.uint16)
    for first, last, part, at in slices(buf, offsets):
        starts, ends, bounds = words(part, at, _LINE)
        if not len(starts):
            continue
        some, raw = np.flatnonzero(np.diff(bounds)), part.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        exact[first + some] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EXACT), bounds[some], axis=0)
        low = LOWER[part]
        w0, w1, inside = words(low, np.append(starts, len(low)), NOT_SPACE)
        units, paragraph = pair_hashes(span_hashes(low, w0, w1), inside)
        row = (np.searchsorted(bounds, np.arange(len(starts)), "right") - 1)[paragraph]
        lane = row * LIKE + (units & np.uint64(LIKE - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((units >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        like[first:last] = np.bincount(lane, sign, (last - first) * LIKE).astype(np.int64).astype(np.uint16).reshape(-1, LIKE)
    return exact, like


def encode(exact: np.ndarray, like: np.ndarray) -> list[str]:
    raw = np.concatenate([exact.astype(">u8").view(np.uint8).reshape(len(exact), -1), like.astype(">u2").view(np.uint8).reshape(len(like), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, ">u8", EXACT).astype(np.uint64), np.frombuffer(raw, ">u2", LIKE, EXACT * 8).astype(np.uint16)


def fingerprint(text: str | None) -> str:
    return encode(*vectors(*utf8(pa.array([text or ""], pa.string()))))[0]


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a's paragraphs with b's added (sign 1) or taken away (-1)."""
    (x, u), (y, v) = decode(a), decode(b)
    return encode(*((p[None] + q[None]) if sign > 0 else (p[None] - q[None]) for p, q in ((x, y), (u, v))))[0]


def likeness(exact_a, like_a, exact_b, like_b) -> np.ndarray:
    """Row by row, 0 to 1."""
    a, b = like_a.view(np.int16).astype(np.float64), like_b.view(np.int16).astype(np.float64)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.divide((a * b).sum(axis=1), norm, out=np.zeros(len(a)), where=norm > 0)
    same = (exact_a == exact_b).all(axis=1) & (like_a == like_b).all(axis=1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def _edges(ids: DataFrame) -> np.ndarray:
    """Lower bounds of id ranges, the first open; as many as the rows ask for, under MOST_RANGES."""
    n = ids.count()
    k = int(min(MOST_RANGES, max(1, n // RANGE_ROWS)))
    if k == 1:
        return np.zeros(0, np.int64)
    cuts = ids.approxQuantile("id", [i / k for i in range(1, k)], 0.1 / k if k > 100 else 0.001)
    return np.unique(np.array(cuts, np.float64).astype(np.int64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rank = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    ids = base.select(rank.alias("id"))
    edges = _edges(ids)
    dealt = base.withColumn("rank", rank)
    bucket = F.lit(0).cast("int")
    if len(edges):
        cuts = spark.sparkContext.broadcast(edges)

        def place(batches):
            for b in batches:
                k = np.searchsorted(cuts.value, b.column("rank").to_numpy(), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k)], names=[*b.schema.names, "bucket"])

        least = {r.bucket: r.least for r in ids.withColumnRenamed("id", "rank").transform(arrow, place, "rank:bigint,bucket:int").groupBy("bucket").agg(F.min("rank").alias("least")).collect()}
    else:
        least = {r.bucket: r.least for r in dealt.groupBy(bucket.alias("bucket")).agg(F.min("rank").alias("least")).collect()}
    order = sorted(least)
    heads = spark.sparkContext.broadcast({least[k]: order[i - 1] for i, k in enumerate(order)})
    all_cuts = spark.sparkContext.broadcast(edges)

    def deal(batches):
        lead_ranks = np.array(sorted(heads.value), np.int64)
        for b in batches:
            ranks = b.column("rank").to_numpy()
            own = np.searchsorted(all_cuts.value, ranks, "right").astype(np.int32)
            names = [*b.schema.names, "bucket", "guest"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.zeros(len(own), np.int32))], names=names)
            lead = np.flatnonzero(np.isin(ranks, lead_ranks))
            if len(lead):
                to = np.array([heads.value[x] for x in ranks[lead].tolist()], np.int32)
                part = b.take(pa.array(lead))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to), pa.array(np.ones(len(to), np.int32))], names=names)

    sent = dealt.transform(arrow, deal, "id:bigint,text:string,rank:bigint,bucket:int,guest:int")
    sent = sent.repartition(len(order) or 1, "bucket").sortWithinPartitions("bucket", "guest", "rank", "text")

    def work(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            held = t.slice(t.num_rows - 1)
            if t.num_rows > 1:
                yield _rows(t.combine_chunks())

    out = sent.transform(arrow, work, "id:bigint,n_chars:bigint,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double,next_id:bigint")
    return out.withColumnRenamed("id", id_col)


def _rows(t: pa.Table) -> pa.RecordBatch:
    """Results of all rows of ``t`` but guests and the last, each followed by its successor."""
    bucket, guest = t.column("bucket").to_numpy(), t.column("guest").to_numpy()
    texts = t.column("text").to_pylist()
    at = np.flatnonzero((guest[:-1] == 0) & (bucket[:-1] == bucket[1:]))
    edited, sizes = [], []
    for i in at.tolist():
        x = texts[i]
        half = len(x) // 2
        edited.append(x[: len(x) - half] + texts[i + 1][:half])
        sizes.append(len(x))
    exact, like = vectors(*utf8(t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")))
    exact_e, like_e = vectors(*utf8(pa.array(edited, pa.string())))
    return pa.RecordBatch.from_arrays(
        [
            t.column("id").combine_chunks().take(pa.array(at)), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array(encode(exact[at], like[at]), pa.string()), pa.array(encode(exact_e, like_e), pa.string()),
            pa.array(likeness(exact[at], like[at], exact_e, like_e)), pa.array(likeness(exact[at], like[at], exact[at + 1], like[at + 1])), t.column("id").combine_chunks().take(pa.array(at + 1)),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("next_id")
