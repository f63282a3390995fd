"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are reduced to lower-case words (A-Z only is lowered; word characters are
digits, ASCII letters and everything from U+0080). The automaton holds every
window of ``window`` consecutive words of every benchmark item; an item with
fewer words is one window. Each text is scanned once, and hits are mapped back
to words and to code-point offsets of the original text.

Defined results: an empty table gives an empty result; a text of any length is
scanned whole; a null or empty text has no words and no hits; items without
words, and items without an id, are ignored; repeated rows are scored row by
row; an empty benchmark hits nothing. Other columns of the input stay; where one
has the name of a result, the result replaces it.

The automaton is bounded: the windows, those of one item too if it is long, are
split into shards of at most ``shard_bytes`` of window text, which bounds the
automaton's nodes. A larger benchmark takes more passes, one job after another
with what was found so far written between them, so one worker holds one
automaton at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, drop_stored, fresh, plus, read, stored
from .textkit import ALNUM, LOWER

WINDOW = 10
#: Bytes of the windows of one pass; an automaton takes about 45 bytes for each.
SHARD_BYTES = 4 << 20
_TO_WORDS = bytes(int(LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))
_automata: dict[str, object] = {}


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    """The windows of one item, as ' w1 w2 ... ' keys."""
    w = split_words(text)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + window]) + b" " for i in range(max(1, len(w) - window + 1))}


def _automaton(tag: str, shard):
    """Built once in each worker process from the broadcast windows."""
    import ahocorasick

    if tag not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for key, ids in shard.value.items():
            a.add_word(key.decode("latin-1"), (key.count(b" ") - 1, ids))
        if len(a):
            a.make_automaton()
        _automata[tag] = a
    return _automata[tag]


def _scan(raw: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, the word ranges hit (merged), and the items they come from."""
    w = raw.translate(_TO_WORDS).split()
    if not w or not len(automaton):
        return len(w), [], set()
    line = b" " + b" ".join(w) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(w), [], set()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    last = np.searchsorted(gaps, [end for end, _ in found])
    ranges, ids = [], set()
    for stop, (_, (n, who)) in zip(last.tolist(), found, strict=True):
        ids.update(who)
        ranges.append((stop - n, stop))
    return len(w), merged(ranges), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges made one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of words."""
    if not ranges:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ALNUM[raw]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


def _shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_bytes: int):
    """Dicts of window to item ids, each under the bound; items come to the driver one at a time."""
    shard: dict[bytes, list[str]] = defaultdict(list)
    size = 0
    for r in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        for key in sorted(windows_of(r.t, window)):
            if key not in shard:
                size += len(key)
            if r.i not in shard[key]:
                shard[key].append(r.i)
            if size >= shard_bytes:
                yield dict(shard)
                shard, size = defaultdict(list), 0
    yield dict(shard)


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, spans: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out_names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    held, ranges, who = fresh(docs, "held_text", "held_ranges", "held_items")
    df = docs.withColumn(held, F.col(text_col).cast("string"))
    df = df.drop(*[c for c in out_names if c in df.columns])
    base = [c for c in df.columns if c != held]
    state = plus(df, df.columns, f"`{ranges}` array<struct<a:bigint,b:bigint>>, `{who}` array<string>")
    result = plus(df, base, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<start:bigint,end:bigint>>")
    shards, number = _shards(items, item_id, item_text, window, shard_bytes), 0
    shard = next(shards)
    while shard is not None:
        after = next(shards, None)
        scan = _pass(uuid.uuid4().hex, spark.sparkContext.broadcast(shard), base, held, ranges, who, number == 0, after is None, spans)
        earlier, df = df, df.transform(arrow, scan, result if after is None else state)
        if after is not None:
            df = stored(df, "scanned")
            if number:
                drop_stored(earlier)
        shard, number = after, number + 1
    return df


def _pass(tag: str, shard, base: list[str], held: str, ranges: str, who: str, first: bool, last: bool, spans: bool):
    """A task's scan of the held texts with one shard, added to what earlier shards found; the last one gives the results."""
    kind, marked = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        a = _automaton(tag, shard)
        for b in batches:
            texts = b.column(held)
            raw = texts.cast(pa.large_binary())
            n, hits, ids = [], [], []
            for i in range(b.num_rows):
                k, r, w = _scan(raw[i].as_py() or b"", a)
                n.append(k)
                hits.append(r)
                ids.append(w)
            if not first:
                hits = [merged([*r, *((x["a"], x["b"]) for x in old)]) for r, old in zip(hits, b.column(ranges).to_pylist(), strict=True)]
                ids = [w.union(old) for w, old in zip(ids, b.column(who).to_pylist(), strict=True)]
            cols = [b.column(c) for c in base]
            if not last:
                state = [pa.array([[{"a": x, "b": y} for x, y in r] for r in hits], kind), pa.array([sorted(w) for w in ids], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, texts, *state], names=[*base, held, ranges, who])
                continue
            n_hit = [sum(y - x for x, y in r) for r in hits]
            marks = [[{"start": s, "end": e} for s, e in char_spans(texts[i].as_py(), r)] if spans and r else [] for i, r in enumerate(hits)]
            digests = [hashlib.sha256(",".join(sorted(w)).encode()).hexdigest() for w in ids]
            cols += [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(digests, pa.string()), pa.array([k > 0 for k in n_hit], pa.bool_()), pa.array(marks, marked)]
            yield pa.RecordBatch.from_arrays(cols, names=[*base, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    return scan


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, with the columns they had."""
    out = contamination(docs, items, spans=False, **options)
    return out.where(~F.col("contaminated")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read(spark, sf_dir, "benchmark"), spans=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, coalesce(w, []) AS w FROM dw),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
         FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bi)),
ks AS (SELECT DISTINCT k FROM wins),
dwin AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
         FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dwin.k FROM dwin JOIN wins ON dwin.k = wins.k AND dwin.win = wins.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
