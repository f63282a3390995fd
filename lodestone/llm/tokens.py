"""Token counts by offset-mapped attribution.

Each document is encoded whole, once. A byte-level BPE token covers a known
number of bytes, so the running sum of the tokens' lengths gives their spans,
which are interval-joined (a sorted merge) to the document's sections.

Sections are given as end offsets in code points that tile the text: section k
runs from the end of the one before to its own. A token that crosses a boundary
is allocated by rule:

* ``start`` - to the section of its first byte;
* ``most`` - to the section with most of its bytes, the earlier on a tie;
* ``split`` - to each section by its share of the token's bytes.

Under each rule the counts of a document's sections add up to its tokens.

Defined results: a null or empty text has no tokens; its sections, if any, count
0. Text after the last given end belongs to a section named ``rest``. Ends
outside the text are held to it, and one that is null or before the end before it equals
that one, so its section is empty; a null section has neither name nor text. Ties of ``most`` go to the earlier section. Rows are counted one by one,
repeated or not. Very long texts are encoded whole. Columns named ``n_tokens`` and ``section_tokens`` are replaced, other
columns stay. An empty table gives an empty result. The vocabulary's path is a parameter; tokenizers aren't trained.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, fresh, plus, read

VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the vocabulary (public, GPT-2's).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("start", "most", "split")
_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """The encoding and the byte length of each of its ids, loaded once in a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            sizes[i] = len(piece)
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[path]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; both arrays hold ascending byte offsets and end together."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    k = len(section_ends)
    first = np.searchsorted(section_ends, starts, "right")
    if rule == "start" or not len(starts):
        return np.bincount(first, minlength=k)[:k].astype(np.float64)
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    out = np.bincount(first[first == last], minlength=k)[:k].astype(np.float64)
    for i in np.flatnonzero(first != last).tolist():
        span = np.arange(first[i], last[i] + 1)
        part = np.minimum(section_ends[span], token_ends[i]) - np.maximum(np.where(span > 0, section_ends[span - 1], 0), starts[i])
        if rule == "most":
            out[span[part.argmax()]] += 1
        else:
            out[span] += part / part.sum()
    return out


def held_ends(ends: list[int | None], size: int) -> list[int]:
    """Ends that ascend within a text of ``size``: none is before the one before it, and a null one equals that."""
    out, at = [], 0
    for e in ends:
        at = max(at, min(at if e is None else e, size))
        out.append(at)
    return out


def section_tokens(docs: DataFrame, sections: Column, *, text_col: str = "text", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with section_tokens: an array of (name, start, end, n_tokens), and n_tokens of the whole text.

    ``sections`` is an array of structs (name string, end bigint) that tile the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)
    held, = fresh(docs, "held_sections")
    keep = [c for c in docs.columns if c not in ("n_tokens", "section_tokens")]
    df = docs.select(*keep, sections.cast("array<struct<name:string,end:bigint>>").alias(held))
    schema = plus(docs, keep, "n_tokens bigint, section_tokens array<struct<name:string,start:bigint,end:bigint,n_tokens:double>>")
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())]))

    def count(batches):
        encoding, sizes = encoder(vocabulary)
        for b in batches:
            totals, found = [], []
            for text, own in zip(b.column(text_col).to_pylist(), b.column(held).to_pylist(), strict=True):
                text = text or ""
                names, ends = [x and x["name"] for x in own or ()], held_ends([x and x["end"] for x in own or ()], len(text))
                if (ends[-1] if ends else 0) < len(text):
                    names, ends = [*names, "rest"], [*ends, len(text)]
                ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                token_ends = np.cumsum(sizes[ids])
                if len(ends) and len(text) == (token_ends[-1] if len(ids) else 0):
                    at = np.array(ends)
                else:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    at = lead[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64)
                n = attribute(token_ends, at, rule)
                totals.append(len(ids))
                found.append([{"name": m, "start": s, "end": e, "n_tokens": x} for m, s, e, x in zip(names, [0, *ends], ends, n.tolist(), strict=False)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(totals, pa.int64()), pa.array(found, kind)], names=[*keep, "n_tokens", "section_tokens"])

    return df.transform(arrow, count, schema)


def head_body_tail(text: Column) -> Column:
    """Sections of a document: its first line, its last line, and what lies between, each with its line feed."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    first = F.locate("\n", text).cast("bigint")
    last = n - F.locate("\n", F.reverse(text)).cast("bigint") + 1
    part = lambda name, end: F.struct(F.lit(name).alias("name"), end.cast("bigint").alias("end"))
    return F.when(first == 0, F.array(part("head", n))).when(first == last, F.array(part("head", first), part("tail", n))).otherwise(F.array(part("head", first), part("body", last), part("tail", n)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, start, n_chars, n_tokens (by the token's first byte) and doc_tokens for each section."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = section_tokens(docs, head_body_tail(F.col("text")), rule="start").drop("text")
    each = counted.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode_outer("section_tokens").alias("s"))
    return each.select("doc_id", F.col("s.name").alias("section"), F.col("s.start").alias("start_char"), (F.col("s.end") - F.col("s.start")).alias("n_chars"), F.col("s.n_tokens").cast("bigint").alias("n_tokens"), "doc_tokens")
