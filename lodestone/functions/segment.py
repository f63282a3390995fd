"""Words of a text by Unicode's default word boundaries, with their places, a batch of texts at a time.

A text is an array of code points. Each has a Word_Break class, from a table; whether
two neighbours are held together follows from their classes, and for a few pairs
from one more class before or after, once marks and format characters are taken for part
of what precedes them. All texts of a slice are handled by the same array operations, so the cost
is linear in the text. A segment with a letter or number is a word.

Places count code points or bytes; lines are found from running counts of line feeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Word_Break classes of the Unicode standard that the rules name.
CLASSES = (
    "Other", "CR", "LF", "Newline", "Extend", "ZWJ", "Regional_Indicator", "Format", "Katakana", "Hebrew_Letter", "ALetter",
    "Single_Quote", "Double_Quote", "MidNumLet", "MidLetter", "MidNum", "Numeric", "ExtendNumLet", "WSegSpace",
)
_ID = {c: i for i, c in enumerate(CLASSES)}
_PICTURE, _WORDLIKE, _CLASS = 64, 128, 31
#: Code points that are handled at once, at least one text.
SLICE = 1 << 17
_LETTER = ("ALetter", "Hebrew_Letter")
_BREAK, _HOLD, _LETTER_AHEAD, _LETTER_BEHIND, _HEBREW_AHEAD, _HEBREW_BEHIND, _NUMBER_AHEAD, _NUMBER_BEHIND, _FLAGS, _SPACES = range(10)


@lru_cache(maxsize=1)
def ranges() -> tuple[np.ndarray, np.ndarray]:
    """The table as runs: where each starts and its value (class, picture and letter-or-number bits)."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    at = np.array(points, np.int64)
    value = np.zeros(0x110000, np.uint8)

    def put(pattern: str, bits: int) -> None:
        for m in regex.finditer(f"(?:{pattern})+", every):
            value[at[m.start() : m.end()]] |= bits

    for name in CLASSES[1:]:
        put(rf"\p{{Word_Break={name}}}", _ID[name])
    put(r"\p{Extended_Pictographic}", _PICTURE)
    put(r"[\p{Alphabetic}\p{N}]", _WORDLIKE)
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return starts, value[starts]


def _pairs() -> np.ndarray:
    """What holds for a class followed by another."""
    out = np.full((len(CLASSES), len(CLASSES)), _BREAK, np.uint8)

    def put(before, after, rule: int) -> None:
        for a in before:
            for b in after:
                out[_ID[a], _ID[b]] = rule

    number, kana, joiner = ("Numeric",), ("Katakana",), ("ExtendNumLet",)
    in_words, in_numbers = ("MidLetter", "MidNumLet", "Single_Quote"), ("MidNum", "MidNumLet", "Single_Quote")
    put(("CR",), ("LF",), _HOLD)
    put(("WSegSpace",), ("WSegSpace",), _SPACES)
    put((*_LETTER, *number), (*_LETTER, *number), _HOLD)
    put(_LETTER, in_words, _LETTER_AHEAD)
    put(in_words, _LETTER, _LETTER_BEHIND)
    put(("Hebrew_Letter",), ("Single_Quote",), _HOLD)
    put(("Hebrew_Letter",), ("Double_Quote",), _HEBREW_AHEAD)
    put(("Double_Quote",), ("Hebrew_Letter",), _HEBREW_BEHIND)
    put(in_numbers, number, _NUMBER_BEHIND)
    put(number, in_numbers, _NUMBER_AHEAD)
    put(kana, kana, _HOLD)
    put((*_LETTER, *number, *kana, *joiner), joiner, _HOLD)
    put(joiner, (*_LETTER, *number, *kana), _HOLD)
    put(("Regional_Indicator",), ("Regional_Indicator",), _FLAGS)
    return out


class Table:
    """Word boundaries by table; ``runs`` is what ``ranges`` returns and may be sent to tasks."""

    def __init__(self, runs: tuple[np.ndarray, np.ndarray]):
        starts, values = runs
        self.value = np.repeat(values, np.diff(np.concatenate([starts, [0x110000]])))
        self.pairs = _pairs()

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Where segments start in an array of code points, ascending; the first starts at 0."""
        if not len(points):
            return np.zeros(0, np.int64)
        value = self.value[points]
        kind = value & _CLASS
        line_end = (kind >= _ID["CR"]) & (kind <= _ID["Newline"])
        follows = (kind == _ID["Extend"]) | (kind == _ID["Format"]) | (kind == _ID["ZWJ"])
        follows[0] = False
        follows[1:] &= ~line_end[:-1]
        base = np.flatnonzero(~follows)
        b = kind[base]
        rule = self.pairs[b[:-1], b[1:]]
        hold = rule == _HOLD
        odd = np.flatnonzero(rule > _HOLD)
        if len(odd):
            r = rule[odd]
            ahead = np.where(odd + 2 < len(b), b[np.minimum(odd + 2, len(b) - 1)], 0)
            behind = np.where(odd > 0, b[np.maximum(odd - 1, 0)], 0)
            letter = lambda k: (k == _ID["ALetter"]) | (k == _ID["Hebrew_Letter"])
            keep = (r == _LETTER_AHEAD) & letter(ahead) | (r == _LETTER_BEHIND) & letter(behind)
            keep |= (r == _HEBREW_AHEAD) & (ahead == _ID["Hebrew_Letter"]) | (r == _HEBREW_BEHIND) & (behind == _ID["Hebrew_Letter"])
            keep |= (r == _NUMBER_AHEAD) & (ahead == _ID["Numeric"]) | (r == _NUMBER_BEHIND) & (behind == _ID["Numeric"])
            keep |= (r == _SPACES) & (base[odd + 1] == base[odd] + 1)
            flags = np.flatnonzero(r == _FLAGS)
            if len(flags):
                # indicators pair up from the start of their run
                at = odd[flags]
                first = np.concatenate([[True], np.diff(at) > 1])
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                keep[flags] = (np.arange(len(at)) - run) % 2 == 0
            hold[odd] = keep
        # a joiner holds a picture, whatever it follows
        after = base[1:]
        hold |= (kind[after - 1] == _ID["ZWJ"]) & (value[after] & _PICTURE != 0)
        return np.concatenate([base[:1], after[~hold]])

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        starts = self.starts(points)
        if not len(starts):
            return starts, starts
        ends = np.concatenate([starts[1:], [len(points)]])
        like = np.concatenate([[0], np.cumsum(self.value[points] >= _WORDLIKE)])
        some = like[ends] > like[starts]
        return starts[some], ends[some]


class Words:
    """The words of several texts: ``first`` (texts + 1 places in the lists below), starts and ends within their text."""

    def __init__(self, table: Table, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # a line feed after each text keeps the texts apart
        self.points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        starts, ends = table.words(self.points)
        self.first = np.searchsorted(starts, self.at)
        self.counts = np.diff(self.first)
        text = np.repeat(self.at[:-1], self.counts)
        self.starts, self.ends = starts - text, ends - text

    def of(self, i: int) -> list[str]:
        t, lo, hi = self.texts[i], self.first[i], self.first[i + 1]
        return [t[a:b] for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]

    def feeds(self) -> np.ndarray:
        """Line feeds before each place."""
        return np.concatenate([[0], np.cumsum(self.points == 10)])

    def bytes(self) -> np.ndarray:
        """UTF-8 bytes before each place."""
        p = self.points
        return np.concatenate([[0], np.cumsum(1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF), dtype=np.int64)])


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``SLICE`` code points."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= SLICE:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _by_slice(runs, make):
    """An Arrow UDF body from one that answers for the words of a slice; a null text answers null."""
    held: list[Table] = []

    def f(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Table(runs))
        texts = column.to_pylist()
        out = [x for lo, hi in slices(texts) for x in [make(Words(held[0], [t or "" for t in texts[lo:hi]]))]]
        whole = pa.concat_arrays(out) if out else make(Words(held[0], []))
        nulls = np.flatnonzero([t is None for t in texts])
        if not len(nulls):
            return whole
        keep = np.arange(len(texts))
        return whole.take(pa.array(keep, mask=np.isin(keep, nulls)))

    return f


def _lists(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def _udf(make, result: str) -> Column:
    body = _by_slice(ranges(), make)

    @F.arrow_udf(result)
    def f(column: pa.Array) -> pa.Array:
        return body(column)

    return f


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return _udf(lambda w: _lists(w.first - w.first[0], pa.array([x for i in range(len(w.texts)) for x in w.of(i)], pa.string())), "array<string>")(text)


def word_count(text: Column) -> Column:
    return _udf(lambda w: pa.array(w.counts, pa.int64()), "bigint")(text)


PLACES = "start bigint, end bigint, start_byte bigint, end_byte bigint, line bigint"


def places(text: Column) -> Column:
    """start, end (code points), start_byte, end_byte and line (from 1) of each word."""

    def make(w: Words) -> pa.Array:
        feeds, size = w.feeds(), w.bytes()
        text = np.repeat(w.at[:-1], w.counts)
        a, b = text + w.starts, text + w.ends
        columns = [w.starts, w.ends, size[a] - size[text], size[b] - size[text], 1 + feeds[a] - feeds[text]]
        names = [x.split()[0] for x in PLACES.split(", ")]
        return _lists(w.first - w.first[0], pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names))

    return _udf(make, f"array<struct<{PLACES.replace(' bigint', ':bigint')}>>")(text)
