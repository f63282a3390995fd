"""Word boundaries against the standard's rules applied one place at a time, places, windows and their cost."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import segment as S
from lodestone.operators.chunking import ChunkConfig, chunk_counts, chunks

TABLE = S.Table(S.ranges())


def kind(c):
    import regex

    for name in S.CLASSES[1:]:
        if regex.fullmatch(rf"\p{{Word_Break={name}}}", c):
            return name
    return "Other"


def boundary(text, i):
    """Whether the rules break before place i, read in the order the standard gives them."""
    import regex

    k = [kind(c) for c in text]
    skip = ("Extend", "Format", "ZWJ")
    letters, quote = ("ALetter", "Hebrew_Letter"), ("MidNumLet", "Single_Quote")
    if k[i - 1] == "CR" and k[i] == "LF":
        return False
    if k[i - 1] in ("CR", "LF", "Newline") or k[i] in ("CR", "LF", "Newline"):
        return True
    if k[i - 1] == "ZWJ" and regex.fullmatch(r"\p{Extended_Pictographic}", text[i]):
        return False
    if k[i - 1] == k[i] == "WSegSpace":
        return False
    if k[i] in skip:
        return False

    def back(j):
        """The place of the last class before j that isn't skipped; a skipped one stands for itself at the start of a line."""
        j -= 1
        while j >= 0 and k[j] in skip and j > 0 and k[j - 1] not in ("CR", "LF", "Newline"):
            j -= 1
        return j

    def on(j):
        j += 1
        while j < len(k) and k[j] in skip:
            j += 1
        return k[j] if j < len(k) else None

    p = back(i)
    a, b = k[p], k[i]
    q = back(p)
    before = k[q] if q >= 0 and p > 0 else None
    after = on(i)
    if a in letters and b in letters:
        return False
    if a in letters and b in ("MidLetter", *quote) and after in letters:
        return False
    if before in letters and a in ("MidLetter", *quote) and b in letters:
        return False
    if a == "Hebrew_Letter" and b == "Single_Quote":
        return False
    if a == "Hebrew_Letter" and b == "Double_Quote" and after == "Hebrew_Letter":
        return False
    if before == "Hebrew_Letter" and a == "Double_Quote" and b == "Hebrew_Letter":
        return False
    if a == "Numeric" and b == "Numeric" or a in letters and b == "Numeric" or a == "Numeric" and b in letters:
        return False
    if before == "Numeric" and a in ("MidNum", *quote) and b == "Numeric":
        return False
    if a == "Numeric" and b in ("MidNum", *quote) and after == "Numeric":
        return False
    if a == b == "Katakana":
        return False
    if a in (*letters, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet":
        return False
    if a == "ExtendNumLet" and b in (*letters, "Numeric", "Katakana"):
        return False
    if a == b == "Regional_Indicator":
        n, j = 0, i
        while (j := back(j)) >= 0 and k[j] == "Regional_Indicator":
            n += 1
        return n % 2 == 0
    return True


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


SIGNS = ["a", "é", "ß", "א", "1", "٣", "'", '"', ".", "’", ":", ",", ";", "_", "カ", "ー", "漢", "ひ", " ", " ", "　", "\r", "\n", " ", "́", "‍", "­", "🇩", "🇪", "👩", "❤", "-", "\t"]


def test_rules_one_place_at_a_time():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(SIGNS) for _ in range(r.randrange(1, 9)))
        assert TABLE.starts(points(t)).tolist() == [0, *(i for i in range(1, len(t)) if boundary(t, i))], ascii(t)


@pytest.mark.parametrize(
    "text, words",
    [
        ("Hello, world! This is a test.", ["Hello", "world", "This", "is", "a", "test"]),
        ("The quick (\"brown\") fox can't jump 32.3 feet, right?", ["The", "quick", "brown", "fox", "can't", "jump", "32.3", "feet", "right"]),
        ("don't 1,234.5 a.b a.1 1:2 snake_case _ é__ __x", ["don't", "1,234.5", "a.b", "a", "1", "1", "2", "snake_case", "é__", "__x"]),
        ("漢字かなカタカナ", ["漢", "字", "か", "な", "カタカナ"]),
        ("naïve née 🇩🇪🇫 👩‍❤", ["naïve", "née"]),
        ('צה"ל ג\'ון', ['צה"ל', "ג'ון"]),
        ("", []),
        (" \n\t", []),
    ],
)
def test_words(spark, text, words):
    rows = spark.createDataFrame([(text,), (None,), ("x " + text,)], "t string").coalesce(1)
    got = rows.select(S.words(F.col("t")).alias("w"), S.word_count(F.col("t")).alias("n"), S.places(F.col("t")).alias("p")).collect()
    assert [r.w for r in got] == [words, None, ["x", *words]] and [r.n for r in got] == [len(words), None, len(words) + 1]
    for t, r in zip([text, None, "x " + text], got):
        assert t is None and r.p is None or [t[p.start : p.end] for p in r.p] == r.w
        assert t is None or [t.encode()[p.start_byte : p.end_byte].decode() for p in r.p] == r.w
        assert t is None or [p.line for p in r.p] == [1 + t[: p.start].count("\n") for p in r.p]


def test_texts_of_a_slice_dont_touch():
    texts = ["ab", "cd", "", "1", ".2", "🇩", "🇪", "́x", "a.", "b"]
    w = S.Words(TABLE, texts)
    assert [w.of(i) for i in range(len(texts))] == [S.Words(TABLE, [t]).of(0) for t in texts]
    assert list(S.slices(["x"] * 3)) == [(0, 3)] and list(S.slices(["y" * S.SLICE, "z", None])) == [(0, 1), (1, 3)]


def test_windows_hold_the_words_of_their_places(spark):
    r = random.Random(5)
    texts = [(f"f{i}", "".join(r.choice(["wort ", "naïve, ", "漢字", "\n", "1.5 ", "🙂 "]) for _ in range(r.randrange(0, 400)))) for i in range(40)]
    c = ChunkConfig(12, 3, 15, 5)
    body = dict(texts)
    rows = chunks(spark.createDataFrame(texts, "path string, text string"), c).collect()
    for x in rows:
        t = body[x.file_path]
        part = t[x.start_char : x.end_char]
        assert (part == x.content) if x.total_chunks == 1 and x.token_count <= 12 and part == t else S.Words(TABLE, [part]).of(0) == x.content.split(" ")
        if part != t:
            assert (x.start_line, x.end_line) == (1 + t[: x.start_char].count("\n"), 1 + t[: x.end_char].count("\n"))
    counts = chunk_counts(spark.createDataFrame(texts, "path string, text string"), c).collect()
    assert sorted((x.file_path, x.token_count) for x in counts) == sorted((x.file_path, x.token_count) for x in rows)


def test_forty_thousand_words_take_under_half_a_second():
    text = " ".join(f"wort{i % 977}," for i in range(40_000)) + "\n"
    S.Words(TABLE, [text])
    began = time.perf_counter()
    w = S.Words(TABLE, [text])
    w.feeds(), w.bytes(), w.of(0)
    assert time.perf_counter() - began < 0.5 and int(w.counts[0]) == 40_000
    assert isinstance(S._lists(w.first, pa.array(w.of(0))), pa.ListArray)
