import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import textkit as K


def spans(texts, table=K.NOT_SPACE):
    buf, offsets = K.utf8(pa.array(texts, pa.string()))
    starts, ends, bounds = K.words(buf, offsets, table)
    h = K.span_hashes(buf, starts, ends)
    return [[bytes(buf[starts[i] : ends[i]]) for i in range(bounds[r], bounds[r + 1])] for r in range(len(texts))], h, bounds


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té漢", max_size=12)), max_size=8))
def test_words_equal_split(texts):
    got, _, _ = spans(texts)
    assert got == [(t or "").encode().split() for t in texts]


def test_hashes_depend_on_bytes_alone():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(50)) for _ in range(40)]
    found, h, _ = spans(texts)
    by_word = {}
    for w, x in zip((w for t in found for w in t), h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_all_rows_whatever_their_size():
    buf, offsets = K.utf8(pa.array(["a" * 50, "", "b" * 5, None, "c" * 200, "d"]))
    parts = list(K.slices(buf, offsets, 60))
    assert [p[:2] for p in parts] == [(0, 4), (4, 5), (5, 6)] and b"".join(bytes(p[2]) for p in parts) == bytes(buf)


def test_offset_arrays_and_pairs():
    whole = pa.array(["x y", "p q r", "z", None, ""])
    buf, offsets = K.utf8(whole.slice(1, 3))
    assert bytes(buf) == b"p q rz" and offsets.tolist() == [0, 5, 6, 6]
    starts, ends, bounds = K.words(buf, offsets, K.NOT_SPACE)
    pairs, rows = K.pair_hashes(K.span_hashes(buf, starts, ends), bounds)
    assert rows.tolist() == [0, 0, 1]
    values, at = K.row_unique(np.array([3, 1, 3, 9], np.uint64), np.array([0, 0, 0, 2]), 3)
    assert values.tolist() == [1, 3, 9] and at.tolist() == [0, 2, 2, 3]
