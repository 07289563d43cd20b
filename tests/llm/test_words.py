import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from molweave.llm.words import Words, pieces, shingles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB 9.\né日", max_size=40)), max_size=12)


def plain(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()), prefixes=(2,))
    expected = [(i, w) for i, t in enumerate(texts) for w in plain(t)]
    assert words.row.tolist() == [i for i, _ in expected]
    by_hash = {}
    for (_, w), h in zip(expected, words.hash.tolist(), strict=True):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    for (_, w), h in zip(expected, words.prefix[2].tolist(), strict=True):
        assert (h == 0) == (len(w.encode()) <= 2)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles_equal_runs_of_words(texts):
    row, value = shingles(Words(pa.array(texts, pa.string())), 3)
    expected = []
    for i, t in enumerate(texts):
        w = plain(t)
        expected += [(i, tuple(w[k : k + 3])) for k in range(max(1, len(w) - 2))] if w else []
    assert sorted(row.tolist()) == [i for i, _ in expected]
    got, want = {}, {}
    for i, h in zip(row.tolist(), value.tolist(), strict=True):
        got.setdefault(i, set()).add(h)
    for i, s in expected:
        want.setdefault(i, set()).add(s)
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    for i in got:
        for j in got:
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_pieces_hold_all_rows():
    batch = pa.record_batch([pa.array(["x" * n for n in (3, 0, 50, 1, 1, 9)] + [None])], names=["text"])
    parts = list(pieces([batch], "text", limit=10))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert max(p.num_rows for p in parts) < 7


def test_long_words_cross_segments():
    long = "a" * 700_000
    words = Words(pa.array([long + " b " + long]))
    assert words.hash[0] == words.hash[2] != words.hash[1]
    assert np.array_equal(words.row, [0, 0, 0])
