import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostweave.llm import kernel
from tests.llm.helpers import WORD, shingles

TEXT = st.text(alphabet="ab \n\té日", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 30))
def test_words_of_pieces(texts, limit):
    found = []
    for a, b, data, offsets in kernel.pieces(kernel.as_text(pa.array(texts, pa.string())), limit):
        w = kernel.words(data, offsets)
        rows = [[] for _ in range(b - a)]
        for s, e, d in zip(w.start, w.end, w.doc, strict=True):
            rows[d].append(data[s:e].tobytes().decode())
        found += rows
    assert found == [WORD.findall(t or "") for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_shingles_are_equal_where_words_are(texts):
    data, offsets = kernel.buffers(kernel.as_text(pa.array(texts)))
    data = data[: offsets[-1]]
    h, doc = kernel.shingle_hashes(data, offsets)
    sets = [set(h[doc == i].tolist()) for i in range(len(texts))]
    for a, x in zip(texts, sets, strict=True):
        assert len(x) == len(shingles(a))
        for b, y in zip(texts, sets, strict=True):
            assert len(x & y) == len(shingles(a) & shingles(b))


def test_range_hash_does_not_depend_on_the_place():
    data = np.frombuffer(b"xxabcyyabc", np.uint8)
    h = kernel.range_hash(kernel.prefix_hash(data), np.array([2, 7, 0]), np.array([5, 10, 3]))
    assert h[0] == h[1] != h[2]
    assert int(h[0]) == kernel.hash_text("abc")


@pytest.mark.parametrize("texts", [[], [None], [""], ["", None, ""]])
def test_nothing_to_read(texts):
    for _, _, data, offsets in kernel.pieces(kernel.as_text(pa.array(texts, pa.string()))):
        assert len(kernel.words(data, offsets).start) == 0
        assert len(kernel.shingle_hashes(data, offsets)[0]) == 0


def test_kept_values_go_with_their_operator():
    made = []
    make = lambda: made.append(1) or len(made)
    kernel.claim("a")
    assert [kernel.keep(("x",), make), kernel.keep(("x",), make)] == [1, 1]
    kernel.claim("a")
    assert kernel.keep(("x",), make) == 1
    assert kernel.keep(("y",), make) == 2  # one value at a time
    kernel.claim("b")
    assert kernel.keep(("y",), make) == 3
