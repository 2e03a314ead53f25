"""Vectorised primitives against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trowel.llm import arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t\x0b|.", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = A.text_buffers(pa.array(texts, pa.string()))
    words = A.words_of(data, offsets)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(words.bounds).tolist() == [len(p) for p in plain]
    names = [w for p in plain for w in p]
    assert len(set(zip(names, words.hashes.tolist(), strict=True))) == len(set(names)) == len(set(words.hashes.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 25), st.integers(0, 60))
def test_windows(width, n):
    h = A.mix(np.arange(n, dtype=A.U64))
    base = 0x9FB21C651E98DF25
    want = [sum(int(h[i + k]) * pow(base, k, 1 << 64) for k in range(width)) % (1 << 64) for i in range(max(0, n - width + 1))]
    assert A.windows(h, width).tolist() == A.mix(np.array(want, A.U64)).tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_sorted_lists_round_trip(values):
    h = np.sort(np.array(values, A.U64))
    assert A.unpack_sorted(A.pack_sorted(h)).tolist() == h.tolist()
    cuts = A.cut_by_top_bits(h, 3)
    assert len(cuts) == 9 and all((h[a:b] >> A.U64(61) == k).all() for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))


def test_documents_round_trip():
    texts = ["b", "", "日本", "a"]
    data, offsets = A.text_buffers(pa.array(texts))
    ids, raw, at = A.unpack_docs([A.pack_docs(np.array([3, 1, 2, 3]), data, offsets, np.arange(4))])
    assert ids.tolist() == [1, 2, 3, 3]
    assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == ["", "日本", "a", "b"]
