import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import shared, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té ", max_size=30)), max_size=8))
def test_spans_match_the_pattern(texts):
    found = []
    for lo, hi, data, offsets in words.text_chunks(pa.array(texts, pa.string()), limit=16):
        starts, ends, rows = words.word_spans(data, offsets)
        for i in range(hi - lo):
            found.append([bytes(data[a:b]).decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])])
    assert found == [WORD.findall(t or "") for t in texts]


def test_window_hashes_depend_on_words_alone():
    h = words.mix(np.arange(200, dtype=np.uint64))
    for width in (1, 2, 5, 15, 35):
        whole = words.window_hashes(h, width)
        assert len(whole) == 201 - width
        assert (words.window_hashes(h[7:], width) == whole[7:]).all()
        assert len(set(whole.tolist())) == len(whole)
    assert len(words.window_hashes(h[:3], 5)) == 0


def test_fold_lower_cases_ascii_only():
    def hashes(text, fold):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = words.word_spans(data, np.array([0, len(data)]))
        return words.word_hashes(data, s, e, fold).tolist()

    assert hashes("ABC É", True)[0] == hashes("abc é", True)[0]
    assert hashes("ABC É", True)[1] != hashes("abc é", True)[1]
    assert hashes("ABC", False) != hashes("abc", False)


def test_pack_round_trip():
    a, b = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 1000).astype(np.uint64)), np.arange(1000, dtype=np.uint32)
    x, y = shared.unpack(shared.pack(shared.ordered(a), b), np.uint64, np.uint32)
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and (y == b).all()
    assert [len(z) for z in shared.unpack(shared.pack(a[:0], b[:0]), np.uint64, np.uint32)] == [0, 0]
