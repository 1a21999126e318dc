import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from musterline.llm import words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n x", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_maximal_runs(texts):
    column = pa.array(texts, pa.string())
    seen = {}
    for row, data, s, e, h in words.document_words(column):
        want = WORD.findall((texts[row] or "").encode())
        assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == want
        for word, x in zip(want, h.tolist(), strict=True):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)
    assert words.word_counts(column).to_pylist() == [len(WORD.findall((t or "").encode())) for t in texts]


def test_blocks_do_not_show(monkeypatch):
    text = ("word " * 50 + "y" * 300 + " ") * 20
    whole = words.word_hashes(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(words, "BLOCK", 64)
    parts = words.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_sliced_arrow_columns():
    column = pa.array(["no", "a b", None, "c"]).slice(1)
    assert words.word_counts(column).to_pylist() == [2, 0, 1]


def test_fold_is_ascii_only():
    a, b = (words.word_hashes(np.frombuffer(t.encode(), np.uint8), fold=True)[2] for t in ("ABÉ x", "abé x"))
    assert a[0] != b[0] and a[1] == b[1]
