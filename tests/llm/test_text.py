import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisearch.llm import _text as T

WORD = re.compile(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+")


def spans(text):
    _, _, start, size = T.word_spans(pa.array([text]))
    raw = text.encode()
    return [raw[a : a + n].decode() for a, n in zip(start, size)]


def test_words():
    assert spans("word\u2014word, \u00bfQu\u00e9? l\u2019\u00c9tat \uff08a\uff09 n\u00ba") == ["word", "word", "Qu\u00e9", "l", "\u00c9tat", "a", "n\u00ba"]
    assert spans("\u4e2d\u6587\u3001ok\u65e5\u672cx \u30c6\u30ad \U00020000z") == ["\u4e2d", "\u6587", "ok", "\u65e5", "\u672c", "x", "\u30c6", "\u30ad", "\U00020000", "z"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("a1 \u4e2d\u3001\u2014\u00bf\u00e9\uff08\uff11\u3005\U00020000\u30c6"), max_size=12), max_size=4))
def test_as_the_expression(texts):
    h, first, start, size = T.word_spans(pa.array(texts, pa.string()))
    raw = "".join(texts).encode()
    got = [raw[a : a + n].decode() for a, n in zip(start, size)]
    want = [WORD.findall(t) for t in texts]
    assert got == sum(want, []) and np.diff(first).tolist() == [len(w) for w in want]
    assert len({*zip(got, h.tolist())}) == len(set(got))
