import base64
import os

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisearch.llm import bpe, tokenbin

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pair():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Encoder(), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, "<i4").tolist()


def check(pair, texts):
    mine, theirs = pair
    got = mine.encode_all(texts)
    for text, x in zip(texts, got, strict=True):
        assert ids(x) == theirs.encode_ordinary(text), text
        assert mine.decode(x) == text.encode()


def test_awkward(pair):
    check(pair, ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n c", "\n x", "x \ty", "it's we'll I'VE", "aaaa" * 500, "日本語 😀😀 naïve", "12 345,678.9 !!! ...", "a b 　c", "<|endoftext|>"])


def test_corpus(pair, docs):
    check(pair, [r.text for r in docs.select("text").collect()])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab \n'.é", max_size=60), max_size=6))
def test_any_text(pair, texts):
    check(pair, [t.encode(errors="ignore").decode() for t in texts])


def test_forgetting_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 1)
    check(pair, ["one two three", "three two one", "two"])
    check(pair, ["one two four"])


def test_table(odd, docs, rows_of):
    got = bpe.encode(odd).collect()
    assert len(got) == odd.count() and all(r.decoded_equal for r in got if r.token_ids is not None)
    assert {r.doc_id for r in got if r.token_ids is None} == {3, None}
    assert bpe.encode(odd.where("false")).count() == 0
    back = bpe.decode(bpe.encode(docs)).withColumnRenamed("text", "t").join(docs, "doc_id")
    assert back.where("t = text").count() == docs.count()
    assert bpe.decode(bpe.encode(odd).select("doc_id", "token_ids")).where("text is null").count() == 2


# Rows of token ids


def brute(sizes, row):
    """Piece by piece; of rows with equal room the one that came to it first."""
    rooms, since, out = [], [], []
    for now, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        fit = [(room, since[k], k) for k, room in enumerate(rooms) if room >= sizes[i]]
        if fit:
            k = min(fit)[2]
        else:
            k = len(rooms)
            rooms.append(row)
            since.append(now)
            out.append([])
        rooms[k] -= sizes[i]
        since[k] = now
        out[k].append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 17), max_size=60), st.sampled_from([17, 20, 32]))
def test_best_fit(sizes, row):
    """The plan by lengths puts every piece where piece by piece would."""
    from collections import Counter

    plan, rows = tokenbin.best_fit(dict(Counter(sizes)), row)
    got, order = [[] for _ in range(rows)], sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for size in set(sizes):
        for rank, item in enumerate(i for i in order if sizes[i] == size):
            p = [p for p in plan[size] if p.first <= rank][-1]
            j = rank - p.first
            got[p.row + j // p.each].append((p.at + j % p.each * size, item))
    for g in got:
        g.sort()
        assert [at for at, _ in g] == [sum(sizes[i] for _, i in g[:k]) for k in range(len(g))]
    assert [[i for _, i in g] for g in got] == brute(sizes, row)


def unpacked(rows, row, kind="<u2"):
    """(document, part) -> ids, after checking the row's own numbers."""
    out = {}
    for r in rows:
        x, p = np.frombuffer(r.input_ids, kind), np.frombuffer(r.position_ids, kind)
        assert len(x) == len(p) == row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= row
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert p[a:b].tolist() == list(range(b - a))
            out.setdefault((doc, part), []).append(x[a:b].tolist())
        assert not x[r.cu_seqlens[-1] :].any() and not p[r.cu_seqlens[-1] :].any()
    return out


@pytest.mark.parametrize("row,kind", [(64, "<u2"), (70000, "<u4")])
def test_rows_give_the_texts_back(pair, docs, row, kind):
    got = unpacked(tokenbin.pack_tokens(docs, row=row).collect(), row, kind)
    for r in docs.collect():
        whole = sum((got[r.doc_id, i][0] for i in range(len([k for k in got if k[0] == r.doc_id]))), [])
        assert whole[-1] == tokenbin.END and whole[:-1] == pair[1].encode_ordinary(r.text)


def test_packed_table(odd):
    got = unpacked(tokenbin.pack_tokens(odd.repartition(3)).collect(), tokenbin.ROW)
    assert len(got[2, 0]) == 2 and len(got[9, 0]) == 2 and len(got[None, 0]) == 1
    assert got[4, 0] == [[tokenbin.END]] and (3, 0) not in got
    assert len([k for k in got if k[0] == 10]) > 1
    assert tokenbin.pack_tokens(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        tokenbin.pack_tokens(odd, row=0)


def test_written_matrix(docs, spark, tmp_path):
    tokenbin.write_packed(tokenbin.pack_tokens(docs), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where(f"length(input_ids) <> {2 * tokenbin.ROW}").count() == 0


def test_rows_do_not_follow_partitions(docs):
    one, two, eight = (sorted(map(repr, tokenbin.pack_tokens(docs.repartition(n)).collect())) for n in (1, 2, 8))
    assert one == two == eight
    pieces = [n for r in tokenbin.pack_tokens(docs).collect() for n in np.diff(r.cu_seqlens).tolist()]
    assert len(one) == len(brute(pieces, tokenbin.ROW))


def test_one_text_for_half_of_all_rows(spark):
    rows = spark.createDataFrame([(1, "the same text") for _ in range(3000)] + [(i, "other words " * (i % 50)) for i in range(3000)], "doc_id bigint, text string")
    got = unpacked(tokenbin.pack_tokens(rows).collect(), tokenbin.ROW)
    assert len(got[1, 0]) == 3001 and sum(map(len, got.values())) == 6000
