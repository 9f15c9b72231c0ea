import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisearch.llm import fingerprint as P

KEYS = st.sets(st.integers(0, (1 << 60) - 1), max_size=40)


def sketch(keys, cells):
    return P.sketch(np.array(sorted(keys), np.uint64), cells)


@settings(max_examples=150, deadline=None)
@given(KEYS, KEYS, KEYS)
def test_peeling_gives_the_differences_or_stalls(both, new, old):
    a, b = both | new, both | old
    for cells in (3, 24, 300, 3000):
        got = P.peel(P.subtract(sketch(a, cells), sketch(b, cells)))
        assert got is None or got == (sorted(a - b), sorted(b - a))
    assert got is not None


def test_it_fails_when_too_small_and_not_when_large():
    new = set(range(1, 101))
    assert P.peel(P.subtract(sketch(new, 24), sketch(set(), 24))) is None
    assert P.peel(P.subtract(sketch(new, 384), sketch(set(), 384))) == (sorted(new), [])


def brute(rows):
    chains = {}
    for doc, text in rows:
        if text is not None:
            found = [P.digest(p) for p in P.paragraphs(text)]
            chains.setdefault(found[0] if found else None, []).append((doc, P.digest(text), set(found)))
    out = []
    for chain in chains.values():
        chain.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for i, (doc, _, mine) in enumerate(chain):
            old = chain[i - 1][2] if i else set()
            out.append((doc, chain[i - 1][0] if i else None, len(mine), sorted(mine - old), sorted(old - mine)))
    return sorted(map(repr, out))


def mine(df):
    return sorted(repr((r.doc_id, r.previous_id, r.n_paragraphs, r.added, r.removed)) for r in df.collect())


@pytest.mark.parametrize("cells", [3, 24])
def test_as_brute_force(spark, cells):
    rng = np.random.default_rng(cells)
    rows = [(i, "\n".join(["start " + str(i % 5), *(f"p{x}" for x in rng.integers(0, 60, rng.integers(0, 40)))])) for i in range(200)]
    assert mine(P.changes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), cells=cells)) == brute(rows)


def test_table(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert mine(P.changes(odd)) == brute(rows)
    assert P.changes(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        P.changes(odd, cells=2)


def test_long_and_many(spark):
    text = "first\n" + "\n".join(f"line {i}" for i in range(5000))
    rows = [(1, text), (2, text.replace("line 77\n", "line x\n")), (3, "first"), *((10 + i, "hot\nsame") for i in range(300))]
    assert mine(P.changes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
