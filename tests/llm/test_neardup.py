import re

import numpy as np
import pyarrow as pa
import pytest

from lexisearch.llm import neardup as N

WORD = re.compile(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+")


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + N.SHINGLE]) for i in range(max(1, len(w) - N.SHINGLE + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def near(rows, threshold=N.THRESHOLD):
    """Brute force: (similar pairs, group of each grouped id)."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    pairs = {(max(a, b), min(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a != b and jaccard(s, t) >= threshold}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pairs, {x: find(x) for x in root}


def text(rng, n):
    return [f"w{rng.integers(0, 5000)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.integers(0, 10**6)}" if rng.random() < share else w for w in words]


def test_shingles():
    texts = ["a b c d", "", None, "a", "a b", "a b c a b c", "A-b, C!"]
    ids, first = N.shingles(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]
    assert set(ids[first[6] : first[7]]) <= set(ids[first[0] : first[1]])
    assert len(N.shingles(pa.array([], pa.string()))[0]) == 0


def test_registers_merge_and_match():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 1 << 48, 3000).astype(np.uint64))
    a, b = np.sort(pool[:1500]), np.sort(pool[500:2000])
    both = np.union1d(a, b)
    k = N.registers(np.concatenate([a, b, both]), np.cumsum([0, len(a), len(b), len(both)]))
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    assert (N.registers(np.empty(0, np.uint64), np.array([0, 0])) == 0).all()


@pytest.mark.parametrize("j", [0.0, 0.2, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("n", [40, 1000])
def test_estimate_is_close(j, n):
    rng = np.random.default_rng(n)
    got = []
    for _ in range(30):
        same = round(2 * n * j / (1 + j))
        pool = np.unique(rng.integers(0, 1 << 48, 3 * n).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:same], pool[n : 2 * n - same]]))
        k = N.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        got.append(N.joint(k[:1], k[1:], np.array([n]), np.array([n]))[0])
    assert abs(np.mean(got) - j) < 0.03 and np.std(got) < 0.07


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 4), (8, 7), (5, 5), *((i, i - 1) for i in range(101, 160)), *((200 + i, 200) for i in range(1, 50))]
    got = {r.doc_id: r.group_id for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: 1 for x in (2, 3, 4, 9)} | {8: 7} | {i: 100 for i in range(101, 160)} | {200 + i: 200 for i in range(1, 50)}
    assert got == want
    assert N.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def groups_of(df):
    return {r.doc_id: r.group_id for r in df.collect()}


def test_same_groups_as_brute_force(docs):
    got = groups_of(N.groups(docs))
    pairs, want = near([(r.doc_id, r.text) for r in docs.collect()])
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs)
    assert pairs and found >= 0.95 * len(pairs)
    assert set(got) <= set(want)


def test_planted_copies(spark):
    rng = np.random.default_rng(3)
    rows, near_pairs, clean = [], [], []
    shared = text(rng, 60)
    for i in range(150):
        base = text(rng, int(rng.integers(80, 400)))
        rows.append((10 * i, " ".join(base)))
        if i % 3 == 0:
            rows.append((10 * i + 1, " ".join(edited(rng, base, 0.05))))
            near_pairs.append((10 * i, 10 * i + 1))
        elif i % 3 == 1:
            rows.append((10 * i + 1, " ".join(base)))
            near_pairs.append((10 * i, 10 * i + 1))
        else:
            clean.append(10 * i)
    # A passage that many documents share does not make them copies.
    for i in range(100):
        rows.append((5000 + i, " ".join(text(rng, 250) + shared)))
        clean.append(5000 + i)
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in near_pairs) >= 0.97 * len(near_pairs)
    assert not set(clean) & set(got)


def test_large_groups(spark):
    """Hundreds of exact copies, and hundreds of edited ones of another text."""
    rng = np.random.default_rng(4)
    one, two = text(rng, 200), text(rng, 200)
    rows = [(i, " ".join(one)) for i in range(300)] + [(1000 + i, " ".join(edited(rng, two, 0.04))) for i in range(300)]
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {got[i] for i in range(300)} == {0} and sum(got.get(1000 + i) == 1000 for i in range(300)) >= 297


def test_recall_at_the_threshold(spark):
    """Pairs just at the threshold: at least nine in ten are found, treating every row as a query."""
    rng = np.random.default_rng(5)
    rows, pairs = [], 0
    while pairs < 120:
        base = text(rng, 200)
        other = edited(rng, base, 0.105)
        if N.THRESHOLD <= jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other))) < N.THRESHOLD + 0.05:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sum(got.get(2 * i) == 2 * i == got.get(2 * i + 1) for i in range(pairs)) >= 0.9 * pairs


def test_table(odd, spark):
    got = {(r.doc_id, r.group_id, r.n_docs) for r in N.groups(odd).collect()}
    assert got == {(1, 1, 2), (2, 1, 2)}
    assert N.groups(odd.where("false")).count() == 0
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (1, "a b c d e f")]
    assert groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))) == {1: 1, 2: 1, 3: 1}


def test_copies_of_single_members_of_a_hot_group(spark):
    """A document near one member of a large group, not the least, joins it wherever they share a band."""
    rng = np.random.default_rng(11)
    base = text(rng, 200)
    copies = [edited(rng, base, 0.02) for _ in range(100)]
    rows = [(i, " ".join(c)) for i, c in enumerate(copies)]
    sets = [shingle_set(t) for _, t in rows]
    while len(rows) < 140:
        k = int(rng.integers(1, 100))
        t = " ".join(edited(rng, copies[k], 0.09))
        j = np.array([jaccard(shingle_set(t), s) for s in sets])
        if 0.55 <= j[k] < 0.6 and (j >= 0.55).sum() == 1:
            rows.append((len(rows) + 900, t))
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sum(got.get(i) != 0 for i, _ in rows[100:]) <= 3


def tried_pairs(spark, rows, monkeypatch):
    """(groups, number of pairs that were estimated)."""
    seen = []
    real = N.estimated
    monkeypatch.setattr(N, "estimated", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    monkeypatch.undo()
    return got, sum(seen)


def test_templated_texts_make_few_pairs(spark, monkeypatch):
    """Texts that share two thirds of their words, under the threshold: pairs grow as the texts do."""
    rng = np.random.default_rng(13)
    common = text(rng, 200)
    tries = []
    for n in (200, 400, 800):
        rows = [(i, " ".join(common + [f"u{i}-{k}" for k in range(100)])) for i in range(n)]
        got, pairs = tried_pairs(spark, rows, monkeypatch)
        assert not got
        tries.append(pairs)
    assert tries[2] < 5 * tries[0] and tries[2] < 20 * 800, tries


def test_drifting_versions_lose_no_pair(spark):
    """Families whose members drift apart: every similar pair that shares a band is in one group."""
    rng = np.random.default_rng(17)
    rows = []
    for family in range(60):
        now = text(rng, 150)
        for version in range(5):
            rows.append((family * 10 + version, " ".join(now)))
            now = edited(rng, now, 0.1)
    got = groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    ids, first = N.shingles(pa.array([t for _, t in rows]))
    bands = N.registers(ids, first).reshape(len(rows), -1, N.BAND)
    pairs, _ = near(rows)
    place = {d: k for k, (d, _) in enumerate(rows)}
    met = [(a, b) for a, b in pairs if (bands[place[a]] == bands[place[b]]).all(axis=1).any()]
    assert len(met) > 100 and all(got.get(a, -1) == got.get(b, -2) for a, b in met)


def test_prefixes_miss_no_similar_pair(spark):
    """In large buckets: all pairs of different groups that reach the threshold are found, whatever their sizes."""
    rng = np.random.default_rng(19)
    base = text(rng, 120)
    rows = []
    for i in range(120):
        words = edited(rng, base, float(rng.choice([0.02, 0.05, 0.1])))
        rows.append((i, " ".join(words[: int(rng.integers(60, 121))] + text(rng, int(rng.integers(0, 40))))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    members = df.selectExpr("doc_id", "doc_id % 40 as g")
    found = {(r.a, r.b) for r in N.by_prefix(members, df, N.THRESHOLD).collect()}
    pairs, _ = near(rows)
    assert len(pairs) > 100 and {(a, b) for a, b in pairs if a % 40 != b % 40} <= found and all(a % 40 != b % 40 for a, b in found)


def test_one_text_for_a_third_of_all_rows(spark):
    rng = np.random.default_rng(23)
    rows = [(i, "the same words in every third row of the table") for i in range(500)] + [(1000 + i, " ".join(text(rng, 30))) for i in range(1000)]
    got = N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 500 and {(r.group_id, r.n_docs) for r in got} == {(0, 500)}


def test_very_long_texts(spark):
    rng = np.random.default_rng(29)
    long = text(rng, 200_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[:150_000])), (3, " ".join(long[:20_000]))]
    assert groups_of(N.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))) == {1: 1, 2: 1}
