import math
import re
from collections import Counter, defaultdict

import pytest

from lexisearch.llm import retrieval as R

WORD = re.compile(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+")


def tokens(text):
    return WORD.findall((text or "").lower())


def cut(text, window):
    """Parts of a text and their words, in plain Python."""
    spots = [m.start() for m in re.finditer(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+", text)]
    edges = [0, *spots[window::window], len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def brute(rows, window, all_rows):
    """Windows over one shard's rows by exhaustive BM25."""
    n = sum(bool(tokens(t)) for _, t in all_rows)
    total = sum(len(tokens(t)) for _, t in all_rows)
    df = Counter(w for _, t in all_rows for w in set(tokens(t)))
    out, parts = [], []
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])):
        if tokens(t):
            for i, p in enumerate(cut(t, window)):
                (out if len(tokens(p)) >= window else parts).append(([doc], [i]) if len(tokens(p)) >= window else (doc, i, Counter(tokens(p))))
    average = total / max(n, 1)
    used = set()

    def score(q, d):
        size = sum(d.values())
        return sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (R.K1 + 1) / (d[w] + R.K1 * (1 - R.B + R.B * size / average)) for w in q if w in d)

    for s, (doc, i, q) in enumerate(parts):
        if s in used:
            continue
        used.add(s)
        mine, room = ([doc], [i]), window - sum(q.values())
        scores = {k: score(q, parts[k][2]) for k in range(len(parts)) if k not in used}
        while room:
            fits = [(-v, k) for k, v in scores.items() if k not in used and sum(parts[k][2].values()) <= room and v > 0]
            if not fits:
                break
            k = min(fits)[1]
            used.add(k)
            mine[0].append(parts[k][0])
            mine[1].append(parts[k][1])
            room -= sum(parts[k][2].values())
        out.append(mine)
    return out


@pytest.mark.parametrize("window", [200, 2048])
def test_as_brute_force(docs, window):
    """Every window of every shard, with the statistics of the whole corpus."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = R.pack(docs, window=window, shard_words=20000).collect()
    shard = defaultdict(list)
    text = dict(rows)
    for r in got:
        shard[r.shard] += r.doc_ids
    assert len(shard) > 2
    for k, ids in shard.items():
        mine = [(d, p) for r in sorted((r for r in got if r.shard == k), key=lambda r: r.window_no) for d, p in [(r.doc_ids, r.parts)]]
        assert mine == [tuple(w) for w in brute([(d, text[d]) for d in set(ids)], window, rows)], k


def best_neighbours(docs, shard_of):
    """Each document's best BM25 score over all others, and over those of its shard."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if tokens(r.text)]
    h, first = R.words(R.pa.array([t for _, t in rows]))
    owner, term, tf = R._terms(h, first)
    _, back, df = R.np.unique(term, return_inverse=True, return_counts=True)
    n, size = len(rows), R.np.diff(first)
    index = R.Index(owner, term, tf, size, R.np.log1p((n - df[back] + 0.5) / (df[back] + 0.5)), size.mean())
    own = R.np.array([shard_of[d] for d, _ in rows])
    whole = inside = 0.0
    for k in range(n):
        score = index.scores(k)
        score[k] = 0
        whole += score.max()
        inside += (score * (own == own[k])).max()
    return whole, inside


def test_neighbours_are_in_the_shard(spark, docs):
    """Of the best neighbours' scores nearly all are kept by shards, where chance would keep a third."""
    docs = docs.select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 4 = 0").selectExpr("doc_id + 1000000", "concat(text, ' and something more')"))
    placed = R.pack(docs, shard_words=15000).collect()
    shard_of = {d: r.shard for r in placed for d in r.doc_ids}
    assert len(set(shard_of.values())) > 5
    whole, inside = best_neighbours(docs, shard_of)
    assert inside > 0.85 * whole, inside / whole


def test_rows_do_not_follow_partitions(docs):
    one, many = (sorted(map(str, R.pack(docs.repartition(n), shard_words=20000).collect())) for n in (1, 7))
    assert one == many


def test_one_row_for_half_of_the_table(spark):
    rows = spark.createDataFrame([(5, "the same few words again") for _ in range(3000)] + [(i, f"other words {i}") for i in range(1000)], "doc_id bigint, text string")
    got = R.pack(rows, window=64, shard_words=2000, shard_docs=400).collect()
    ids = Counter(d for r in got for d in r.doc_ids)
    assert ids[5] == 3001 and sum(ids.values()) == 4000
    assert max(Counter(r.shard for r in got for _ in r.doc_ids).values()) < 1000


def test_nothing_is_lost(docs):
    got = R.pack(docs, window=100, shard_words=5000).collect()
    parts = defaultdict(dict)
    for r in got:
        pieces = r.text.split(R.SEPARATOR)
        assert r.n_words == sum(map(len, map(tokens, pieces))) <= 100 and len(pieces) == len(r.doc_ids) == len(r.scores)
        assert r.scores[0] == 0 and all(s > 0 for s in r.scores[1:])
        for d, i, t in zip(r.doc_ids, r.parts, pieces, strict=True):
            assert i not in parts[d]
            parts[d][i] = t
    for r in docs.collect():
        assert "".join(parts[r.doc_id][i] for i in range(len(parts[r.doc_id]))) == r.text


def test_neighbours_come_together(spark):
    topics = ["apple pear plum", "stone brick mortar", "wind rain snow"]
    rows = [(i, " ".join([topics[i % 3]] * 10)) for i in range(12)]
    got = R.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), window=60).collect()
    assert len(got) == 6 and all(len({d % 3 for d in r.doc_ids}) == 1 for r in got)
    assert sorted(sum((r.doc_ids for r in got), [])) == list(range(12))
    assert min(r.doc_ids for r in got) == [0, 3]  # of equal scores the lower id


def test_table(odd, spark):
    got = R.pack(odd).collect()
    ids = Counter((d, p) for r in got for d, p in zip(r.doc_ids, r.parts))
    assert ids[2, 0] == 2 and ids[9, 0] == 2 and ids[None, 0] == 1 and ids[1, 0] == 1 and ids[7, 0] == 1
    assert not {d for d, _ in ids} & {3, 4, 5, 6}
    assert {p for d, p in ids if d == 10} == {0, 1, 2}
    assert R.pack(odd.where("false")).count() == 0
    assert R.pack(odd.where("doc_id in (3, 4, 5, 6)")).count() == 0
