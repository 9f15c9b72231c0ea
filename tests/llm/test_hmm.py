import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lexisearch.llm import hmm as M


def toy(states=3, symbols=4, seed=0):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states) + 1, rng.random((states, states)) + 1, rng.random((states, symbols))
    return M.Model(np.empty(0, np.uint64), start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


WORD = re.compile(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+")


def counted(docs, share):
    counts, letters = M.word_counts(docs)
    return M.vocabulary(counts, int(letters[3]), share), int(letters[3]), counts, letters


def enumerate_all(m, seq):
    """(likelihood, expected firsts, moves, emissions) by summing over all paths."""
    k = len(m.start)
    total, first, moves, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, o]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, o in zip(path, seq):
            emits[s, o] += p
    return total, first / total, moves / total, emits / total


def test_recursions_are_exact():
    m = toy()
    seqs = [[0, 1, 2], [3], [1, 1, 0, 2, 3], [2, 0], [3, 3, 3]]
    length = np.array([len(s) for s in seqs])
    lattice = M.Lattice(np.concatenate(seqs), length)
    want = [enumerate_all(m, s) for s in seqs]
    assert np.allclose(lattice.likelihood(lattice.forward(m)[1]), [math.log(w[0]) for w in want])
    first, moves, emits, ll = lattice.expected(m)
    assert np.allclose(first, sum(w[1] for w in want)) and np.allclose(moves, sum(w[2] for w in want)) and np.allclose(emits, sum(w[3] for w in want))
    assert ll == pytest.approx(sum(math.log(w[0]) for w in want))


def test_long_sequences_do_not_underflow():
    m = toy()
    lattice = M.Lattice(np.tile([0, 1, 2, 3], 5000), np.array([20000]))
    assert np.isfinite(lattice.likelihood(lattice.forward(m)[1])).all()


def test_symbols():
    vocab = np.sort(M.words(pa.array(["the cat"]))[0])
    s, heads, first, lines, h = M.symbols(pa.array(["The cat\n\nsat é1", "", None, "the"], pa.string()), vocab)
    assert np.diff(first).tolist() == [4, 0, 0, 1] and np.diff(lines).tolist() == [2, 0, 0, 1] and heads.tolist() == [0, 2, 4, 5]
    assert (s[:2] < 2).all() and s[0] == s[4] and s[2] == 2 and s[3] == 2 + 3 + 0 and h[0] == h[4]
    assert s.max() < 2 + M.CLASSES
    assert (M.symbols(pa.array(["a bb"]), np.empty(0, np.uint64))[0] < M.CLASSES).all()


def test_counts_and_vocabulary(docs):
    from collections import Counter

    want = Counter(w for r in docs.collect() for w in WORD.findall(r.text.lower()))
    vocab, total, counts, letters = counted(docs.repartition(3), 0.001)
    assert total == sum(want.values())
    key = dict(zip(M.words(pa.array([" ".join(want)]))[0].view(np.int64).tolist(), want, strict=True))
    digits, wide = ({w: sum(b in keep for b in w.encode()) for w in want} for keep in (range(48, 58), range(128, 256)))
    assert {(key[r.word], r.n, r.size, r.digits, r.wide) for r in counts.collect()} == {(w, n, len(w.encode()), digits[w], wide[w]) for w, n in want.items()}
    per = [sum(n * x[w] for w, n in want.items()) for x in (digits, wide)]
    assert letters.tolist() == [sum(n * len(w.encode()) for w, n in want.items()) - sum(per), *per, total]
    often = {w for w, n in want.items() if n >= 0.001 * total}
    assert sorted(vocab) == sorted(M.words(pa.array([" ".join(sorted(often))]))[0]) and (np.diff(vocab.astype(object)) > 0).all()


def test_chances_of_all_words_sum_to_one(docs):
    """Of each class: its counted words, and all spellings that no text has, together."""
    vocab, total, counts, letters = counted(docs, 0.001)
    q, stop, kind = (np.exp(x) for x in M.spelled(letters))
    assert q @ (26, 10, 128) + stop == pytest.approx(1) and kind.sum() == pytest.approx(1 - stop, abs=1e-6)  # a word is not empty
    chance = {r.word: r.chance for r in M.rare_chances(counts, letters, 0.001 * total).collect()}
    rare = counts.where(f"n < {0.001 * total}").collect()
    assert set(chance) == {r.word for r in rare}
    class_of = {r.word: int(M.word_classes(np.array([r.size]), np.array([r.digits]), np.array([r.wide]))[0]) for r in rare}
    for c in set(class_of.values()):
        mine = [r for r in rare if class_of[r.word] == c]
        base = [q[0] ** (r.size - r.digits - r.wide) * q[1] ** r.digits * q[2] ** r.wide * stop / kind[c] for r in mine]
        left = M.DISCOUNT * len(mine) / sum(r.n for r in mine) * (1 - sum(base))
        assert sum(math.exp(chance[r.word]) for r in mine) + left == pytest.approx(1, abs=1e-4)
    # A word that occurs twice is more than twice as likely as one that occurs once.
    by_n = {n: np.mean([chance[r.word] for r in rare if r.n == n and class_of[r.word] == 8]) for n in (1, 2)}
    assert by_n[2] > by_n[1] + math.log(2)


def test_training_over_partitions_is_training_at_once(docs):
    docs = docs.select("doc_id", "text")
    vocab, total, *_ = counted(docs, 0.001)
    one = M.train(M.encoded(docs.coalesce(1), vocab), vocab, total, 4, 3)
    many = M.train(M.encoded(docs.repartition(6), vocab), vocab, total, 4, 3)
    assert np.allclose(one.emit, many.emit) and np.allclose(one.move, many.move) and np.allclose(one.log_likelihood, many.log_likelihood)
    assert one.log_likelihood[0] < one.log_likelihood[1] < one.log_likelihood[2]
    assert np.allclose(one.move.sum(axis=1), 1) and np.allclose(one.emit.sum(axis=1), 1) and (one.emit > 0).all()


def test_training_converges_well_over_word_frequencies(docs):
    """With the parameters of the registered query; half of the documents are held out."""
    docs = docs.select("doc_id", "text")
    seen, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    vocab, total, *_ = counted(seen, M.MIN_SHARE)
    m = M.train(M.encoded(seen, vocab), vocab, total)
    gain = np.diff(m.log_likelihood) / total
    assert len(gain) + 1 < M.ITERATIONS and gain[-1] < M.LEAST_GAIN and (gain > 0).all()
    found = [M.symbols(pa.array([r.text for r in d.collect()]), vocab)[0] for d in (seen, held)]
    share = np.bincount(found[0], minlength=len(vocab) + M.CLASSES) + M.SMOOTHING
    plain = float(np.log(share / share.sum())[found[1]].mean())
    table = M.encoded(held, vocab).withColumn("uid", M.F.monotonically_increasing_id())
    ours = sum(r.ll for r in M.scored(table, m).collect()) / len(found[1])
    assert ours > plain + 0.2, (ours, plain)


def test_likelihood_of_a_document(docs, spark):
    """Scores are the plain forward recursion's, line by line, times each rare word's chance."""
    rows = spark.createDataFrame(docs.select("doc_id", "text").limit(20).collect(), "doc_id bigint, text string").cache()
    vocab, total, counts, letters = counted(rows, 0.001)
    m = M.train(M.encoded(rows.coalesce(1), vocab), vocab, total, 3, 2)
    chance = {r.word: r.chance for r in M.rare_chances(counts, letters, 0.001 * total).collect()}
    texts = dict(rows.collect())
    for r in M.score(rows, states=3, iterations=2, min_share=0.001).collect():
        ll = n = 0
        for line in texts[r.doc_id].split("\n"):
            a = None
            s, _, _, _, h = M.symbols(pa.array([line]), vocab)
            for o, w in zip(s, h.view(np.int64), strict=True):
                a = (np.log(m.start) if a is None else np.logaddexp.reduce(a[:, None] + np.log(m.move), axis=0)) + np.log(m.emit[:, o])
                ll += chance[int(w)] if o >= len(vocab) else 0
                n += 1
            ll += 0 if a is None else np.logaddexp.reduce(a)
        assert r.n_words == n and r.log_likelihood == pytest.approx(ll, rel=1e-5) and r.perplexity == pytest.approx(math.exp(-ll / n), rel=1e-3)


def test_states_recover_structure(spark):
    """Two alternating kinds of words: the model predicts them far better than their frequencies do."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join((f"a{rng.integers(4)}" if k % 2 else f"b{rng.integers(4)}") for k in range(30))) for i in range(300)]
    got = M.score(spark.createDataFrame(rows, "doc_id bigint, text string"), states=2).collect()
    assert np.mean([r.perplexity for r in got]) < 5


def test_texts_that_occur_twice_score_apart(spark, docs):
    """Words of a text that is there twice are known; those of gibberish are not."""
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    odd = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(60))
    once, twice = [odd() for _ in range(30)], [odd() for _ in range(30)]
    rows += [(10**6 + i, t) for i, t in enumerate(once)] + [(2 * 10**6 + i, t) for i, t in enumerate(twice + twice)]
    got = {r.doc_id: r.perplexity for r in M.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert max(got[2 * 10**6 + i] for i in range(60)) < min(got[10**6 + i] for i in range(30))


def test_table(odd):
    got = M.score(odd, iterations=2).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (3, 4, 5, 6) or r.n_words == 0:
            assert (r.n_words, r.n_lines, r.log_likelihood, r.perplexity) == (0, 0, 0.0, None)
        else:
            assert r.log_likelihood < 0 and r.perplexity > 1
    assert {r.n_words for r in got if r.doc_id == 10} == {6001}
    assert M.score(odd.where("false")).count() == 0
    assert M.score(odd.where("doc_id = 3")).first().log_likelihood == 0
