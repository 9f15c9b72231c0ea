import numpy as np
import pyarrow as pa

from lexisearch.llm import quality as Q



def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9))) for _ in range(n)]
    return ".\n".join(" ".join(words[i : i + 15]).capitalize() for i in range(0, n, 15)) + "."


def slow_features(text):
    """The features again, in plain Python."""
    import re

    w = re.findall(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+", text.lower())
    lines = [x for x in text.split("\n") if x]
    letters = sum("a" <= c.lower() <= "z" or ord(c) > 127 for c in text)
    ascii_letters = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in text)
    digits = sum("0" <= c <= "9" for c in text)
    solid = sum(c not in " \t\r\n" for c in text)
    other = sum(ord(c) < 128 and not c.isalnum() and c not in " \t\r\n.,;:?'\"()-!" for c in text)
    return {
        "words": len(w),
        "lines": len(lines),
        "symbols": other / max(len(text), 1),
        "letters": (letters + digits) / max(solid, 1),
        "capitals": sum("A" <= c <= "Z" for c in text) / max(ascii_letters, 1),
        "exclamations": text.count("!") / max(len(w), 1),
        "bars": text.count("|") / max(len(w), 1),
        "echoes": sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1),
        "variety": len(set(w)) / max(len(w), 1),
        "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "function_words": sum(x in Q._FUNCTION for x in w) / max(len(w), 1),
        "word_length": (letters + digits) / max(len(w), 1),
        "sentence_ends": sum(x[-1] in ".!?:;\"')" for x in lines) / max(len(lines), 1),
    }


def test_features(docs):
    texts = [r.text for r in docs.limit(80).collect()] + ["", "\n", "\n\na\n\nb", "a\na\na", "É! |x|", "日本 日本", "A\n", "one"]
    got = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        for k, v in slow_features(t).items():
            assert np.isclose(got[k][i], v), (k, t[:80])


def test_patterns_round_trip():
    v = np.random.default_rng(0).integers(-1, 2, (50, len(Q.RULES))).astype(np.int8)
    assert (Q.unpack(Q.pattern(v)) == v).all()


def test_em_finds_known_accuracies():
    rng = np.random.default_rng(1)
    n, rules = 40000, len(Q.RULES)
    good = rng.random(n) < 0.8
    right, wrong = np.linspace(0.985, 0.999, rules), np.linspace(0.3, 0.85, rules)
    v = np.where(rng.random((n, rules)) < np.where(good[:, None], right, wrong), 1, -1).astype(np.int8)
    v[rng.random((n, rules)) < 0.2] = 0
    rows, count = np.unique(v, axis=0, return_counts=True)
    prior, chance = Q.fit(rows, count)
    assert abs(prior - 0.8) < 0.02 and np.abs(chance[0] - right).max() < 0.01 and np.abs(chance[1] - wrong).max() < 0.05
    assert ((Q.posterior(v, prior, chance) > 0.5) == good).mean() > 0.97


def test_em_likelihood_never_falls(docs):
    found = Q.patterns(docs)
    v, n = Q.unpack(found["pattern"].to_numpy()), found["n"].to_numpy()
    assert n.sum() == docs.count()

    def ll(k):
        prior, c = Q.fit(v, n, k)
        g, b = (v == 1).astype(float), (v == -1).astype(float)
        return n @ np.log(prior * np.exp(g @ np.log(c[0]) + b @ np.log1p(-c[0])) + (1 - prior) * np.exp(g @ np.log(c[1]) + b @ np.log1p(-c[1])))

    steps = [ll(k) for k in (1, 3, 10, 50)]
    assert all(b >= a - 0.5 for a, b in zip(steps, steps[1:]))


def test_held_out_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F_quality())
    got = Q.quality(docs).join(labels, "doc_id").collect()
    good = [r for r in got if r.label == 1]
    bad = [r for r in got if r.label == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def F_quality():
    from pyspark.sql import functions as F

    return F.col("quality").alias("label")


def test_clean_text_stays_whatever_else_there_is(spark):
    clean = [(i, prose(i)) for i in range(60)]
    for junk in (0, 1, 30):
        rows = clean + [(100 + i, "BUY!! NOW!! " * 80) for i in range(junk)]
        got = {r.doc_id: r.kept for r in Q.quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert all(got[i] for i, _ in clean)
        if junk > 1:
            assert not any(got[100 + i] for i in range(junk))


def test_table(odd, docs, rows_of):
    got = Q.quality(odd).collect()
    assert len(got) == odd.count()
    assert all(set(r.votes) == {-1} and not r.kept for r in got if r.doc_id in (3, 4, 5, 6))
    assert Q.quality(odd.where("false")).count() == 0 and Q.keep_good(odd.where("false")).count() == 0
    kept = Q.keep_good(odd)
    assert kept.schema == odd.schema and kept.where("text is null").count() == 0
    assert kept.count() == sum(r.kept for r in got)
    assert rows_of(Q.quality(docs.repartition(5))) == rows_of(Q.quality(docs))
