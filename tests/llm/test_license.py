import math
import re

import pytest
from pyspark.sql import functions as F

from lexisearch.llm import license as L

WORD = re.compile(r"[\u3005\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]|[0-9a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2080-\u2fff\u3100-\u33ff\ua000-\uf8ff\ufb00-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\U0001ffff\U00034000-\U0010ffff]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute(texts):
    """Every window of every text against every template."""
    n = len(texts)
    have = [set(words(t)) for t in texts]
    terms = {w for _, t in L.TEMPLATES for w in words(t)}
    idf = {w: math.log((n + 1) / (sum(w in h for h in have) + 1)) + 1 for w in terms}
    unseen = math.log(n + 1) + 1

    def vector(ws):
        out = {}
        for w in ws:
            out[w] = out.get(w, 0) + idf.get(w, unseen)
        return out

    found = []
    for t in texts:
        ws, best = words(t), None
        for k, (name, template) in enumerate(L.TEMPLATES):
            tw = words(template)
            v = vector(tw)
            cues = [i for i, w in enumerate(tw) if w in L.CUES]
            for s in range(len(ws)):
                if not any(s + i < len(ws) and ws[s + i] == tw[i] for i in cues):
                    continue
                u = vector(ws[s : s + len(tw)])
                c = sum(x * v.get(w, 0) for w, x in u.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
                if c >= L.LEAST and (best is None or (round(c, 9), len(tw), -k) > best[0]):
                    best = ((round(c, 9), len(tw), -k), name)
        found.append(best and best[1])
    return found


def test_headers_as_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    extra = ["Licensed under the Apache Licence, Version 2.0", "some words. RELEASED!! UNDER!! THE!! MIT!! LICENSE!! more", "A driving license is needed.", "licensed under CC BY 4.0 and licensed under CC BY-NC 4.0.", "license", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"]
    texts = [r.text for r in rows] + extra
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("path", F.lit("x/y"))
    got = {r.doc_id: r.license for r in L.headers(df.select("doc_id", "path", "text").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(x is not None for x in got.values()) >= 4


def test_inheritance(spark):
    mit, gpl = "MIT License\n" + "Permission is hereby granted, free of charge, to any person obtaining a copy", "Licensed under CC BY 4.0."
    rows = [
        (1, "LICENSE", mit), (2, "a/b/c.txt", "nothing here"), (3, "a/LICENSE.md", gpl), (4, "a/b/d.txt", gpl + " " + "w " * 50),
        (5, "top.txt", "plain"), (6, "/a//x.txt", "plain"), (7, None, "plain"), (8, "ab/x.txt", "plain"), (9, "a/b/e/f/g.txt", None), (9, "a/b/e/f/g.txt", None), (None, "a/z.txt", ""),
    ]
    got = [(r.doc_id, r.license, r.evidence, r.from_dir) for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()]
    want = [
        (1, "MIT", "own", None), (2, "CC-BY-4.0", "inherited", "a"), (3, "CC-BY-4.0", "own", None), (4, "CC-BY-4.0", "own", None), (5, "MIT", "inherited", ""), (6, "CC-BY-4.0", "inherited", "a"),
        (7, None, None, None), (8, "MIT", "inherited", ""), (9, "CC-BY-4.0", "inherited", "a"), (9, "CC-BY-4.0", "inherited", "a"), (None, "CC-BY-4.0", "inherited", "a"),
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_the_most_similar_file_speaks(spark):
    rows = [(1, "d/LICENSE", "Licensed under CC BY 4.0."), (2, "d/COPYING", "Released under the MIT License."), (3, "d/x", "plain")]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got[3] == "CC-BY-4.0"


def test_corpus(spark, sf, docs):
    got = L.op8_license_scan(spark, sf).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert (r.evidence == "own") == bool(re.search(r"(?i)license[d]? under|mit license", text[r.doc_id]))


def test_table(odd):
    assert L.scan(odd).where("license is not null").count() == 0 and L.scan(odd).count() == odd.count()
    assert L.scan(odd.where("false")).count() == 0


@pytest.mark.parametrize("path,dir_", [("a/b", "a"), ("a", ""), ("a/b/", "a/b"), ("", "")])
def test_parent(spark, path, dir_):
    assert spark.range(1).select(L.parent(F.lit(path))).first()[0] == dir_
