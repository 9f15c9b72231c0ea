from collections import Counter

import corpus_pipeline as C
from lexisearch.llm import neardup, quality, secrets


def after(spark, docs, sf, n):
    for _, f in C.STAGES[:n]:
        docs = C.materialize(f(spark, docs, sf))
    return docs


def test_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "packing"]


def test_stages_decide(spark, docs, sf):
    good = after(spark, docs, sf, 1)
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert good.schema == docs.schema and {r.doc_id for r in good.collect()} == kept
    once = C.materialize(C.near_dedup(spark, good, sf))
    groups = neardup.groups(good).collect()
    gone = {r.doc_id for r in groups if r.doc_id != r.group_id}
    assert once.schema == docs.schema and {r.doc_id for r in once.collect()} == kept - gone and gone
    clean = C.materialize(C.secret_scan(spark, once, sf))
    assert clean.count() == once.count() and secrets.find_secrets(clean).count() == 0
    windows = C.packing(spark, clean, sf)
    assert {d for r in windows.collect() for d in r.doc_ids} == {r.doc_id for r in clean.collect()}
    assert sorted(map(str, C.run(spark, sf).collect())) == sorted(map(str, windows.collect()))


def test_awkward_rows(spark, odd, sf):
    docs = odd
    for name, f in C.STAGES[:-1]:
        out = C.materialize(f(spark, docs, sf))
        assert out.dtypes == docs.dtypes, name
        docs = out
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[9] <= 1 and not ids[3] + ids[4] + ids[5] + ids[6]
    assert C.packing(spark, docs, sf).count() >= 1
    empty = odd.where("false")
    for _, f in C.STAGES:
        assert f(spark, empty, sf).count() == 0


def test_one_row_of_an_id_stays(spark, sf):
    rows = [(1, "b text that stands for itself alone"), (1, "a text of quite another kind again"), (2, None), (2, None), (None, "x y z"), (None, "x y z"), (3, "alone")]
    got = sorted(C.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf).collect(), key=repr)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(1, rows[1][1]), (2, None), (None, "x y z"), (None, "x y z"), (3, "alone")]))
