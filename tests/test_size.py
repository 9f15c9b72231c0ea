"""What is done once, and what does not grow with the tables."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexisearch.functions.analysis import tokenize, word_edges
from lexisearch.operators import index, maintain, search
from lexisearch.plans.queries import six_digits
from lexisearch.sources import tables
from lexisearch.sources.storage import SegmentStore
from lexisearch.streaming.ingest import apply_batch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted_docs(spark, n=40):
    """Documents whose tokens a Python function makes, and the number of times it did."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(t):
        calls.add(1)
        return t.split(" ")

    rows = spark.createDataFrame([(str(i), f"a b{i % 3} c{i} a") for i in range(n)], "doc_id string, text string").repartition(3)
    return rows.select("doc_id", cut("text").alias("tokens"), F.lit("n").alias("namespace")), calls


def test_counts_are_made_where_the_documents_are(spark):
    docs = index.analyzed(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b a").alias("text")))
    rows = index.term_frequencies(docs)
    assert "Exchange" not in plan(rows) and rows.count() == 100
    assert {(r.term, r.tf, r.dl) for r in rows.collect()} == {("a", 2, 3), ("b", 1, 3)}


def test_repeated_ids_null_and_empty_terms(spark, monkeypatch):
    dice, want, df = random.Random(1), {}, {}
    rows = [(dice.choice(["a", "b", None, f"x{i}"]), dice.randrange(3), [dice.choice(["p", "q", "", None, "Ω"]) for _ in range(dice.randrange(9))]) for i in range(60)]
    for d, s, tokens in rows:
        for t in filter(None, tokens):
            tf, dl = want.get((s, t, d), (0, 0))
            want[s, t, d] = tf + 1, max(dl, len(tokens))
    for s, t, _ in want:
        df[s, t] = df.get((s, t), 0) + 1
    table = spark.createDataFrame(rows, "doc_id string, segment_id int, tokens array<string>")
    docs = index.analyzed(table)
    assert {(r.segment_id, r.term, r.doc_id): (r.tf, r.dl) for r in index.term_frequencies(docs).collect()} == want
    assert {(r.segment_id, r.term): r.df for r in index.document_frequencies(docs).collect()} == df
    few = {(r.segment_id, r.term, r.doc_id, r.tf, r.dl, round(r.bm25, 12)) for r in index.build_postings(table, terms=["p", "q", "Ω"]).collect()}
    monkeypatch.setattr(index, "BROADCAST_IDS", 1)
    assert {(r.segment_id, r.term, r.doc_id, r.tf, r.dl, round(r.bm25, 12)) for r in index.build_postings(table).collect()} == few and len(few) == len(want)


def test_frequent_words_are_in_several_blocks(spark):
    n = 2 * index.BLOCK + 7
    docs = index.analyzed(spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")))
    assert sorted(r.n for r in index.blocks(docs).where("term = 'a'").collect())[-1] <= index.BLOCK
    assert index.build_postings(docs.drop("tokens").withColumn("text", F.lit("a"))).select("doc_id").distinct().count() == n


def test_texts_are_analyzed_once(spark, tmp_path):
    docs, calls = counted_docs(spark)
    assert index.build_postings(docs).count() == 120 and calls.value == 40
    docs, calls = counted_docs(spark)
    s = SegmentStore(spark, str(tmp_path / "i"))
    s.add(docs)
    s.validate()
    assert calls.value == 80  # lengths, then postings


def test_few_removals_do_not_move_the_postings(spark, tmp_path):
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = index.build_postings(spark.createDataFrame([("a", "x"), ("b", "x")], "doc_id string, text string"))
        gone = spark.createDataFrame([("default", "a", 0)], "namespace string, doc_id string, upto bigint")
        rest = maintain.without(p, gone)
        assert [r.doc_id for r in rest.collect()] == ["b"]
        held = spark.createDataFrame(p.collect(), p.schema)
        assert "SortMergeJoin" not in plan(maintain.without(held, gone)) and "BroadcastHashJoin" in plan(maintain.without(held, gone))
        s, seen = SegmentStore(spark, str(tmp_path / "i")), []
        s.add = lambda docs, **more: seen.append(plan(docs))
        commands = spark.createDataFrame([("INDEX", ("a", ["x"]), None, 1), ("REMOVE", None, "b", 2)], "type string, doc struct<doc_id: string, tokens: array<string>>, doc_id string, seq bigint")
        apply_batch(s, "n", commands, 0)
        assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_batch_search_deals_out_by_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 5} c{i % 7}") for i in range(200)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(q, ["a", f"b{q}", "c1"]) for q in range(5)], "query_id bigint, tokens array<string>")
    p = index.build_postings(docs)
    want = sorted(search.search_batch(p, queries, 3).collect())
    monkeypatch.setattr(search, "PAIRS", 50)
    found = search.search_batch(p, queries, 3, documents=200)
    assert "hashpartitioning(group_id" in plan(found) and ", 20), REPARTITION_BY_NUM" in plan(found)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, group_id", plan(found))
    assert sorted(found.collect()) == want


def test_six_digits_is_round(spark):
    dice = random.Random(3)
    values = [0.0, 1e-7, 5e-7, 0.1234565, 1.0000005, 2.5e-6, 3.1, 999999.9999995, 1e6, 1e12, -0.1234565, -1.5, float("nan"), None]
    values += [dice.random() * 10 ** dice.randrange(-3, 5) for _ in range(2000)] + [dice.randrange(10**9) / 1e6 + 5e-7 for _ in range(2000)]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    assert x.where(~six_digits(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0


def test_few_row_groups_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1000)
    cores = spark.sparkContext.defaultParallelism
    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(50_000).repartition(3 * cores).write.parquet(str(tmp_path / "many.parquet"))
    one = tables.read_table(spark, str(tmp_path), "one")
    assert "RoundRobinPartitioning" in plan(one) and one.rdd.getNumPartitions() >= cores and one.count() == 50_000
    assert "Exchange" not in plan(tables.read_table(spark, str(tmp_path), "many"))


def test_workers_find_the_tokens_of_the_jvm(spark):
    dice = random.Random(5)
    ranges = [(32, 127), (32, 127), (0xA0, 0x600), (0x600, 0xD800), (0xE000, 0x110000), (0x10000, 0x20000)]
    texts = [None, "", "a", " ", "ΑΣ'Α ΑΣ İx", "é", "naïve—Straße", "x" * 5000] + ["".join(chr(dice.randrange(*dice.choice(ranges))) for _ in range(dice.randrange(40))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("low"), tokenize(F.col("t")).alias("want")).orderBy("i").collect()
    low, table = pa.array([r.low for r in rows], pa.string()), index._word_table(np.array(word_edges(spark)))
    for start in (0, 7):
        tokens, sizes = index._words(low.slice(start), table)
        assert sizes.tolist() == [len(r.want) for r in rows[start:]]
        assert tokens.to_pylist() == [t for r in rows[start:] for t in r.want]


def analyzed_batch(rows):
    """Of (segment, id, text)."""
    segments, ids, texts = zip(*rows, strict=True)
    columns = [pa.array(["n"] * len(rows)), pa.array([0] * len(rows), pa.int32()), pa.array(segments, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*index.SEGMENT, "doc_id", "lowered"])


def test_terms_are_counted_by_the_task(spark):
    batches = [analyzed_batch([(0, 3 * i + j, f"a b{j} a") for j in range(3)]) for i in range(5)]
    found = [r for b in index._term_counts(iter(batches), np.array(word_edges(spark))) for r in b.to_pylist()]
    assert sorted((r["term"], r["n"]) for r in found) == [("a", 15), ("b0", 5), ("b1", 5), ("b2", 5)]


def test_postings_are_shuffled_in_packets(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 5}", i % 4) for i in range(20)], "doc_id bigint, text string, segment_id bigint")
    steps = plan(index.build_postings(docs))
    assert "Join" not in steps and steps.count("Exchange ") == 1
    assert re.search(r"Exchange \w*\(.*packet#", steps) and "hashpartitioning" not in steps


def test_packets_stream_with_whole_counts(spark, monkeypatch):
    dice = random.Random(8)
    docs = [(i % 3, i, " ".join(dice.choice(["p", "q", "Ω", f"x{i % 7}", f"y{i}"]) for _ in range(dice.randrange(6)))) for i in range(90)]
    monkeypatch.setattr(index, "SLICE", 8)  # counts are compacted, and postings weighed, many times
    monkeypatch.setattr(index, "TEXT", 30)
    packed = pa.concat_tables([pa.Table.from_batches([b]) for b in index._dealt(iter([analyzed_batch(docs[i : i + 20]) for i in range(0, 90, 20)]), np.array(word_edges(spark)), 3)])
    packed = packed.sort_by([("packet", "ascending"), ("kind", "ascending")])
    assert set(packed.column("packet").to_pylist()) == {0, 1, 2}
    found = [r for b in index._weighed(iter(packed.to_batches(5))) for r in b.to_pylist()]
    want = {}
    for s in range(3):
        mine = [(d, t.split()) for x, d, t in docs if x == s]
        avg = sum(len(t) for _, t in mine) // len(mine)
        for d, t in mine:
            for w in set(t):
                df, tf = sum(w in u for _, u in mine), t.count(w)
                want[s, w, d] = tf, len(t), round(math.log2(len(mine) / df + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)), 9)
    assert len(found) == len(want)
    assert {(r["segment_id"], r["term"], r["doc_id"]): (r["tf"], r["dl"], round(r["bm25"], 9)) for r in found} == want


def test_logarithms_are_the_jvms(spark):
    rows = spark.range(1, 20_001).select((F.lit(20_000.0) / F.col("id") + 1).alias("x"), F.log2(F.lit(20_000.0) / F.col("id") + 1).alias("y")).collect()
    assert (index._log(np.array([r.x for r in rows])) / index._log(np.array([2.0]))).tolist() == [r.y for r in rows]
