import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisearch import cli, errors
from lexisearch.functions import analysis as A
from lexisearch.functions import scalar as S
from lexisearch.operators import catalog, index, maintain, search
from lexisearch.plans import plugins
from lexisearch.sources import files
from lexisearch.sources.storage import SegmentStore
from lexisearch.streaming.ingest import apply_batch, ingest

ONE = [("a", ["我", "是", "一个", "程序员"]), ("b", ["我", "在", "用", "github"])]


def tokens_df(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id string, tokens array<string>")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def hits(postings, tokens, **kw):
    return [(r.doc_id, pytest.approx(r.bm25_score, rel=1e-6)) for r in search.search(postings, tokens, **kw).collect()]


# BM25


def test_two_documents(spark):
    p = index.build_postings(tokens_df(spark, ONE))
    assert hits(p, ["程序员"]) == [("a", 1.5849625)]
    assert hits(p, ["github"]) == [("b", 1.5849625)]
    assert hits(p, ["我"]) == [("a", 1.0), ("b", 1.0)]


def test_one_id_twice(spark):
    p = index.build_postings(tokens_df(spark, [("a", ONE[0][1]), ("a", ONE[1][1])]))
    assert hits(p, ["我"]) == [("a", 2.1793234)]


def test_one_document(spark):
    assert hits(index.build_postings(tokens_df(spark, ONE[:1])), ["程序员"]) == [("a", 1.0)]


def test_tokens_count_as_often_as_given(spark):
    p = index.build_postings(tokens_df(spark, ONE))
    assert hits(p, ["github", "github"]) == [("b", 2 * 1.5849625)]


def test_empty_terms_count_in_length_only(spark):
    p = index.build_postings(tokens_df(spark, [("a", ["x", ""]), ("b", ["y", "z"])]))
    rows = {(r.term, r.dl) for r in p.collect()}
    assert rows == {("x", 2), ("y", 2), ("z", 2)}


def test_average_below_one_gives_zero(spark):
    p = index.build_postings(tokens_df(spark, [("a", ["x"]), ("b", []), ("c", [])]))
    assert [r.bm25 for r in p.collect()] == [0.0]


def test_null_text_and_empty_table(spark):
    docs = spark.createDataFrame([("a", None), ("b", "x y")], "doc_id string, text string")
    assert {r.term for r in index.build_postings(docs).collect()} == {"x", "y"}
    assert index.build_postings(docs.where("false")).count() == 0
    assert search.search_documents(docs.where("false"), "x").count() == 0


def test_only_some_terms_have_the_same_impacts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = index.build_postings(docs).where("term in ('the', 'of')").collect()
    assert sorted(whole) == sorted(index.build_postings(docs, terms=["the", "of"]).collect())


# Search


def test_pages_join_up(spark, sf):
    p = index.build_postings(spark.read.parquet(f"{sf}/documents.parquet"), terms=["the"])
    both = search.search(p, ["the"], 8).collect()
    assert both == search.search(p, ["the"], 4).collect() + search.search(p, ["the"], 4, 4).collect()
    assert search.search(p, ["the"], 5, 10**6).count() == 0
    with pytest.raises(ValueError):
        search.search(p, ["the"], -1)


def test_batch_is_single_queries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = index.build_postings(docs)
    queries = spark.createDataFrame([(1, ["the", "of"]), (2, ["nothing-like-it"]), (3, ["and", "and"])], "query_id bigint, tokens array<string>")
    got = search.search_batch(p, queries, 3).orderBy("query_id", "rank").collect()
    for q, tokens in ((1, ["the", "of"]), (3, ["and", "and"])):
        assert [r.doc_id for r in got if r.query_id == q] == [r.doc_id for r in search.search(p, tokens, 3).collect()]
    assert not [r for r in got if r.query_id == 2]


def test_groups_together_are_the_whole(spark):
    docs = tokens_df(spark, [(str(i), ["x", str(i)]) for i in range(8)]).withColumn("group_id", (F.col("doc_id").cast("int") % 2))
    p = index.build_postings(docs)
    whole = {r.doc_id for r in search.search(p, ["x"]).collect()}
    assert whole == {r.doc_id for g in (0, 1) for r in search.search_shard(p, g, ["x"], groups=2).collect()}
    with pytest.raises(errors.ShardNotFound):
        search.search_shard(p, 2, ["x"], groups=2)


def test_latest_keeps_one_hit_of_a_document(spark):
    docs = tokens_df(spark, [("a", ["x"])], segment_id=0).unionByName(tokens_df(spark, [("a", ["x"])], segment_id=1))
    queries = spark.createDataFrame([(1, ["x"])], "query_id bigint, tokens array<string>")
    found = search.score(queries, index.build_postings(docs))
    assert found.count() == 2
    assert [r.segment_id for r in search.latest(found).collect()] == [1]


# Analysis


def test_normalizer(spark):
    q = F.lit("  Ｇit　HUB！\n")
    assert value(spark, A.normalize(q)).strip() == "git hub"
    assert value(spark, A.normalize(q, A.STRICT)) == "github"
    assert value(spark, A.normalize(F.lit(r"a\nB, c:9"))) == "ab c9"
    assert value(spark, A.normalize(F.lit(None).cast("string"))) is None
    assert value(spark, A.lower(F.lit("İΟΔΟΣ"))) == "iοδοσ"
    assert value(spark, A.simplify(F.lit("漢語學習"))) == "汉语学习"


def test_tokenizers(spark):
    assert value(spark, A.tokenize(F.lit("Git-Hub 42, Éa"))) == ["git", "hub", "42", "éa"]
    assert value(spark, A.tokenize_han(F.lit("程序员 ok 我"))) == ["程序", "序员", "ok", "我"]
    assert spark.createDataFrame([("a b",), (None,)], "t string").select(A.tokenizer(str.split)("t").alias("x")).collect() == [(["a", "b"],), ([],)]


def test_scalars(spark):
    assert value(spark, S.top_indices(F.array(*map(F.lit, [0.1, 0.5, 0.5, 0.2])), 3)) == [1, 2, 3]
    assert value(spark, S.top_indices(F.array(F.lit(1.0)), 5)) == [0]
    assert value(spark, S.shard_parts(F.lit("ns.1.0"))) == ("ns", 1, 0)
    assert value(spark, S.shard_parts(F.lit("ns.1"))) is None
    assert value(spark, S.shard_name(F.lit("ns"), F.lit(1), F.lit(0))) == "ns.1.0"
    assert value(spark, S.canonical_uuid(F.lit("{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}"))) == "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert value(spark, S.canonical_uuid(F.lit("x"))) is None
    assert value(spark, S.trace_id(F.lit("t"))) == "t" and len(value(spark, S.trace_id(F.lit("")))) == 36
    assert value(spark, S.segment_line(F.lit("2020-01-02 03:04:05").cast("timestamp"), F.lit(7), F.lit(3))) == "ctime=2020-01-02 03:04:05    id=7         num=3"


def test_murmur3(spark):
    assert S.murmur3_64(b"") == 0
    assert S.murmur3_64(b"hello") == 0xCBD8A7B341BD9B02
    assert S.murmur3_64(b"The quick brown fox jumps over the lazy dog") == 0xE34BBC7BBC071B6C
    assert value(spark, S.murmur3(F.lit("hello"))) == 0xCBD8A7B341BD9B02 - (1 << 64)


# Merging


def test_pick_segments():
    assert maintain.pick_segments([(3, 5), (1, 5), (2, 5), (4, 5)], 10) == [[1, 2], [3, 4]]
    assert maintain.pick_segments([(1, 0), (2, 100), (3, 1)], 100) == []
    assert maintain.pick_segments([(1, 1), (2, 1), (3, 1)], 100) == [[1, 2, 3]]
    assert maintain.pick_segments([(1, 60), (2, 60), (3, 1)], 100) == [[1, 2]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 99), max_size=20).map(sorted), min_size=1, max_size=4))
def test_kmerge_is_sort(spark, inputs):
    dfs = [spark.createDataFrame([(x,) for x in i], "x int") for i in inputs]
    assert [r.x for r in maintain.kmerge(dfs, "x").collect()] == sorted(sum(inputs, []))


def test_kmerge_fixed(spark):
    dfs = [spark.createDataFrame([(x,) for x in i], "x int") for i in ([], [-1, 5, 11], [], [6, 10])]
    assert [r.x for r in maintain.kmerge([None, *dfs], "x").collect()] == [-1, 5, 6, 10, 11]
    with pytest.raises(ValueError):
        maintain.kmerge([], "x")


# Placement


def test_placement(spark):
    got = [n for _, _, n in catalog.place(3, 2, ["n1", "n0"])]
    assert got == ["n0", "n1", "n1", "n0", "n0", "n1"]
    assert [n for _, _, n in catalog.place(4, 2, ["n0", "n1", "n2"])] == "n0 n1 n1 n2 n2 n0 n0 n1".split()
    assert [n for _, _, n in catalog.place(5, 1, ["n0", "n1", "n2"])] == "n0 n1 n2 n0 n0".split()
    with pytest.raises(errors.PlacementError):
        catalog.place(1, 2, ["n0"])


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "c"))
    c.create("news", 3, 2)
    with pytest.raises(errors.NamespaceExists):
        c.create("news")
    with pytest.raises(errors.NodeNotFound):
        c.add_node("news", "n0")
    for n in ("n0", "n1", "n2"):
        c.register_node(n)
    c.add_node("news", "n0")
    with pytest.raises(errors.NodeExists):
        c.add_node("news", "n0")
    with pytest.raises(errors.PlacementError):
        c.balance("news")
    c.add_node("news", "n1")
    with pytest.raises(errors.PlacementError):
        c.migrate("news", 0, 0, "n0", "n2")
    c.balance("news")
    assert {r.todo for r in c.shards().collect()} == {"create"}
    c.commit("news")
    c.migrate("news", 0, 0, "n0", "n2")
    assert c.shard("news", 0).todo == "migrate"
    c.commit("news")
    assert c.shard("news", 0).node == "n2"
    again = catalog.Catalog(spark, str(tmp_path / "c"))
    assert again.spaces == c.spaces and again.nodes_ == c.nodes_
    c.nodes_["n2"] = "offline"
    assert c.pick_replica("news", 0, 0) == "n1"
    with pytest.raises(errors.ShardNotFound):
        c.shard("news", 3)
    with pytest.raises(errors.ShardNotFound):
        c.shard("news", -1)
    asked = []

    def send(what, shard, node):
        asked.append((what, shard.group_id, shard.replica_id, node))
        return what != "remove" or len(asked) > 2

    c.nodes_["n2"] = "online"
    c.migrate("news", 0, 0, "n2", "n0")
    assert [s.todo for s in c.execute("news", send)] == ["remove"] and asked == [("create", 0, 0, "n0"), ("remove", 0, 0, "n2")]
    c = catalog.Catalog(spark, str(tmp_path / "c"))  # broken off after the switch
    c.balance("news")
    assert c.shard("news", 0).node == "n0" and c.shard("news", 0).todo == "remove"
    assert c.execute("news", send) == [] and asked[2:] == [("remove", 0, 0, "n2")] and c.shard("news", 0).todo is None
    c.drop("news")
    with pytest.raises(errors.NamespaceNotFound):
        c.get("news")


# Storage


def test_store_round(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"), index.IndexOptions(merge_num=10))
    assert s.add(tokens_df(spark, ONE[:1], namespace="n")) == 0
    assert s.add(tokens_df(spark, ONE[1:], namespace="n")) == 1
    assert s.add(tokens_df(spark, [], namespace="n")) is None
    s.validate()
    before = hits(s.postings("n"), ["我"])
    assert [d for d, _ in before] == ["a", "b"]
    assert s.compact() == [[0, 1]]
    assert hits(s.postings("n"), ["我"]) == before
    s.validate()
    (merged,) = s.manifest().collect()
    assert merged.num_docs == 2 and merged.segment_id > 1
    s.remove("n", spark.createDataFrame([("a",)], "doc_id string"))
    assert [d for d, _ in hits(s.postings("n"), ["我"])] == ["b"]
    assert len(hits(s.postings("n", apply_deletes=False), ["我"])) == 2
    s.add(tokens_df(spark, ONE[:1], namespace="n"))
    assert sorted(d for d, _ in hits(s.postings("n"), ["我"])) == ["a", "b"]
    assert s.postings("other").count() == 0
    info = catalog.shard_info(s.manifest()).collect()
    assert info[0].num_docs == 3 and info[0].n_segments == 2 and s.discover() == [("n", 0)]
    s.close()
    with pytest.raises(errors.IndexClosed):
        s.postings()
    with pytest.raises(errors.IndexClosed):
        s.add(tokens_df(spark, ONE))


@pytest.mark.parametrize("name", ["lengths", "postings"])
def test_a_damaged_store_is_noticed(spark, tmp_path, name):
    import shutil

    s = SegmentStore(spark, str(tmp_path / "i"))
    s.add(tokens_df(spark, ONE, namespace="n"))
    s.validate()
    folder = next((tmp_path / f"i/{name}/namespace=n/group_id=0").iterdir())
    held = spark.read.parquet(str(folder))
    rows, schema = held.collect(), held.schema
    shutil.rmtree(folder)
    spark.createDataFrame(rows[1:], schema).write.parquet(str(folder))
    with pytest.raises(errors.CorruptIndex):
        s.validate()


def test_a_failed_write_changes_nothing(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"))
    s.add(tokens_df(spark, ONE[:1], namespace="n"))
    before = s.version()
    with pytest.raises(ValueError):
        s.add(tokens_df(spark, [(None, ["x"])], namespace="n"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ivi"):
        s.add(tokens_df(spark, ONE, namespace="n").withColumn("group_id", F.expr("1 div (length(doc_id) - 1)").cast("int")))
    assert s.version() == before and [d for d, _ in hits(s.postings("n"), ["我"])] == ["a"]
    s.validate()
    assert s.add(tokens_df(spark, ONE[1:], namespace="n")) is not None
    assert [d for d, _ in hits(s.postings("n"), ["我"])] == ["a", "b"]


def test_two_writers(spark, tmp_path):
    """A merge that is overtaken by a removal begins anew; one that is overtaken by documents goes on."""
    a, b = (SegmentStore(spark, str(tmp_path / "i"), index.IndexOptions(merge_num=100)) for _ in range(2))
    for row in ONE:
        a.add(tokens_df(spark, [row], namespace="n"))
    real, done = a._merge, []

    def overtaken(before, into):
        if not done:
            done.append(b.remove("n", spark.createDataFrame([("a",)], "doc_id string")))
        elif len(done) == 1:
            done.append(b.add(tokens_df(spark, [("c", ["我"])], namespace="n")))
        real(before, into)

    a._merge = overtaken
    assert a.compact() == [[0, 1]]
    assert sorted(d for d, _ in hits(a.postings("n"), ["我"])) == ["b", "c"] and len(done) == 2
    a.validate()
    assert a._put(f"{a.path}/manifest/v{a.version()}.json", "") is False


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["add", "remove", "batch", "again", "compact", "both"]), st.sets(st.integers(0, 5), min_size=1, max_size=3)), min_size=3, max_size=6))
def test_any_order_of_changes(spark, tmp_path_factory, steps):
    """The store against a list of (segment's age, id) that is changed alike."""
    s = SegmentStore(spark, str(tmp_path_factory.mktemp("i")), index.IndexOptions(merge_num=100))
    live, number = [], 0
    for what, ids in steps:
        names = [str(i) for i in sorted(ids)]
        rows = [(n, ["x"]) for n in names]
        if what == "add":
            s.add(tokens_df(spark, rows, namespace="n"))
            live += names
        elif what == "remove":
            s.remove("n", spark.createDataFrame([(n,) for n in names], "doc_id string"))
            live = [d for d in live if d not in names]
        elif what == "compact":
            s.compact()
        else:
            if what == "again" and number:
                number -= 1
            applied = number <= s.applied("commands")
            if what == "both":  # the first id goes, the others come
                batch = [(0, "INDEX", names[0], ["x"]), (1, "REMOVE", names[0], None), *((2 + k, "INDEX", n, ["x"]) for k, n in enumerate(names[1:]))]
            else:
                batch = [(k, "INDEX", n, ["x"]) for k, n in enumerate(names)]
            apply_batch(s, "n", commands(spark, batch), number)
            if not applied:
                live = [d for d in live if what != "both" or d != names[0]] + names[what == "both" :]
            number += 1
        assert sorted(r.doc_id for r in s.postings("n").select("doc_id").collect()) == sorted(live), steps
    s.validate()


def test_a_dropped_namespace_is_gone(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"))
    for n in ("n", "m"):
        s.add(tokens_df(spark, ONE, namespace=n))
    s.remove("n", spark.createDataFrame([("a",)], "doc_id string"))
    s.drop("n")
    assert s.postings("n").count() == 0 and len(hits(s.postings("m"), ["我"])) == 2
    assert not (tmp_path / "i/postings/namespace=n/group_id=0/segment_id=0").exists() and s.tombstones().count() == 0


def test_merges_of_several_groups_and_spent_tombstones(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"), index.IndexOptions(merge_num=100))
    docs = tokens_df(spark, [(str(i), ["x", f"w{i}"]) for i in range(8)], namespace="a b").withColumn("group_id", F.col("doc_id").cast("int") % 2)
    for k in range(2):
        s.add(docs.where(f"cast(doc_id as int) % 4 div 2 = {k}"))
    s.remove("a b", docs.where("doc_id < '2'"))
    assert s.tombstones().count() == 2 and len(s.compact()) == 2
    assert s.tombstones().count() == 0 and {d for d, _ in hits(s.postings("a b"), ["x"])} == set("234567")
    assert sum(r.num_docs for r in s.manifest().collect()) == 6
    s.validate()


def test_latest_and_single_precision(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"))
    for _ in range(2):
        s.add(tokens_df(spark, ONE, namespace="n"))
    p = s.postings("n")
    assert len(hits(p, ["我"])) == 4
    assert [(r.segment_id, r.doc_id) for r in search.search(p, ["我"], dedup="latest").collect()] == [(1, "a"), (1, "b")]
    queries = spark.createDataFrame([(1, ["我"])], "query_id bigint, tokens array<string>")
    assert search.search_batch(p, queries, dedup="latest").count() == 2
    assert dict(search.search(p, ["github"], score_type="float").dtypes)["bm25_score"] == "float"
    with pytest.raises(ValueError):
        search.search(p, ["x"], dedup="oldest")


def test_places_are_asked_for_or_ignored(spark):
    docs = spark.createDataFrame([("a", "x y", "elsewhere", ["not", "tokens"])], "doc_id string, text string, group_id string, tokens array<string>")
    with pytest.raises(ValueError):
        index.build_postings(docs)
    assert {r.term for r in index.build_postings(docs, placed=()).collect()} == {"x", "y"}


# Streaming


def commands(spark, rows):
    """(seq, type, id, tokens) as commands."""
    df = spark.createDataFrame(rows, "seq bigint, type string, id string, tokens array<string>")
    index_ = F.col("type") == "INDEX"
    return df.select("type", F.when(index_, F.struct(F.col("id").alias("doc_id"), "tokens")).alias("doc"), F.when(~index_, F.col("id")).alias("doc_id"), "seq")


def test_a_batch_again_changes_nothing(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "i"))
    batch = commands(spark, [(0, "INDEX", "a", ["x"]), (1, "INDEX", "b", ["x"]), (2, "NOISE", "c", ["x"]), (3, "REMOVE", "b", None)])
    for _ in range(2):
        apply_batch(s, "n", batch, 0)
    assert [d for d, _ in hits(s.postings("n"), ["x"])] == ["a"]
    apply_batch(s, "n", commands(spark, [(0, "REMOVE", "a", None), (1, "INDEX", "a", ["x", "y"])]), 1)
    assert [(d) for d, _ in hits(s.postings("n"), ["x"])] == ["a"]
    assert s.postings("n").where("segment_id = 0").count() == 0


def test_stream_from_files(spark, tmp_path):
    log = str(tmp_path / "log")
    s = SegmentStore(spark, str(tmp_path / "i"))
    docs = tokens_df(spark, ONE)

    def run():
        stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
        ingest(stream, s, "n", str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination()

    files.append_commands(files.index_commands(docs, 2), log, "n")
    run()
    assert len(hits(s.postings("n"), ["我"])) == 2
    files.append_commands(files.remove_commands(docs.where("doc_id = 'a'"), 2), log, "n")
    files.append_commands(files.index_commands(tokens_df(spark, [("c", ["我"]), ("d", ["我"])]), 2), log, "n")
    files.append_commands(files.remove_commands(spark.createDataFrame([("c",)], "doc_id string"), 2), log, "n")
    run()
    assert sorted(d for d, _ in hits(s.postings("n"), ["我"])) == ["b", "d"]


def test_messages_and_quarantine(spark, tmp_path):
    uuid = "6BA7B810-9DAD-11D1-80B4-00C04FD430C8"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"type":"INDEX","doc":{"doc_id":"%s","tokens":["x"]},"seq":1}\n{oops\n{"type":"REMOVE"}\n' % uuid)
    s = SegmentStore(spark, str(tmp_path / "i"))
    q = ingest(files.command_stream(spark, str(tmp_path / "in"), "json"), s, "n", str(tmp_path / "state"), trigger={"processingTime": "1 second"}, quarantine=str(tmp_path / "bad"))
    s.close()  # takes what is there, then stops
    assert not q.isActive
    s = SegmentStore(spark, str(tmp_path / "i"))
    assert [d for d, _ in hits(s.postings("n"), ["x"])] == [uuid.lower()]
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(["{oops", '{"type":"REMOVE"}'])
    with pytest.raises(ValueError):
        files.command_stream(spark, "x", "other")


def test_malformed_messages_are_left_out(spark):
    rows = spark.createDataFrame([('{"type":"INDEX","doc":{"doc_id":"a","tokens":["x"]},"seq":1}',), ("{oops",), (None,), ('{"type":"REMOVE"}',), ('{"type":"REMOVE","doc_id":"a","seq":2}',)], "value string")
    assert [r.type for r in files.parse_commands(rows).collect()] == ["INDEX", "REMOVE"]
    assert files.malformed(rows).count() == 3
    log = rows.selectExpr("value", "cast(7 as bigint) as offset", "timestamp_micros(5) as timestamp")
    assert {(r.seq, r.appended) for r in files.parse_commands(log).collect()} == {(7, 5)}


# Plugins, sources, command line


def test_registry(spark):
    r = plugins.standard()
    with pytest.raises(errors.PluginError):
        r.register(plugins.Segmenter())
    with pytest.raises(errors.PluginError):
        plugins.standard(("nothing",))
    with pytest.raises(errors.PluginError):
        r.get("nothing")
    raw = spark.createDataFrame([(1, "Git HUB!", ["given"], None)], "query_id bigint, raw string, tokens array<string>, tags array<string>")
    assert r.analyze(raw).first().tokens == ["given", "git", "hub"]
    with pytest.raises(errors.NoQuery):
        r.analyze(raw.where("false"))
    order = []

    class P(plugins.Plugin):
        def cleanup(self):
            order.append(self.name)

    r.register(P("late", 9))
    r.register(P("early", 0))
    r.cleanup()
    assert order == ["late", "early"]


def test_classifier(spark):
    import numpy as np

    vectors = {"U": np.zeros(2), "P": np.zeros(2), "a": np.array([1.0, 0.0]), "b": np.array([0.0, 1.0])}
    c = plugins.Classifier(tags=["A", "B", "none"], embeddings=vectors, score=lambda x: np.concatenate([x.sum(axis=1), np.full((len(x), 1), 0.5)], axis=1), k=2)
    raw = spark.createDataFrame([(1, "aab", [], []), (2, "b" * 300, [], ["given"]), (3, None, [], None)], "query_id bigint, raw string, tokens array<string>, tags array<string>")
    got = {r.query_id: r.tags for r in c.analyze(raw).collect()}
    assert got == {1: ["A", "B"], 2: ["given", "B", "none"], 3: ["none", "A"]}


def test_files(spark, tmp_path):
    (tmp_path / "stop").write_text("的x\n\n,\n的\n")
    assert files.read_stopwords(spark, str(tmp_path / "stop")) == ",的"
    (tmp_path / "emb").write_text("2 3\n我 1 2 3\nU 0 0 0\n")
    assert {r.token: r.vector for r in files.read_embeddings(spark, str(tmp_path / "emb")).collect()} == {"我": [1, 2, 3], "U": [0, 0, 0]}
    (tmp_path / "tags").write_text("a\nb\n")
    assert files.read_tags(spark, str(tmp_path / "tags")) == ["a", "b"]


def test_command_line(spark, tmp_path, capsys):
    def do(*args):
        return [json.loads(r) for r in cli.main(["--data", str(tmp_path), *args])]

    for n in ("n0", "n1"):
        do("node", n)
    do("create", "news")
    for n in ("n0", "n1"):
        do("add", "news", n)
    do("balance", "news")
    do("commit", "news")
    assert [r["node"] for r in do("info")] == ["n0", "n1", "n1", "n0", "n0", "n1"]
    (doc,) = do("index", "news", "--content", "Microsoft completes GitHub acquisition")
    (hit,) = do("search", "news", "github")
    assert len(hit["trace_id"]) == 36 and do("search", "news", "github", "--trace", "t1", "--dedup", "latest")[0]["trace_id"] == "t1"
    assert hit["doc_id"] == doc["doc_id"] and hit["bm25_score"] == pytest.approx(1.0)
    (tmp_path / "lines").write_text("github one\ngithub two\n")
    assert len(do("index", "news", "--file", str(tmp_path / "lines"))) == 2
    assert len(do("search", "news", "github")) == 3
    do("compact", "news")
    do("remove", "news", doc["doc_id"])
    assert len(do("search", "news", "GITHUB!")) == 2
    assert sum(r["num_docs"] for r in do("segments", "news")) == 3
    assert not list((tmp_path / "incoming/news").iterdir())
    assert {r["addr"] for r in do("nodes")} == {"n0", "n1"} and do("namespaces")[0]["shard_num"] == 3 and len(do("members", )) == 2
    assert sum(len(do("search-shard", "news", "github", "--group", str(g))) for g in range(3)) == 2
    files.append_commands(files.index_commands(tokens_df(spark, [("z", ["github"])]), 3), str(tmp_path / "log"), "news")
    do("ingest", "news", str(tmp_path / "log"))
    do("validate", "news")
    assert len(do("search", "news", "github")) == 3
    do("drop", "news", "--data")
    do("create", "news")
    assert do("search", "news", "github") == []
    with pytest.raises(errors.NamespaceNotFound):
        do("search", "nothing", "x")
