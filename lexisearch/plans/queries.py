"""Registered queries and their SQL for DuckDB. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.functions import analysis as A
from lexisearch.functions import scalar as S
from lexisearch.operators import catalog, index, maintain, search
from lexisearch.plans.plugins import Plugin, standard
from lexisearch.schemas import SEGMENTS
from lexisearch.sources import files, shared
from lexisearch.sources.tables import read_table as table

QUERY = "the and attion thanedble"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str, segments: int = 1, groups: int = 1) -> DataFrame:
    """The documents dealt to groups and segments by their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("group_id", F.pmod("doc_id", F.lit(groups)).cast("int")).withColumn("segment_id", F.pmod("doc_id", F.lit(segments)))


def six_digits(x: Column) -> Column:
    """``round(x, 6)``, which takes the number's decimal text apart: only where the seventh digit
    may be a five is that needed, elsewhere the nearest millionth is known without it."""
    scaled = x * 1e6
    whole = F.floor(scaled)
    clear = (x >= 0) & (x < 1e6) & (F.abs(scaled - whole - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(F.round(x, 6))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six_digits(F.col(c)) if t == "double" else F.round(c, 6) for c, t in df.dtypes if c in columns})


def _tokens(text: str = "text") -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}]+')"


def _postings(segments: int = 1, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Common table expressions d, s, tf and p: documents, statistics, frequencies, postings."""
    return f"""
WITH d AS (SELECT {key} AS doc_id, {f"{key} % {segments}" if segments > 1 else "0"} AS segment_id, {_tokens(text)} AS t FROM {source}),
s AS (SELECT segment_id, count(*) AS n, sum(len(t))::BIGINT AS total, (sum(len(t)) // count(*))::BIGINT AS avgdl FROM d GROUP BY 1),
x AS (SELECT segment_id, doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT segment_id, doc_id, term, count(*) AS tf, max(dl) AS dl FROM x GROUP BY 1, 2, 3),
f AS (SELECT *, count(*) OVER (PARTITION BY segment_id, term) AS df FROM tf),
p AS (SELECT f.segment_id, doc_id, term, tf,
             CASE WHEN avgdl = 0 THEN 0e0 ELSE log2(n / df + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) END AS bm25
      FROM f JOIN s ON f.segment_id = s.segment_id)"""


def _terms(text: str) -> str:
    return f"q AS (SELECT unnest({_tokens(f"'{text}'")}) AS term)"


def _hits(words: str = QUERY, segments: int = 1, where: str = "TRUE", start: int = 0, count: int = 10, tie: str = "doc_id", **source: str) -> str:
    return f"""{_postings(segments, **source)}, {_terms(words)}
SELECT segment_id::BIGINT AS segment_id, doc_id, round(score, 6) AS bm25_score FROM (
  SELECT segment_id, doc_id, sum(bm25) AS score FROM p JOIN q USING (term) WHERE {where} GROUP BY 1, 2)
ORDER BY round(score, 9) DESC, {tie}, segment_id LIMIT {count} OFFSET {start}"""


def _found(df: DataFrame) -> DataFrame:
    return rounded(df, "bm25_score")


# Analysis and the index


@query(f"SELECT doc_id, len({_tokens()})::INTEGER AS n_tokens FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(A.tokenize(F.col("text"))).alias("n_tokens"))


@query(f"{_postings()} SELECT doc_id, term, tf FROM tf")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequencies(index.analyzed(documents(spark, sf_dir))).select("doc_id", "term", "tf")


@query(f"{_postings()} SELECT term, count(*) AS df FROM tf GROUP BY 1")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequencies(index.analyzed(documents(spark, sf_dir))).select("term", "df")


@query(f"{_postings(4)} SELECT segment_id::BIGINT AS segment_id, doc_id, len(t)::INTEGER AS dl FROM d")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_lengths(index.analyzed(documents(spark, sf_dir, 4))).select("segment_id", "doc_id", "dl")


@query(f"{_postings(4)} SELECT segment_id::BIGINT AS segment_id, n AS num_docs, total AS total_length, avgdl AS avg_length FROM s")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.segment_stats(index.analyzed(documents(spark, sf_dir, 4))).select("segment_id", "num_docs", "total_length", "avg_length")


@query(f"{_postings()} SELECT doc_id, term, tf, round(bm25, 6) AS bm25 FROM p")
def bm25_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.build_postings(documents(spark, sf_dir)).select("doc_id", "term", "tf", "bm25"), "bm25")


@query(f"{_postings(4)} SELECT segment_id::BIGINT AS segment_id, doc_id, term, tf, round(bm25, 6) AS bm25 FROM p")
def bm25_impacts_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.build_postings(documents(spark, sf_dir, 4)).select("segment_id", "doc_id", "term", "tf", "bm25"), "bm25")


# Search


@query(_hits())
def search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir), QUERY))


@query(_hits("thanedble"))
def search_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir), "thanedble"))


@query(_hits("zzyzxqq"))
def search_missing_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir), "zzyzxqq"))


@query(_hits("the the thanedble"))
def search_duplicate_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir), "the the thanedble"))


@query(_hits(start=10))
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir), QUERY, start=10))


@query(
    f"""{_postings()},
q AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_tokens()}) AS term FROM benchmark) GROUP BY 1, 2),
h AS (SELECT query_id, doc_id, sum(n * bm25) AS score FROM p JOIN q USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)
SELECT query_id, rank::INTEGER AS rank, 0::BIGINT AS segment_id, doc_id, round(score, 6) AS bm25_score FROM r WHERE rank <= 5"""
)
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), A.tokenize(F.col("text")).alias("tokens"))
    docs = documents(spark, sf_dir)
    return _found(search.search_batch(index.build_postings(docs, terms=search.query_terms(raw)), raw, 5, documents=docs.count()))


@query(_hits(segments=4))
def search_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir, 4, 4), QUERY))


@query(_hits(segments=4, where="segment_id IN (0, 2)"))
def search_some_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search_documents(documents(spark, sf_dir, 4, 4), QUERY, groups=[0, 2]))


@query(
    f"""{_postings(8)}, {_terms(QUERY)},
h AS (SELECT segment_id, doc_id, sum(bm25) AS score FROM p JOIN q USING (term) WHERE segment_id % 4 = 1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)
SELECT segment_id::BIGINT AS segment_id, doc_id, round(score, 6) AS bm25_score FROM r WHERE rank <= 10"""
)
def search_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = QUERY.split()
    return _found(search.search_shard(index.build_postings(documents(spark, sf_dir, 8, 4), terms=tokens), 1, tokens, 10, groups=4))


@query(_hits(where="doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def search_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("default").alias("namespace"), "doc_id", F.lit(0).cast("bigint").alias("upto"))
    tokens = QUERY.split()
    return _found(search.search(maintain.without(index.build_postings(documents(spark, sf_dir), terms=tokens), gone), tokens))


@query(f"WITH h AS ({_hits()}) SELECT doc_id, text AS content, bm25_score FROM h JOIN documents USING (doc_id)")
def search_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _found(search.with_content(search.search_documents(docs, QUERY), docs).select("doc_id", "content", "bm25_score"))


class LengthBoost(Plugin):
    """Raises hits in short documents: the score times 1 + 100 / length."""

    def __init__(self, lengths: DataFrame):
        super().__init__("length_boost", 9)
        self.lengths = lengths

    def rerank(self, hits: DataFrame) -> DataFrame:
        long = self.lengths.select("segment_id", "doc_id", "dl")
        return hits.join(long, ["segment_id", "doc_id"]).withColumn("bm25_score", F.col("bm25_score") * (1 + 100 / F.col("dl"))).drop("dl")


@query(
    f"""{_postings()}, {_terms(QUERY)},
h AS (SELECT doc_id, sum(bm25) AS score FROM p JOIN q USING (term) GROUP BY 1),
b AS (SELECT doc_id, score * (1 + 100e0 / len(t)) AS score FROM h JOIN d USING (doc_id))
SELECT 0::BIGINT AS segment_id, doc_id, round(score, 6) AS bm25_score FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 10"""
)
def rerank_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = index.analyzed(documents(spark, sf_dir))
    plugins = standard(())
    plugins.register(LengthBoost(index.doc_lengths(docs)))
    tokens = QUERY.split()
    return _found(search.search(index.build_postings(docs, terms=tokens), tokens, rerank=plugins.rerank))


def _other(spark: SparkSession, sf_dir: str, name: str, key: str, text: str, words: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(F.expr(key).alias("doc_id"), F.col(text).alias("text"), F.lit(name).alias("namespace"))
    return _found(search.search_documents(rows, words))


@query(_hits("the and attion", source="conversations", key="(conv_id * 1000 + turn)"))
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other(spark, sf_dir, "conversations", "conv_id * 1000 + turn", "text", "the and attion")


@query(_hits("article the charset", source="pages", key="page_id", text="html"))
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other(spark, sf_dir, "pages", "page_id", "html", "article the charset")


@query(_hits("red widget", source="part", key="p_partkey", text="p_name"))
def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other(spark, sf_dir, "part", "p_partkey", "p_name", "red widget")


# Query analysis



def _normal(q: str) -> str:
    quoted = [x.replace("'", "''") for x in (A._WIDE, A._HALF, A.PUNCTUATION)]
    q = rf"translate(trim(regexp_replace({q}, '\\n|\n', '', 'g'), ' '), '{quoted[0]}', '{quoted[1]}')"
    return rf"regexp_replace(translate(lower(translate({q}, 'Σİ', 'σi')), '{quoted[2]}', ''), '[^\p{{Han}}\p{{Nd}}\p{{Ll}} ]', '', 'g')"


@query(f"SELECT conv_id, turn, {_normal('text')} AS raw FROM conversations")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.normalize(F.col("text")).alias("raw"))


@query("SELECT * FROM (VALUES (1, '学习汉语'), (2, '搜索引擎 abc'), (3, '简体')) AS x(query_id, raw)")
def t2s_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "學習漢語"), (2, "搜索引擎 abc"), (3, "簡體")], "query_id int, raw string")
    return rows.select("query_id", A.simplify(F.col("raw")).alias("raw"))


@query(f"SELECT item_id AS query_id, {_normal('text')} AS raw, {_tokens(_normal('text'))} AS tokens FROM benchmark")
def analyze_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw"), none.alias("tokens"), none.alias("tags"))
    return standard().analyze(raw).select("query_id", "raw", "tokens")


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS k FROM x)
SELECT vec_id, list(i::INTEGER ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY 1"""
)
def topk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", S.top_indices(F.col("embedding"), 5).alias("top"))


# Segments, shards, maintenance


@query("SELECT (doc_id % 4)::INTEGER AS group_id, count(*) AS n FROM documents GROUP BY 1")
def route_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, 1, 4).groupBy("group_id").agg(F.count("*").alias("n"))


@query(f"{_postings(4)} SELECT 9::BIGINT AS segment_id, doc_id, term, round(bm25, 6) AS bm25 FROM p WHERE segment_id IN (1, 3) UNION ALL SELECT segment_id, doc_id, term, round(bm25, 6) FROM p WHERE segment_id NOT IN (1, 3)")
def merge_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = maintain.relabel(index.build_postings(documents(spark, sf_dir, 4)), [1, 3], 9)
    return rounded(merged.select("segment_id", "doc_id", "term", "bm25"), "bm25")


@query(_hits(segments=4).replace("segment_id::BIGINT AS segment_id", "9::BIGINT AS segment_id"))
def search_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = QUERY.split()
    rows = index.build_postings(documents(spark, sf_dir, 4), terms=tokens)
    return _found(search.search(maintain.merge_postings(rows, [0, 1, 2, 3], 9), tokens))


@query(f"{_postings(4)} SELECT term, count(*) AS df FROM p GROUP BY 1")
def merged_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.merged_frequencies(index.blocks(index.analyzed(documents(spark, sf_dir, 4)), False))


@query(f"{_postings(4)} SELECT DISTINCT term, segment_id::BIGINT AS segment_id FROM p")
def kmerge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.blocks(index.analyzed(documents(spark, sf_dir, 4)), False).select("term", "segment_id").distinct()
    return maintain.kmerge([rows], "term", "segment_id")


@query(f"{_postings(4)} SELECT DISTINCT term FROM p")
def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.distinct_terms(index.blocks(index.analyzed(documents(spark, sf_dir, 4)), False))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id % 16 AS segment_id, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT greatest(1, sum(n) // 4) AS most FROM s),
o AS (SELECT segment_id, n, row_number() OVER (ORDER BY segment_id) AS k FROM s, t WHERE n > 0 AND n < most),
r AS (
  SELECT k, segment_id, n AS total, 0 AS g FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.segment_id, CASE WHEN r.total >= t.most THEN o.n ELSE r.total + o.n END, CASE WHEN r.total >= t.most THEN r.g + 1 ELSE r.g END
  FROM r JOIN o ON o.k = r.k + 1, t),
c AS (SELECT g FROM r GROUP BY g HAVING count(*) > 1)
SELECT (dense_rank() OVER (ORDER BY g) - 1)::INTEGER AS "merge", segment_id::BIGINT AS segment_id FROM r JOIN c USING (g)"""
)
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.segment_stats(index.analyzed(documents(spark, sf_dir, 16))).select("segment_id", "num_docs").collect()
    total = sum(r.num_docs for r in stats)
    groups = maintain.pick_segments([tuple(r) for r in stats], max(1, total // 4))
    return spark.createDataFrame([(i, s) for i, g in enumerate(groups) for s in g], "merge int, segment_id bigint")


@query("SELECT g::INTEGER AS group_id, r::INTEGER AS replica_id, ['n0', 'n1', 'n2'][(CASE WHEN g < 3 THEN g ELSE 0 END + r) % 3 + 1] AS node, 'create' AS todo FROM range(5) a(g), range(2) b(r)")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.place_df(spark, 5, 2, ["n2", "n0", "n1"])


@query(
    """WITH s AS (SELECT doc_id % 8 AS seg, doc_id % 4 AS g, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT g::INTEGER AS group_id, sum(n)::BIGINT AS num_docs, count(*) AS n_segments,
       list('ctime=2020-01-02 03:04:05    id=' || rpad(seg::VARCHAR, 10, ' ') || 'num=' || n ORDER BY seg) AS lines FROM s GROUP BY 1"""
)
def shard_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.segment_stats(index.analyzed(documents(spark, sf_dir, 8, 4)))
    segments = stats.select("*", F.to_timestamp(F.lit("2020-01-02 03:04:05")).alias("create_time"), F.lit(1).alias("version"))
    return catalog.shard_info(segments.to(spark.createDataFrame([], SEGMENTS).schema)).drop("namespace")


@query(
    """SELECT 'INDEX' AS type, doc_id::VARCHAR AS id FROM documents
UNION ALL SELECT 'REMOVE', doc_id::VARCHAR FROM labels WHERE toxic = 1"""
)
def command_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), A.tokenize(F.col("text")).alias("tokens"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    log = files.index_commands(docs, 4).unionByName(files.remove_commands(gone, 4))
    sent = log.select(F.to_json(F.struct("type", "doc", "doc_id", "seq")).alias("value"))
    return files.parse_commands(sent).select("type", F.coalesce("doc.doc_id", "doc_id").alias("id"))


@query(f"""{_postings(4)} SELECT '{{"segment_id":' || segment_id || ',"doc_id":' || doc_id || ',"dl":' || len(t) || '}}' AS json FROM d""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.to_json_rows(index.doc_lengths(index.analyzed(documents(spark, sf_dir, 4))).select("segment_id", "doc_id", "dl"))


def _whole(hits: DataFrame) -> DataFrame:
    """A page of hits as a table of its own, so that the index it was read from can go."""
    found = _found(hits).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return hits.sparkSession.createDataFrame(found.collect(), found.schema)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), A.tokenize(F.col("text")).alias("tokens"))


def _streamed(spark: SparkSession, base: str, store) -> None:
    """What the log has now, and was not ingested before."""
    from lexisearch.streaming.ingest import ingest

    ingest(files.command_stream(spark, f"{base}/log"), store, "docs", f"{base}/state", trigger={"availableNow": True}).awaitTermination()


@query(_hits(tie="doc_id::VARCHAR"))
def stream_ingest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as commands through a file stream, indexed and searched."""
    from lexisearch.sources.storage import SegmentStore

    with shared.folder(spark) as base:
        files.append_commands(files.index_commands(_commands(spark, sf_dir), 1), f"{base}/log", "docs")
        store = SegmentStore(spark, f"{base}/index")
        _streamed(spark, base, store)
        return _whole(search.search(store.postings("docs"), QUERY.split()))


_TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"


@query(_hits(tie="doc_id::VARCHAR", source=f"(SELECT * FROM documents WHERE doc_id NOT IN ({_TOXIC}))"))
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended to the log, then removals, all taken in one batch."""
    from lexisearch.sources.storage import SegmentStore

    with shared.folder(spark) as base:
        gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
        files.append_commands(files.index_commands(_commands(spark, sf_dir), 1), f"{base}/log", "docs")
        files.append_commands(files.remove_commands(gone, 1), f"{base}/log", "docs")
        store = SegmentStore(spark, f"{base}/index")
        _streamed(spark, base, store)
        return _whole(search.search(store.postings("docs"), QUERY.split()))


@query(_hits(segments=4, where=f"doc_id NOT IN ({_TOXIC})", tie="doc_id::VARCHAR").replace("segment_id::BIGINT AS segment_id", "4::BIGINT AS segment_id"))
def search_remove_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segments, documents removed, everything merged: the removed stay away."""
    from lexisearch.sources.storage import SegmentStore

    with shared.folder(spark) as base:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("docs").alias("namespace"))
        store = SegmentStore(spark, f"{base}/index", index.IndexOptions(merge_num=1 << 40))
        for k in range(4):
            store.add(docs.where(F.pmod("doc_id", F.lit(4)) == k))
        store.remove("docs", table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
        store.compact()
        store.validate()
        return _whole(search.search(store.postings("docs"), QUERY.split()))


@query(_hits(segments=3, tie="doc_id::VARCHAR").replace("SELECT segment_id::BIGINT AS segment_id", "SELECT (CASE WHEN segment_id = 2 THEN 3 ELSE 2 END)::BIGINT AS segment_id"))
def stream_compact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, a merge of their segments, a third batch: all documents are there."""
    from lexisearch.sources.storage import SegmentStore

    with shared.folder(spark) as base:
        docs = _commands(spark, sf_dir)
        store = SegmentStore(spark, f"{base}/index", index.IndexOptions(merge_num=1 << 40))
        for k in range(3):
            files.append_commands(files.index_commands(docs.where(F.pmod(F.col("doc_id").cast("bigint"), F.lit(3)) == k), 1), f"{base}/log", "docs")
            _streamed(spark, base, store)
            if k == 1:
                store.compact()
        return _whole(search.search(store.postings("docs"), QUERY.split()))
