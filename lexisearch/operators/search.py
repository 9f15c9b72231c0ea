"""Disjunctive top-k search over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisearch.errors import ShardNotFound
from lexisearch.functions.analysis import tokenize
from lexisearch.operators.index import build_postings

#: Digits of a score that count for the order: sums come out alike however they were partitioned.
DIGITS = 9
#: Query terms up to so many rows are broadcast to the postings; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Pairs of a query and a document that a task has at most, where the number of documents is known.
PAIRS = 1_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n): a token given twice counts twice."""
    return queries.select("query_id", F.explode("tokens").alias("term")).where("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("n"))


def score(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, segment_id, doc_id, bm25_score) of every document with any of a query's
    tokens, segment by segment; ``queries`` has query_id and tokens."""
    return score_terms(query_terms(queries), postings)


def _known(dedup: str, score_type: str) -> None:
    if dedup not in ("none", "latest") or score_type not in ("double", "float"):
        raise ValueError("dedup is 'none' or 'latest', score_type 'double' or 'float'")


def _total(n: Column, score_type: str) -> Column:
    """The sum of a document's impacts; single precision rounds each of them, and the sum."""
    each = F.col("bm25") if score_type == "double" else F.col("bm25").cast("float").cast("double")
    return F.sum(n * each).cast(score_type).alias("bm25_score")


def score_terms(terms: DataFrame, postings: DataFrame, score_type: str = "double") -> DataFrame:
    if "group_id" not in postings.columns:
        postings = postings.withColumn("group_id", F.lit(0))
    hits = postings.join(terms, "term")
    return hits.groupBy("query_id", "group_id", "segment_id", "doc_id").agg(_total(F.col("n"), score_type))


def _best() -> Column:
    return F.round("bm25_score", DIGITS).desc()


def top(hits: DataFrame, count: int, start: int = 0) -> DataFrame:
    """Each query's hits of rank start+1 to start+count, with the rank; of equal scores the lower id first."""
    if start < 0 or count < 0:
        raise ValueError("start and count cannot be negative")
    order = Window.partitionBy("query_id").orderBy(_best(), "doc_id", "group_id", "segment_id")
    return hits.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= start + count) & (F.col("rank") > start))


def page(hits: DataFrame, count: int, start: int = 0) -> DataFrame:
    """The same for a single query, without a window."""
    if start < 0 or count < 0:
        raise ValueError("start and count cannot be negative")
    return hits.orderBy(_best(), "doc_id", "group_id", "segment_id").offset(start).limit(count)


def search(postings: DataFrame, tokens: list[str], count: int = 10, start: int = 0, groups: list[int] | None = None, rerank=None, dedup: str = "none", score_type: str = "double") -> DataFrame:
    """(segment_id, doc_id, bm25_score) of one query's page.

    ``groups`` searches some shard groups only. ``rerank`` maps hits to hits before
    the final order, which is by ``bm25_score``. ``dedup`` 'latest' keeps of a document that
    several segments hold only the newest one's hit. ``score_type`` 'float' adds up single-precision
    impacts. The terms go to the scan as a filter.
    """
    _known(dedup, score_type)
    counts: dict[str, int] = {}
    for t in tokens:
        if t:
            counts[t] = counts.get(t, 0) + 1
    if groups is not None:
        postings = postings.where(F.col("group_id").isin(groups))
    n = F.lit(0)
    for t, k in counts.items():
        n = F.when(F.col("term") == t, k).otherwise(n)
    hits = postings.where(F.col("term").isin(list(counts))).groupBy("group_id", "segment_id", "doc_id").agg(_total(n, score_type))
    if dedup == "latest":
        hits = latest(hits.withColumn("query_id", F.lit(0))).drop("query_id")
    hits = hits if rerank is None else rerank(hits)
    return page(hits, count, start).select("segment_id", "doc_id", "bm25_score")


def search_shard(postings: DataFrame, group: int, tokens: list[str], count: int = 10, start: int = 0, groups: int | None = None) -> DataFrame:
    """One shard's hits, per segment at most start+count of them and not ordered across segments."""
    if group < 0 or groups is not None and group >= groups:
        raise ShardNotFound(f"no group {group}")
    mine = postings.where(F.col("group_id") == group)
    spark = postings.sparkSession
    terms = query_terms(spark.createDataFrame([(0, tokens)], "query_id bigint, tokens array<string>"))
    order = Window.partitionBy("segment_id").orderBy(_best(), "doc_id")
    hits = score_terms(F.broadcast(terms), mine).withColumn("rank", F.row_number().over(order))
    return hits.where((F.col("rank") > start) & (F.col("rank") <= start + count)).select("segment_id", "doc_id", "bm25_score")


def search_batch(postings: DataFrame, queries: DataFrame, count: int = 10, start: int = 0, rerank=None, dedup: str = "none", score_type: str = "double", documents: int | None = None) -> DataFrame:
    """(query_id, rank, segment_id, doc_id, bm25_score) for a table of queries with query_id
    and tokens. The queries' terms are broadcast only if they are counted to be few. Then, with the
    number of ``documents`` in the index given, postings are dealt out by document to as many tasks
    as keep each one's scores under ``PAIRS``, however many documents there are."""
    _known(dedup, score_type)
    terms = query_terms(queries)
    small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small and documents is not None:
        if "group_id" not in postings.columns:
            postings = postings.withColumn("group_id", F.lit(0))
        tasks = max(-(-documents * queries.count() // PAIRS), postings.sparkSession.sparkContext.defaultParallelism)
        postings = postings.select("group_id", "segment_id", "doc_id", "term", "bm25").repartition(tasks, "group_id", "segment_id", "doc_id")
    hits = score_terms(F.broadcast(terms) if small else terms, postings, score_type)
    hits = latest(hits) if dedup == "latest" else hits
    hits = hits if rerank is None else rerank(hits)
    return top(hits, count, start).select("query_id", "rank", "segment_id", "doc_id", "bm25_score")


def latest(hits: DataFrame) -> DataFrame:
    """Of a document found in several segments only the newest one's hit."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("segment_id"))
    return hits.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def search_documents(docs: DataFrame, query: str, count: int = 10, start: int = 0, text_col: str = "text", id_col: str = "doc_id", groups: list[int] | None = None) -> DataFrame:
    """One query over documents that are not indexed: only its terms are exploded and shuffled."""
    # A projection of a literal table is evaluated while planning: no job.
    tokens = docs.sparkSession.sql("SELECT * FROM VALUES (0) AS one(x)").select(tokenize(F.lit(query)).alias("t")).collect()[0][0]
    return search(build_postings(docs, text_col, id_col, sorted(set(tokens))), tokens, count, start, groups)


def with_content(hits: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Hits joined back to the documents' text; hits are few and bounded by their count."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content")).join(hits, "doc_id")
