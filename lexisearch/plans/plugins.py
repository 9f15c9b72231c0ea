"""Query analysis and reranking by plugins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisearch.errors import NoQuery, PluginError
from lexisearch.functions.analysis import PUNCTUATION, normalize, tokenize
from lexisearch.functions.scalar import top_indices


@dataclass
class Plugin:
    """``analyze`` maps a table of queries (query_id, raw, tokens, tags) to one; ``rerank`` maps hits to hits."""

    name: str
    priority: int = 0

    def analyze(self, queries: DataFrame) -> DataFrame:
        return queries

    def rerank(self, hits: DataFrame) -> DataFrame:
        return hits

    def cleanup(self) -> None:
        pass


@dataclass
class Preprocessor(Plugin):
    name: str = "preprocessor"
    priority: int = 1
    stopwords: str = PUNCTUATION
    chinese: bool = True

    def analyze(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("raw", normalize(F.col("raw"), self.stopwords, self.chinese))


@dataclass
class Segmenter(Plugin):
    """Adds the tokens of ``raw`` behind those a query already has."""

    name: str = "segmenter"
    priority: int = 2
    cut: Callable[[Column], Column] = tokenize

    def analyze(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("tokens", F.concat(F.coalesce("tokens", F.array().cast("array<string>")), self.cut(F.col("raw"))))


@dataclass
class Classifier(Plugin):
    """Adds the ``k`` likeliest tags. ``score`` maps a batch of (texts, length, width) embeddings
    to class scores; ``embeddings`` a character to its vector, with 'U' for the unknown and
    'P' behind the end."""

    name: str = "classifier"
    priority: int = 3
    tags: list[str] = field(default_factory=list)
    embeddings: dict[str, np.ndarray] = field(default_factory=dict)
    score: Callable[[np.ndarray], np.ndarray] | None = None
    length: int = 197
    k: int = 5

    def embed(self, texts: list[str]) -> np.ndarray:
        """(texts, length, width): code points looked up in a sorted table, all at once."""
        points = np.array(sorted(map(ord, self.embeddings)), np.uint32)
        vectors = np.stack([self.embeddings[chr(p)] for p in points])
        cut = [t[: self.length] for t in texts]
        found = np.frombuffer("".join(t + "P" * (self.length - len(t)) for t in cut).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, self.length)
        at = np.minimum(np.searchsorted(points, found), len(points) - 1)
        return vectors[np.where(points[at] == found, at, np.searchsorted(points, ord("U")))]

    def analyze(self, queries: DataFrame) -> DataFrame:
        if self.score is None:
            return queries
        embed, score = self.embed, self.score

        @F.pandas_udf("array<float>")
        def classes(raw: pd.Series) -> pd.Series:
            return pd.Series(list(score(embed([r or "" for r in raw])).astype(np.float32))) if len(raw) else pd.Series([], dtype=object)

        names = F.array(*map(F.lit, self.tags))
        found = F.transform(top_indices(F.col("_scores"), self.k), lambda i: F.element_at(names, i + 1))
        return queries.withColumn("_scores", classes("raw")).withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), found)).drop("_scores")


class Registry:
    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise PluginError(f"{plugin.name} is registered already")
        self.plugins[plugin.name] = plugin

    def get(self, name: str) -> Plugin:
        if name not in self.plugins:
            raise PluginError(f"no plugin {name}")
        return self.plugins[name]

    def ordered(self) -> list[Plugin]:
        return sorted(self.plugins.values(), key=lambda p: p.priority)

    def analyze(self, queries: DataFrame, check: bool = True) -> DataFrame:
        """Every plugin's analysis, by priority, of all queries; at least one is needed."""
        if check and queries.isEmpty():
            raise NoQuery("there is no query")
        for p in self.ordered():
            queries = p.analyze(queries)
        return queries

    def rerank(self, hits: DataFrame) -> DataFrame:
        for p in self.ordered():
            hits = p.rerank(hits)
        return hits

    def cleanup(self) -> None:
        for p in reversed(self.ordered()):
            p.cleanup()


def standard(names: tuple[str, ...] = ("preprocessor", "segmenter"), **given: Plugin) -> Registry:
    """A registry of built-in plugins, or of those given by name; unknown names are errors."""
    known = {"preprocessor": Preprocessor, "segmenter": Segmenter, "classifier": Classifier}
    out = Registry()
    for n in names:
        if n not in known and n not in given:
            raise PluginError(f"no plugin {n}")
        out.register(given.get(n) or known[n]())
    return out
