"""Language-model scores from a hidden Markov model trained on the corpus itself.

Symbols are the words whose share of all the corpus's words reaches ``MIN_SHARE``
(so there are at most ``1 / MIN_SHARE``, however large the corpus) and, for the rest,
classes by length, digits and non-ASCII letters. A line is a sequence; a document's
likelihood is the product of its lines'.

A word in a class has its own chance there: its count in the whole corpus less
``DISCOUNT``, and what is taken from all words of the class goes to spellings, byte by
byte (letter, digit or wider), so that the chances of all words sum to one. These counts are a table that
grows with the corpus and is never gathered; it is joined to the words by a shuffle. As
a word's chance in its class does not depend on the state, it is no part of training.

Training is Baum-Welch: in each iteration every task runs the scaled forward and
backward recursions over all its lines and sends its expected counts; the counts are
summed in parallel by slices, and the new parameters have a fixed size. Every
iteration is over the whole corpus, and they go on until the gain is small. From chance
values the states would stay alike for many iterations; so symbols are first
clustered by what stands before and after them in the whole corpus, and each state begins
with one cluster. Scoring is one more forward recursion, which gives the exact
likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import id_text, load, materialize, release
from lexisearch.llm._text import flat, pieces, word_spans, words

STATES = 8
#: Training ends when an iteration gains less than this a word, in nats.
LEAST_GAIN = 0.005
#: It ends after so many iterations at the latest.
ITERATIONS = 60
#: Taken from each rare word's count, for words by their spelling.
DISCOUNT = 0.75
#: Length of the random vectors by which contexts are told apart.
CONTEXT = 12
MIN_SHARE = 2e-5
SMOOTHING = 0.1
SEED = 20
_LENGTHS = np.array([4, 7, 10, 15])
CLASSES = (len(_LENGTHS) + 1) * 4
#: Words of whole documents that are laid out at once.
TOGETHER = 1 << 21
#: Words whose recursions run side by side, lines of about one length: what fits a cache.
BLOCK = 1 << 18
_SLICE = 1 << 13


@dataclass(frozen=True)
class Model:
    """``vocabulary`` holds sorted word hashes; symbol i is its i-th word, and the classes follow."""

    vocabulary: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: tuple[float, ...] = ()


def _inside(mask: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes of each word are marked."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[start + size] - total[start]


def word_classes(size: np.ndarray, digits: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The class of each word if it is rare, by its bytes, and how many are digits or wider characters'."""
    return 4 * np.searchsorted(_LENGTHS, size, "right") + (digits > 0) + 2 * (wide > 0)


def word_counts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word, n, size, digits, wide) of every distinct word of ``docs``, written: how often it
    occurs, its bytes, and how many of these are digits and wider characters'; and over all
    occurrences: letters, digits, wider characters' bytes, words.
    """
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("digits", pa.int32()), ("wide", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                low = pc.utf8_lower(part.column(0))
                data, _ = flat(low)
                h, _, start, size = word_spans(low)
                if len(h):
                    key, at, n = np.unique(h, return_index=True, return_counts=True)
                    start, size = start[at], size[at]
                    digits, wide = (_inside(x, start, size) for x in ((data >= 48) & (data <= 57), data >= 128))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), *(pa.array(x.astype(np.int32)) for x in (size, digits, wide))], schema=schema)

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint, size int, digits int, wide int")
    table = materialize(rows.groupBy("word").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("size", "digits", "wide"))))
    of = lambda c: F.coalesce(F.sum(F.expr(f"n * ({c})")), F.lit(0))
    return table, np.array(table.agg(of("size - digits - wide"), of("digits"), of("wide"), of("1")).first(), np.int64)


def vocabulary(counts: DataFrame, total: int, min_share: float = MIN_SHARE) -> np.ndarray:
    """Sorted hashes of the words with at least this share of all words: at most ``1 / min_share``."""
    often = counts.where(F.col("n") >= min_share * total).select("word").toPandas()["word"].to_numpy(np.int64)
    return np.sort(often.view(np.uint64))


def spelled(letters: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(log chance of a certain letter, digit, wider byte; of a word's end; of each class) of the spelling model.

    Bytes follow each other independently, and those of a kind are alike; the classes'
    chances are exact sums over lengths.
    """
    total = int(letters[:3].sum())
    stop = (letters[3] + 1) / (total + letters[3] + 2)
    kind = (letters[:3] + 1) / (total + 3)
    digit, wide = kind[1], kind[2]
    length = np.arange(1, 20_000, dtype=float)
    last = np.searchsorted(_LENGTHS, length, "right")
    with np.errstate(under="ignore"):
        plain, with_digit, with_wide = (1 - digit - wide) ** length, (1 - wide) ** length, (1 - digit) ** length
        each = (1 - stop) ** length * stop
        of = [plain, with_digit - plain, with_wide - plain, 1 - with_digit - with_wide + plain]
        chance = np.array([(each * of[c % 4])[last == c // 4].sum() for c in range(CLASSES)])
    return np.log(kind / (26, 10, 128) * (1 - stop)), float(np.log(stop)), np.log(np.maximum(chance, 1e-300))


def rare_chances(counts: DataFrame, letters: np.ndarray, often: float) -> DataFrame:
    """(word, chance): the log of each rare word's chance in its class; a table as long as the words are many."""
    kind = sum((F.col("size") >= int(x)).cast("int") for x in _LENGTHS) * 4 + (F.col("digits") > 0).cast("int") + 2 * (F.col("wide") > 0).cast("int")
    rare = counts.where(F.col("n") < often).withColumn("class", kind)
    known = {r["class"]: (r.c, r.v) for r in rare.groupBy("class").agg(F.sum("n").alias("c"), F.count("*").alias("v")).collect()}
    log_q, log_stop, log_class = (np.asarray(x).tolist() for x in spelled(letters))
    table = [[float(known.get(k, (1, 1))[0]), float(known.get(k, (1, 1))[1]), log_class[k]] for k in range(CLASSES)]
    c, v, whole = (F.element_at(F.array(*(F.lit(row[i]) for row in table)), F.col("class") + 1) for i in range(3))
    base = log_q[0] * (F.col("size") - F.col("digits") - F.col("wide")) + log_q[1] * F.col("digits") + log_q[2] * F.col("wide") + log_stop - whole
    chance = F.log((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * v * F.exp(F.least(base, F.lit(0.0)))) / c)
    return rare.select("word", chance.cast("float").alias("chance"))


def symbols(arr: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each word, index of each line's first word, index of each text's first word,
    and of its first line), each with the total at the end, and the words' hashes; lines without
    a word are left out."""
    low = pc.utf8_lower(arr)
    data, _ = flat(low)
    h, first, start, size = word_spans(low)
    out = np.searchsorted(vocab, h) if len(vocab) else np.zeros(len(h), np.int64)
    known = vocab[np.minimum(out, len(vocab) - 1)] == h if len(vocab) else np.zeros(len(h), bool)
    rare = np.flatnonzero(~known)
    digits, wide = (_inside(x, start[rare], size[rare]) for x in ((data >= 48) & (data <= 57), data >= 128))
    out[rare] = len(vocab) + word_classes(size[rare], digits, wide)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    new = np.zeros(len(h), bool)
    new[1:] = line[1:] != line[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    heads = np.flatnonzero(new)
    return out, np.append(heads, len(h)), first, np.searchsorted(heads, first), h


ENCODED = "doc_id bigint, lines binary, symbols binary, rare binary"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("lines", pa.binary()), ("symbols", pa.binary()), ("rare", pa.binary())])


def encoded(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """Each text as the lengths of its lines and its symbols, 32-bit integers, and its rare words' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s, heads, first, lines, h = symbols(part.column(1), shared.value)
                s, n = s.astype("<i4"), np.diff(heads).astype("<i4")
                rows = range(part.num_rows)
                unknown = s >= len(shared.value)
                rare, at = h[unknown].astype("<u8"), np.concatenate([[0], np.cumsum(unknown)])[first]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()) for x, cut in ((n, lines), (s, first), (rare, at)))], schema=_ENCODED
                )

    return docs.mapInArrow(run, ENCODED)


class Lattice:
    """Sequences laid side by side, step by step, longest first."""

    def __init__(self, symbol: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        n = length[order]
        start = (np.cumsum(length) - length)[order]
        self.order = order
        self.alive = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # sequences longer than each step
        self.base = np.concatenate([[0], np.cumsum(self.alive)])
        step = np.repeat(np.arange(len(self.alive)), self.alive)
        rank = np.arange(len(symbol)) - self.base[step]
        self.seen = symbol[start[rank] + step]

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled alphas, scales, chances of what is seen); a row for each state, columns step by step."""
        chance = m.emit.take(self.seen, axis=1)
        alpha, scale = np.empty_like(chance), np.empty(len(self.seen))
        into = np.ascontiguousarray(m.move.T)
        a = None
        for at, n in zip(self.base.tolist(), self.alive.tolist()):
            now = alpha[:, at : at + n]
            if a is None:
                now[:] = m.start[:, None]
            else:
                np.matmul(into, a[:, :n], out=now)
            now *= chance[:, at : at + n]
            now /= np.add.reduce(now, axis=0, out=scale[at : at + n])
            a = now
        return alpha, scale, chance

    def likelihood(self, scale: np.ndarray) -> np.ndarray:
        """Log-likelihood of each sequence, in the order given."""
        logs, out = np.log(scale), np.zeros(len(self.order))
        for t, n in enumerate(self.alive):
            out[:n] += logs[self.base[t] : self.base[t] + n]
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves and emissions, and the log-likelihood."""
        alpha, scale, chance = self.forward(m)
        chance /= scale
        moves = np.zeros_like(m.move)
        after = None
        for at, n in zip(self.base[-2::-1].tolist(), self.alive[::-1].tolist()):
            now, ahead = alpha[:, at : at + n], chance[:, at : at + n]
            if after is not None:
                k = after.shape[1]
                moves += now[:, :k] @ after.T
                beta = m.move @ after
                now[:, :k] *= beta
                ahead[:, :k] *= beta
            after = ahead
        emits = np.stack([np.bincount(self.seen, a, m.emit.shape[1]) for a in alpha])
        first = alpha[:, : self.alive[0]].sum(axis=1) if len(self.alive) else np.zeros(len(m.start))
        return first, moves * m.move, emits, float(np.log(scale).sum())


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, lengths, owner row of each line) of whole documents, ``TOGETHER`` words at a time."""
    sizes = pc.binary_length(batch.column("symbols")).to_numpy() // 4
    ends = np.cumsum(sizes)
    at = base = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + TOGETHER, "right")))
        part = batch.slice(at, to - at)
        lines = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column("lines")]
        symbol = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in part.column("symbols")])
        yield symbol, np.concatenate(lines).astype(np.int64), np.repeat(np.arange(at, to), [len(x) for x in lines])
        at, base = to, int(ends[to - 1])


def blocks(symbol: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    """All sequences, longest first, about ``BLOCK`` words at a time: (their places, their lattice)."""
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    ends = np.cumsum(length[order])
    at = base = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        mine = order[at:to]
        n = length[mine]
        yield mine, Lattice(symbol[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
        at, base = to, int(ends[to - 1])


def _summed(table: DataFrame, size: int, counts: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum over all rows of arrays of a fixed size, added up by slices in parallel."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for more in counts(batch):
                total += more
        if total.any():
            parts = range(0, size, _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([s // _SLICE for s in parts], pa.int32()), pa.array([total[s : s + _SLICE].tobytes() for s in parts], pa.binary())], ["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": group["slice"][:1], "counts": [sum(np.frombuffer(x) for x in group["counts"]).tobytes()]})

    kind = "slice int, counts binary"
    rows = dict(table.mapInArrow(count, kind).groupBy("slice").applyInPandas(add, kind).collect())
    return np.concatenate([np.frombuffer(rows[i]) for i in sorted(rows)]) if rows else np.zeros(size)


def contexts(symbol: np.ndarray, length: np.ndarray, n: int, signs: np.ndarray) -> np.ndarray:
    """Occurrences of each symbol, and the sums of its neighbours' vectors: one row for the
    count, ``CONTEXT`` for those before and as many for those after."""
    out = np.zeros((1 + 2 * CONTEXT, n))
    out[0] = np.bincount(symbol, minlength=n)
    inside = np.ones(len(symbol), bool)
    inside[(np.cumsum(length) - length)[length > 0]] = False
    now = np.flatnonzero(inside)
    a, b = symbol[now - 1], symbol[now]
    for k in range(CONTEXT):
        out[1 + k] = np.bincount(b, signs[k][a], n)
        out[1 + CONTEXT + k] = np.bincount(a, signs[k][b], n)
    return out


def clustered(found: np.ndarray, states: int, rounds: int = 20, tries: int = 8) -> np.ndarray:
    """A cluster for each symbol, by :func:`contexts`: k-means of mean neighbours, weighed by occurrences, the best of some tries."""
    weight = found[0]
    x = (found[1:] / np.maximum(weight, 1)).T
    x -= (weight @ x) / max(weight.sum(), 1)
    # Few occurrences say little about a symbol's neighbours.
    x *= (weight / (weight + 20.0))[:, None]
    rng = np.random.default_rng(SEED)
    best: tuple[float, np.ndarray] = (np.inf, np.zeros(len(x), np.int64))
    share = weight / weight.sum() if weight.any() else np.full(len(x), 1 / len(x))
    for _ in range(tries):
        c = x[[rng.choice(len(x), p=share)]]
        while len(c) < states:  # the next centre by its distance from those there are
            gap = share * ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=gap / gap.sum() if gap.any() else share)]])
        for _ in range(rounds):
            far = (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T
            mine = far.argmin(axis=1)
            size = np.bincount(mine, share, states)
            new = np.stack([np.bincount(mine, share * x[:, d], states) for d in range(x.shape[1])], axis=1) / np.maximum(size, 1e-12)[:, None]
            new[size == 0] = c[size == 0]
            if np.allclose(new, c):
                break
            c = new
        if (cost := float(share @ far.min(axis=1))) < best[0]:
            best = cost, mine
    return best[1]


#: Of a symbol's first chance this much is in its own cluster's state.
OWN = 0.8


def initial(vocab: np.ndarray, found: np.ndarray, states: int = STATES) -> Model:
    """Each state begins with one cluster's symbols, and a little of all others."""
    mine, weight = clustered(found, states), found[0] + SMOOTHING
    emit = np.full((states, len(weight)), (1 - OWN) / max(states - 1, 1)) * weight
    emit[mine, np.arange(len(weight))] = OWN * weight
    flat_start = np.full(states, 1 / states)
    return Model(vocab, flat_start, np.full((states, states), 1 / states), emit / emit.sum(axis=1, keepdims=True))


def first_model(table: DataFrame, vocab: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    n = len(vocab) + CLASSES
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (CONTEXT, n))
    shared = table.sparkSession.sparkContext.broadcast(signs)

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for symbol, length, _ in _sequences(batch):
            yield contexts(symbol, length, n, shared.value).ravel()

    return initial(vocab, _summed(table, (1 + 2 * CONTEXT) * n, count).reshape(-1, n), states)


def maximized(m: Model, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, ll: float) -> Model:
    """The parameters that expected counts give, with ``SMOOTHING`` added to each count."""
    first, moves, emits = first + SMOOTHING, moves + SMOOTHING, emits + SMOOTHING
    return Model(m.vocabulary, first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True), (*m.log_likelihood, ll))


def iterate(table: DataFrame, m: Model) -> Model:
    """One Baum-Welch iteration over all of an :func:`encoded` table."""
    shared = table.sparkSession.sparkContext.broadcast((m.start, m.move, m.emit))
    k, n = m.emit.shape

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        mine = Model(np.empty(0), *shared.value)
        for symbol, length, _ in _sequences(batch):
            for _, lattice in blocks(symbol, length):
                first, moves, emits, ll = lattice.expected(mine)
                yield np.concatenate([first, moves.ravel(), emits.ravel(), [ll]])

    total = _summed(table, k + k * k + k * n + 1, count)
    shared.unpersist()
    return maximized(m, total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(k, n), float(total[-1]))


def train(table: DataFrame, vocab: np.ndarray, words: int, states: int = STATES, iterations: int = ITERATIONS, least_gain: float = LEAST_GAIN) -> Model:
    """Baum-Welch until a word gains less than ``least_gain``."""
    m = first_model(table, vocab, states)
    while len(m.log_likelihood) < iterations:
        m = iterate(table, m)
        done = m.log_likelihood
        if len(done) > 1 and done[-1] - done[-2] < least_gain * max(words, 1):
            break
    return m


SCORED = "uid bigint, doc_id bigint, n_words bigint, n_lines bigint, ll double"
_SCORED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_lines", pa.int64()), ("ll", pa.float64())])


def scored(table: DataFrame, m: Model) -> DataFrame:
    """(uid, doc_id, n_words, n_lines, ll): the likelihood of each text's symbols."""
    shared = table.sparkSession.sparkContext.broadcast((m.start, m.move, m.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(np.empty(0), *shared.value)
        for batch in batches:
            ll, n, lines = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for symbol, length, owner in _sequences(batch):
                got = np.empty(len(length))
                for places, lattice in blocks(symbol, length):
                    got[places] = lattice.likelihood(lattice.forward(mine)[1])
                ll += np.bincount(owner, got, batch.num_rows)
                n += np.bincount(owner, length, batch.num_rows)
                lines += np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(lines.astype(np.int64)), pa.array(ll)], schema=_SCORED)

    return table.select("uid", "doc_id", "lines", "symbols").mapInArrow(run, SCORED)


def rare_words(table: DataFrame) -> DataFrame:
    """(uid, word): each occurrence of a rare word."""
    schema = pa.schema([("uid", pa.int64()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy() // 8
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(found)], schema=schema)

    return table.select("uid", "rare").mapInArrow(run, "uid bigint, word bigint")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS, min_share: float = MIN_SHARE, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(doc_id, n_words, n_lines, log_likelihood, perplexity) of every row, under the model
    trained on all rows.

    Natural logarithm; perplexity is by word. Null and empty texts, and texts without a
    word, have likelihood 1 (logarithm 0) and null perplexity. Texts may be of any length.
    Repeated rows all count in
    training and each get a row; null ids stay null; other columns are ignored; an empty
    table gives an empty result.
    """
    docs = id_text(docs, id_col, text_col)
    counts, letters = word_counts(docs)
    total = int(letters[3])
    vocab = vocabulary(counts, total, min_share)
    table = materialize(encoded(docs, vocab).withColumn("uid", F.monotonically_increasing_id()))
    m = train(table.select("lines", "symbols"), vocab, total, states, iterations, least_gain)
    # Words under a share of 1 in 1 / min_share are in no hot partition.
    chance = rare_chances(counts, letters, min_share * total)
    rare = rare_words(table).join(chance, "word").groupBy("uid").agg(F.sum(F.col("chance").cast("double")).alias("rare"))
    whole = scored(table, m).join(rare, "uid", "left").withColumn("log_likelihood", F.col("ll") + F.coalesce("rare", F.lit(0.0)))
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words")))
    out = materialize(whole.select("doc_id", "n_words", "n_lines", "log_likelihood", perplexity.alias("perplexity")))
    release(table, counts)
    return out


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
