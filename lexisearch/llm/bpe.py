"""Byte-pair encoding by depth-first traversal of a trie.

The encoding of a string ends in one certain token, and what precedes that token is
the encoding of the shorter string. So a trie node needs one state, the last token
of its prefix; a prefix that many words share is encoded once. Sorted distinct words
are the trie in depth-first order: the path kept from one word to the next is their
common prefix, and only nodes below it are new.

A token may follow another if byte-pair merging of the two together gives back just
these two. That test undoes merges and is remembered for each pair of tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexisearch.llm._spark import id_text, load
from lexisearch.llm._text import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a task remembers before it forgets them all.
REMEMBER = 1 << 19


def contents(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


class Encoder:
    """Encodes and decodes with the merge ranks of a vocabulary file."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY, pattern: str = PATTERN):
        """``vocabulary`` is a file's path, or what it holds."""
        self.rank = ranks(vocabulary if isinstance(vocabulary, bytes) else contents(vocabulary))
        self.bytes_of = {v: k for k, v in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary needs a token for each byte")
        self.split = regex.compile(pattern)
        self.pieces = self._undo()
        self.fits: dict[tuple[int, int], bool] = {}
        self.first: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self._automaton()

    def _automaton(self) -> None:
        """A state for each prefix of a token: ``step`` by byte, ``back`` to the longest proper
        suffix that is a state, ``ends`` the longest token that is a suffix, if any. ``shorter`` has the
        next shorter suffix token of each token, and ``size`` tokens' lengths."""
        self.step: dict[int, int] = {}
        self.back, self.ends = [0], [-1]
        own = [-1]
        for token, me in self.rank.items():
            state = 0
            for byte in token:
                new = self.step.get(state << 8 | byte)
                if new is None:
                    new = self.step[state << 8 | byte] = len(self.back)
                    self.back.append(0)
                    self.ends.append(-1)
                    own.append(-1)
                state = new
            own[state] = me
        self.size = [0] * (max(self.bytes_of) + 1)
        self.shorter = [-1] * len(self.size)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, to in children.get(state, ()):
                    if state:
                        at = self.back[state]
                        while (found := self.step.get(at << 8 | byte)) is None and at:
                            at = self.back[at]
                        self.back[to] = found or 0
                    me, rest = own[to], self.ends[self.back[to]]
                    self.ends[to] = rest if me < 0 else me
                    if me >= 0:
                        self.shorter[me], self.size[me] = rest, len(self.bytes_of[me])
                    below.append(to)
            level = below

    def _undo(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes a token; a single byte is its own."""
        out = {}
        for token, me in self.rank.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 60), i))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            out[me] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (me, me)
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly these two tokens."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        rank, text, undo = self.rank, self.bytes_of, self.pieces
        limit = 1 << 60  # a merge across the border happens first if its rank is lower
        while True:
            across = rank.get(text[left] + text[right])
            if across is not None and across < limit and undo[across] == (left, right):
                return False
            # Go back to before the later merge. On the right of the border one of
            # equal rank comes after the merge across, which lies further left.
            whole = [undo[left][1] == left, undo[right][0] == right]
            if all(whole):
                return True
            if whole[1] or not whole[0] and left > right:
                limit, left = left, undo[left][1]
            else:
                limit, right = right + 1, undo[right][0]

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of each word; the words sorted, without repeats or empty ones."""
        step, known, follow, number = self.step.get, self.fits.get, self.may_follow, int.from_bytes
        back, ends, shorter, size = self.back, self.ends, self.shorter, self.size
        states, last = [0], [0]  # automaton state and last token of each prefix on the path, by its length
        before = b""
        for word in words:
            n = min(len(before), len(word))
            shared = n - ((number(before[:n], "big") ^ number(word[:n], "big")).bit_length() + 7) // 8
            del states[shared + 1 :], last[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:]:
                end += 1
                to = step(state << 8 | byte)
                while to is None:
                    state = back[state]
                    to = step(state << 8 | byte)
                state = to
                token = ends[state]
                while (length := size[token]) < end:
                    left = last[end - length]
                    ok = known((left, token))
                    if follow(left, token) if ok is None else ok:
                        break
                    token = shorter[token]
                states.append(state)
                last.append(token)
            before, ids, at = word, [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            yield ids

    def _parts(self, word: str, space: str) -> list[bytes]:
        """The pre-tokens of a word; all letters, or letters and one mark, need no expression."""
        if word.isalpha():
            return [(space + word).encode()]
        if word[:-1].isalpha() and word[-1] in ".,;:!?)":
            return [(space + word[:-1]).encode(), word[-1].encode()]
        return [p.encode() for p in self.split.findall(space + word)]

    def _learn(self, found: set[str], space: str, memory: dict[str, bytes]) -> None:
        new = [w for w in found if w not in memory]
        split = {w: self._parts(w, space) for w in new}
        parts = sorted(set(chain.from_iterable(split.values())))
        ids = {p: pack("<%di" % len(t), *t) for p, t in zip(parts, self.encode_sorted(parts), strict=True)}
        for w, p in split.items():
            memory[w] = b"".join([ids[x] for x in p])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        A text is taken apart at single spaces between other characters, where
        every pre-token ends; texts with other runs of white space, whose
        pre-tokens can reach over a space, are taken as they are.
        """
        cut = [t.split(" ") for t in texts]
        words = set(chain.from_iterable(cut))
        if odd := {w for w in words if not w or w[0].isspace() or w[-1].isspace()}:
            cut = [[t] if not odd.isdisjoint(c) else c for t, c in zip(texts, cut, strict=True)]
        heads = {c[0] for c in cut}
        tails = set(chain.from_iterable(c[1:] for c in cut))
        if len(self.first) + len(self.after_space) > REMEMBER:
            self.first.clear()
            self.after_space.clear()
        self._learn(heads, "", self.first)
        self._learn(tails, " ", self.after_space)
        first, rest = self.first, self.after_space
        return [b"".join([first[c[0]], *map(rest.__getitem__, c[1:])]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as by :meth:`encode_all`."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))


@lru_cache(2)
def encoder(vocabulary: bytes, pattern: str = PATTERN) -> Encoder:
    """One encoder a worker process."""
    return Encoder(vocabulary, pattern)


ENCODED = "doc_id bigint, n_tokens int, token_ids array<int>, decoded_equal boolean"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("decoded_equal", pa.bool_())])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_equal): the ids of each whole text, and
    whether decoding them gives the text's bytes again.

    The vocabulary is a file of the driver's, of fixed size, that is broadcast.
    A narrow pass; each task keeps its own trie of distinct words, so nothing is
    shuffled. Null text gives null in all but ``doc_id``; empty text no tokens.
    Repeated rows each give a row; a null id stays null; other columns are ignored;
    an empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(contents(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1).to_pylist()
                ids = enc.encode_all([t or "" for t in texts])
                null = np.array([t is None for t in texts])
                same = [t is not None and enc.decode(i) == t.encode() for t, i in zip(texts, ids, strict=True)]
                size = np.array([len(i) // 4 for i in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, mask=null), lists, pa.array(same, mask=null)], schema=_ENCODED)

    return id_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ids_col: str = "token_ids", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of ids as :func:`encode` gives them; null ids give null text.

    Ids cut in the middle of a character give U+FFFD there; an id that is not in the
    vocabulary is an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    shared = encoded.sparkSession.sparkContext.broadcast(contents(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(np.array(x, "<i4").tobytes()).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    from pyspark.sql import functions as F

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("token_ids")).mapInArrow(run, "doc_id bigint, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"))
