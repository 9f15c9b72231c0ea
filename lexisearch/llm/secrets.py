"""Secret scans: keyword automaton, anchored expressions, embedded checksums.

1. One Aho-Corasick automaton over every rule's keywords reads each whole text
   once. A text without a keyword costs nothing more.
2. At each hit only the rules of that keyword run, anchored at the hit (never
   searching the text).
3. A match counts only if what the format embeds agrees: a base-62 CRC-32, a
   base-32 account number, JSON in a web token, DER in a private key. Formats
   that embed nothing are held to a least entropy.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexisearch.llm._spark import id_text, load

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ENTROPY = 3.0


def base62_crc(body: str) -> str:
    """The six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out


def _crc_tail(token: str) -> bool:
    body = token.partition("_")[2]
    return base62_crc(body[:-6]) == body[-6:]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _random(token: str) -> bool:
    return entropy(token) >= MIN_ENTROPY


def _account(token: str) -> bool:
    """The base-32 body holds a 12-digit account number."""
    x = base64.b32decode(token[4:] + "=" * (-len(token[4:]) % 8))
    return 0 < (int.from_bytes(x[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12 and _random(token[4:])


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _web_token(token: str) -> bool:
    head, body, _ = token.split(".")
    return _json_part(head) and _json_part(body)


def _key_block(token: str) -> bool:
    body = token.split("-----")[2]
    if len(body) < 40:
        return False
    body = re.sub(r"(?m)^[A-Za-z-]+: .*$", "", body)
    try:
        raw = base64.b64decode(re.sub(r"\s", "", body), validate=True)
    except (ValueError, binascii.Error):
        return False
    return raw.startswith(b"openssh-key-v1\0") or "ENCRYPTED" in token or raw[:1] == b"\x30" and len(raw) > 32


@dataclass(frozen=True)
class Rule:
    """``secret`` is matched from the keyword's first character on; group 1, or all of it, is the secret.

    An open rule's secret has no greatest length: ``secret`` is what stands before it,
    ``run`` its characters, of which all that follow each other are taken, at least
    ``least``. A quote before it must follow it too, and ``after`` must match behind one
    without. ``whole`` takes what stands before into the secret.
    """

    name: str
    keywords: tuple[str, ...]
    secret: re.Pattern
    valid: Callable[[str], bool]
    evidence: str
    run: re.Pattern | None = None
    least: int = 0
    whole: bool = False
    after: re.Pattern | None = None


_END = r"(?![A-Za-z0-9_])"
_BEFORE = r"(?<![A-Za-z0-9_])"
RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(_BEFORE + r"gh[pousr]_[A-Za-z0-9]{36}" + _END), _crc_tail, "checksum"),
    Rule("npm_token", ("npm_",), re.compile(_BEFORE + r"npm_[A-Za-z0-9]{36}" + _END), _crc_tail, "checksum"),
    Rule("aws_access_key", ("akia", "asia"), re.compile(_BEFORE + r"A[KS]IA[A-Z2-7]{16}" + _END), _account, "structure"),
    Rule("web_token", ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{16,}+"), _web_token, "structure"),
    Rule("private_key", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), _key_block, "structure"),
    Rule("google_api_key", ("aiza",), re.compile(_BEFORE + r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _random, "entropy"),
    Rule("gitlab_token", ("glpat-",), re.compile(_BEFORE + r"glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_-])"), _random, "entropy"),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(_BEFORE + r"xox[abprs]-(?=[0-9A-Za-z-])"), _random, "entropy", re.compile(r"[0-9A-Za-z-]*+"), 20, True),
    Rule("stripe_key", ("sk_live_", "rk_live_"), re.compile(_BEFORE + r"[sr]k_live_(?=[0-9A-Za-z])"), _random, "entropy", re.compile(r"[0-9A-Za-z]*+"), 24, True, re.compile(_END)),
    Rule(
        "assigned_secret",
        ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key"),
        re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access_key|private_key)[\"']?(?:\s*+(?:=>|:=|=|:)\s*+(?P<quote>[\"'])|[ \t]*+(?:=>|:=|=|:)[ \t]*+)(?=[0-9A-Za-z+/=_.\-])"),
        _random,
        "entropy",
        re.compile(r"[0-9A-Za-z+/=_.\-]*+"),
        16,
        False,
        re.compile(r"\s|\Z"),
    ),
)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(RULES):
        for w in rule.keywords:
            by_word.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w, rules in by_word.items():
        a.add_word(w, (len(w), tuple(rules)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _open_matches(i: int, heads: list[re.Match], text: str) -> Iterator[tuple[int, int, int]]:
    """(rule, start, end) of an open rule's secrets, given its heads by place.

    Heads may lie in each other's runs. The runs' ends are found once, and letters are
    counted from a run's end backwards, so that the work follows the text's length.
    """
    rule = RULES[i]
    stop = -1
    runs: list[tuple[int, int, int, str | None]] = []  # first character that counts, length's start, end, quote
    for m in heads:
        start = m.end()
        if start >= stop:
            stop = rule.run.match(text, start).end()
        runs.append((m.start() if rule.whole else start, start, stop, m.groupdict().get("quote")))
    seen: Counter = Counter()
    total, at, end = 0, -1, -1
    for first, start, stop, quote in reversed(runs):
        if stop != end:
            seen, total, at, end = Counter(), 0, stop, stop
        seen.update(text[first:at])
        total, at = total + at - first, first
        if stop - start < rule.least or (text[stop : stop + 1] != quote if quote else rule.after is not None and not rule.after.match(text, stop)):
            continue
        if math.log2(total) - sum(n * math.log2(n) for n in seen.values()) / total >= MIN_ENTROPY:
            yield i, first, stop


def scan(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, rule, evidence) of each secret, by place; none overlap.

    Where two rules match overlapping ranges the one listed first in ``RULES``
    stays, and of one rule the leftmost. Secrets may be of any length and number.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    heads: dict[int, list[re.Match]] = {}
    for last, (size, rules) in _automaton().iter(_lower(text)):
        for i in rules:
            m = RULES[i].secret.match(text, last - size + 1)
            if not m:
                continue
            if RULES[i].run is not None:
                heads.setdefault(i, []).append(m)
            elif RULES[i].valid(m[0]):
                found.append((i, *m.span()))
    for i, own in heads.items():
        found += _open_matches(i, sorted(own, key=re.Match.end), text)
    starts: list[int] = []  # of what is kept, by place, with the ends
    ends: list[int] = []
    kept: list[tuple[int, int, str, str]] = []
    for i, s, e in sorted(set(found)):
        at = bisect_right(starts, s)
        if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            ends.insert(at, e)
            kept.append((s, e, RULES[i].name, RULES[i].evidence))
    return sorted(kept)


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by ``[REDACTED:rule]``."""
    if not (hits := scan(text)):
        return text
    out, at = [], 0
    for s, e, name, _ in hits:
        out += [text[at:s], f"[REDACTED:{name}]"]
        at = e
    return "".join([*out, text[at:]])


FINDINGS = "doc_id bigint, rule string, start bigint, end bigint, evidence string, secret_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.string()), ("secret_sha256", pa.string())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret: the document, the rule, the half-open range in
    characters, what confirmed it, and the secret's SHA-256 (never the secret).

    One narrow pass over the whole texts, however long; no shuffle. Null or empty text has no
    rows. Repeated rows give their findings each. A null id stays null. Other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                for s, e, name, evidence in scan(text):
                    for column, x in zip(out, (batch.column(0)[k].as_py(), name, s, e, evidence, hashlib.sha256(text[s:e].encode()).hexdigest()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return id_text(docs, id_col, text_col).mapInArrow(run, FINDINGS)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced; ``length_col``, where
    there is one, is the new length of the texts that changed. Null texts stay null.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            old = batch.column(at).to_pylist()
            new = [redact(x) for x in old]
            columns = list(batch.columns)
            if changed := {k: len(b) for k, (a, b) in enumerate(zip(old, new, strict=True)) if a is not b}:
                columns[at] = pa.array(new, columns[at].type)
                if (to := batch.schema.get_field_index(length_col)) >= 0:
                    sizes = columns[to].to_pylist()
                    for k, n in changed.items():
                        sizes[k] = n
                    columns[to] = pa.array(sizes, columns[to].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"))
