"""Routing, formatting and array functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def route(doc_id: Column, groups: int) -> Column:
    """The shard group of a document."""
    return F.pmod(F.xxhash64(doc_id), F.lit(groups)).cast("int")


def replica_of(query: Column, factor: int) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(factor)).cast("int")


_M = (1 << 64) - 1


def murmur3_64(data: bytes, seed: int = 0) -> int:
    """The first half of the 128-bit x64 variant of MurmurHash3, unsigned."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F

    def rot(x: int, r: int) -> int:
        return (x << r | x >> (64 - r)) & _M

    def final(x: int) -> int:
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * c & _M
        return x ^ x >> 33

    h1 = h2 = seed
    full = len(data) // 16 * 16
    for i in range(0, full, 16):
        k1, k2 = (int.from_bytes(data[i + j : i + j + 8], "little") for j in (0, 8))
        h1 = ((rot(h1 ^ rot(k1 * c1 & _M, 31) * c2 & _M, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 = ((rot(h2 ^ rot(k2 * c2 & _M, 33) * c1 & _M, 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[full:]
    if len(tail) > 8:
        h2 ^= rot(int.from_bytes(tail[8:], "little") * c2 & _M, 33) * c1 & _M
    if tail:
        h1 ^= rot(int.from_bytes(tail[:8], "little") * c1 & _M, 31) * c2 & _M
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    return (final(h1) + final(h2)) & _M


@F.pandas_udf(T.LongType())
def murmur3(values: pd.Series) -> pd.Series:
    """:func:`murmur3_64` of the UTF-8 bytes, as a signed number; for bit parity only."""
    return values.map(lambda v: None if v is None else int(np.uint64(murmur3_64(v.encode())).astype(np.int64))).astype("Int64")


def top_indices(scores: Column, k: int = 5) -> Column:
    """Positions of the ``k`` largest values, largest first; of equals the earlier. Fewer values give fewer."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def shard_parts(shard_id: Column) -> Column:
    """namespace.group.replica as a struct; null unless there are three parts, two of them numbers."""
    p = F.split(shard_id, r"\.")
    good = (F.size(p) == 3) & shard_id.rlike(r"^[^.]+\.\d+\.\d+$")
    return F.when(good, F.struct(p[0].alias("namespace"), p[1].cast("int").alias("group_id"), p[2].cast("int").alias("replica_id")))


def shard_name(namespace: Column, group: Column, replica: Column) -> Column:
    return F.format_string("%s.%d.%d", namespace, group, replica)


def segment_line(create_time: Column, segment_id: Column, num_docs: Column) -> Column:
    """One line about a segment, as listings show it."""
    return F.format_string("ctime=%s    id=%-10dnum=%d", F.date_format(create_time, "yyyy-MM-dd HH:mm:ss"), segment_id, num_docs)


def canonical_id(value: Column) -> Column:
    """UUIDs in their canonical form, other ids as they are."""
    return F.coalesce(canonical_uuid(value), value)


def trace_id(given: Column) -> Column:
    """The caller's trace id, or a new one where it is null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.uuid())


def canonical_uuid(value: Column) -> Column:
    """The lower-case dashed form; null for what is no UUID."""
    hexes = F.regexp_replace(F.lower(value), r"^urn:uuid:|[{}-]", "")
    dashed = F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexes.rlike("^[0-9a-f]{32}$"), dashed)
