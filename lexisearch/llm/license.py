"""Licence scans: TF-IDF cosine to templates, then inheritance from directories.

Every place where a word of a template's notice occurs that is telling (``CUES``) is a
possible header: the words there, aligned to each template that has the cue, are
compared with it by the cosine of sparse TF-IDF vectors. Inverse document frequencies are
those of the whole corpus. A file named as a licence, or one that is mostly notice, also
speaks for its directory; documents without a licence of their own take that of the
nearest ancestor directory that has one, found by joining directories to their ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import load, materialize, release
from lexisearch.llm._text import pieces, words

#: (licence, notice): short notices as they head a file, and openings of licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Licensed under the ISC License."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
CUES = ("license", "licensed", "licence", "licenced", "redistribution", "permission", "gnu", "cc0", "unencumbered")
LEAST = 0.85
#: A document is a licence file if its notice is at least this share of its words.
MOSTLY = 0.5
_FILE = re.compile(r"(?i)(?:^|[./_-])(?:un)?(?:licen[cs]e|copying)(?:[./_-]|$)")


def _hashes(texts: list[str]) -> list[np.ndarray]:
    h, first = words(pa.array(texts))
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


class Templates:
    """Template vectors over the templates' own words; words of a text outside them weigh as one in no document."""

    def __init__(self, idf: dict[int, float], unseen: float, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = _hashes([t for _, t in templates])
        self.idf, self.unseen = idf, unseen
        cues = set(np.concatenate(_hashes(list(CUES))).tolist())
        self.cues = np.array(sorted(cues), np.uint64)
        #: For each cue, the templates that have it and where.
        self.at: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for i, x in enumerate(w.tolist()):
                if x in cues:
                    self.at.setdefault(x, []).append((k, i))
        self.vectors = [self.vector(w) for w in self.words]

    def vector(self, w: np.ndarray) -> tuple[dict[int, float], float]:
        out: dict[int, float] = {}
        for x in w.tolist():
            out[x] = out.get(x, 0.0) + self.idf.get(x, self.unseen)
        return out, sum(v * v for v in out.values()) ** 0.5

    def best(self, h: np.ndarray, least: float = LEAST) -> tuple[str, float, int] | None:
        """(licence, cosine, words) of the notice in a text's words that is most similar to a
        template; of equals the longest, then the template listed first."""
        top: tuple[float, int, int] | None = None
        if not len(h):
            return None
        place = np.minimum(np.searchsorted(self.cues, h), len(self.cues) - 1)
        seen: set[tuple[int, int]] = set()
        for p in np.flatnonzero(self.cues[place] == h).tolist():
            for k, i in self.at.get(int(h[p]), ()):
                s = p - i
                if s < 0 or (k, s) in seen:
                    continue
                seen.add((k, s))
                size = len(self.words[k])
                mine, norm = self.vector(h[s : s + size])
                theirs, other = self.vectors[k]
                cosine = sum(v * theirs.get(x, 0.0) for x, v in mine.items()) / (norm * other)
                if cosine >= least and (top is None or (round(cosine, 9), size, -k) > top):
                    top = (round(cosine, 9), size, -k)
        return top and (self.names[-top[2]], top[0], top[1])


def frequencies(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """(texts, texts that have each template word) over the whole corpus."""
    terms = np.unique(np.concatenate(_hashes([t for _, t in TEMPLATES])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = words(part.column(0))
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == h)
                owner = np.searchsorted(first, hit, "right") - 1
                pair = np.unique(owner * len(terms) + at[hit])
                total[:-1] += np.bincount(pair % len(terms), minlength=len(terms))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["term", "n"])

    rows = dict(docs.select("text").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect())
    return rows.get(len(terms), 0), {int(t): rows.get(i, 0) for i, t in enumerate(terms)}


def headers(docs: DataFrame, least: float = LEAST, mostly: float = MOSTLY) -> DataFrame:
    """Each row's own licence, and whether it speaks for its directory; docs with ``doc_id``, ``path``, ``text``."""
    n, df = frequencies(docs)
    idf = {t: float(np.log((n + 1) / (x + 1)) + 1) for t, x in df.items()}
    shared = docs.sparkSession.sparkContext.broadcast((idf, float(np.log(n + 1) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = words(part.column(2))
                out: list[list] = [[], [], []]
                place = np.minimum(np.searchsorted(known.cues, h), len(known.cues) - 1)
                near = np.unique(np.searchsorted(first, np.flatnonzero(known.cues[place] == h), "right") - 1)
                got: dict[int, tuple[str, float, int]] = {int(k): b for k in near if (b := known.best(h[first[k] : first[k + 1]], least))}
                for k, path in enumerate(part.column(1).to_pylist()):
                    b = got.get(k)
                    out[0].append(b and b[0])
                    out[1].append(b and b[1])
                    out[2].append(bool(b) and path is not None and (bool(_FILE.search(path.rpartition("/")[2])) or b[2] >= mostly * int(first[k + 1] - first[k])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["doc_id", "path", "license", "score", "speaks"])

    return docs.select("doc_id", "path", "text").mapInArrow(run, "doc_id bigint, path string, license string, score double, speaks boolean")


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root's."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def nearest(wanted: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, from_dir, license): for each directory the licence of its nearest licensed ancestor or itself.

    Directories are joined to their ancestors, a row for each level of depth.
    """
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    up = wanted.select("dir", F.posexplode(levels).alias("depth", "from_dir"))
    hit = up.join(licensed, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "license"), "depth").alias("x"))
    return hit.select("dir", "x.from_dir", "x.license")


def scan(docs: DataFrame, path: Column | str = "path", id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, mostly: float = MOSTLY) -> DataFrame:
    """(doc_id, path, license, score, evidence, from_dir) of every row.

    ``evidence`` is 'own' for a licence found in the text (``score`` its cosine),
    'inherited' for one of the nearest ancestor directory (``from_dir``) that holds a
    licence file, and null with the other columns where there is neither. In a directory
    with several licence files the most similar speaks, of equals the alphabetically
    first licence. Null paths inherit nothing; null or empty texts have no licence of
    their own. Repeated rows each give a row; null ids stay null; other columns are
    ignored; an empty table gives an empty result.
    """
    path = F.col(path) if isinstance(path, str) else path
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.regexp_replace(path.cast("string"), "^/+|(?<=/)/+", "").alias("path"), F.col(text_col).cast("string").alias("text"))
    own = materialize(headers(rows, least, mostly).withColumn("dir", parent(F.col("path"))))
    licensed = own.where("speaks").groupBy(F.col("dir").alias("from_dir")).agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"))
    wanted = own.where("license is null and dir is not null").select("dir").distinct()
    given = nearest(wanted, licensed).select("dir", "from_dir", F.col("license").alias("given"))
    none = F.lit(None).cast("string")
    has = own.where("license is not null").select("doc_id", "path", "license", "score", F.lit("own").alias("evidence"), none.alias("from_dir"))
    lacks = own.where("license is null and dir is not null").join(given, "dir", "left")
    lost = own.where("license is null and dir is null").select("doc_id", "path", none.alias("license"), "score", none.alias("evidence"), none.alias("from_dir"))
    lacks = lacks.select("doc_id", "path", F.col("given").alias("license"), "score", F.when(F.col("given").isNotNull(), "inherited").alias("evidence"), "from_dir")
    out = materialize(has.union(lacks).union(lost))
    release(own)
    return out


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ``documents``, which has no paths: they are taken to lie in directories by
    source, language and runs of 64 ids."""
    docs = load(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs, path)
