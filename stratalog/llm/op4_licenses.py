"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Templates are cut to shingles of ``SHINGLE`` words (all its words, for a shorter one) and put in classes by the power of
two C that their number of shingles reaches. A document is cut to windows of 2 C shingles at every C-th place, so that
any run of up to C shingles lies within one. A window's sketch is the least hash of each of ``BANDS`` bands, to which
shingles belong by hash (one-permutation MinHash, a row a band); a template is a candidate if a band agrees. An
occurrence that holds ``CONTAINED`` of a template's shingles has a Jaccard similarity of at least 0.19 with its window,
so that all of 64 bands disagree with a chance of about 1e-6 at most, and less for short templates, whose shingles are
mostly alone in their bands. Only windows that hold a template's band value can agree, so only these are sketched.
A candidate is a match if the window holds at least ``CONTAINED`` of its distinct shingles, and no other template is
matched more fully by words that it overlaps.

Templates are taken to the workers in parts of at most ``PART_BYTES``, in several passes if need be. Texts are read in
place and nothing is shuffled, except where several passes' results are put together.

Null and wordless texts hold no license; templates without words are left out; templates of equal text all match;
repeated rows have repeated results; empty tables give empty or empty-handed results. Only named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op1_decontaminate import among
from .texts import WORD, Rolling, U, Words, blocks

SHINGLE = 5
BANDS = 64
CONTAINED = 0.8
PART_BYTES = 8 << 20

#: Notices and bodies by SPDX id; several may stand for one license.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy " "of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by " "the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by " "the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without " "modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for " "any purpose with or without fee is hereby granted"),
    ("ISC", "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
]


def words_of(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), WORD)


def sketch(hashes: np.ndarray) -> dict[int, int]:
    """The least hash of each band that has one."""
    band = (hashes % U(BANDS)).astype(np.int64)
    order = np.lexsort((hashes, band))
    first = np.r_[True, np.diff(band[order]) > 0]
    return dict(zip(band[order][first].tolist(), hashes[order][first].tolist()))


class Templates:
    def __init__(self, templates: list[tuple[str, str]], shingle: int):
        self.names, self.shingles = [], []
        #: By (words in a shingle, class): band value to templates.
        self.bands: dict[tuple[int, int], dict[int, list[int]]] = {}
        for name, text in templates:
            words = words_of(text)
            if not len(words):
                continue
            k = min(shingle, len(words))
            own = np.unique(Rolling(words.hashes()).grams(k))
            self.names.append(name)
            self.shingles.append(own)
            size = 1 << max(0, int(len(words) - k)).bit_length()
            for value in sketch(own).values():
                self.bands.setdefault((k, size), {}).setdefault(value, []).append(len(self.names) - 1)
        self.values = {key: np.array(sorted(d), np.uint64) for key, d in self.bands.items()}

    def matches(self, words: Words, contained: float) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word, containment) of all windows that hold a template."""
        out = []
        roll = Rolling(words.hashes())
        limit = words.first
        for (k, size), values in self.values.items():
            grams = roll.grams(k)
            hits = np.flatnonzero(among(grams, values)) if len(grams) else []
            if not len(hits):
                continue
            text = np.searchsorted(limit, hits, "right") - 1
            ok = hits + k <= limit[text + 1]  # a shingle lies within a text
            place = (hits - limit[text])[ok] // size
            windows = {(t, max(0, w)) for t, p in zip(text[ok].tolist(), place.tolist()) for w in (p - 1, p)}
            for t, w in sorted(windows):
                start = int(limit[t]) + w * size
                end = min(start + 2 * size, int(limit[t + 1]) - k + 1)
                own = grams[start:end]
                bands = self.bands[k, size]
                for template in sorted({x for value in sketch(own).values() for x in bands.get(value, ())}):
                    wanted = self.shingles[template]
                    inside = np.isin(own, wanted)
                    share = len(np.unique(own[inside])) / len(wanted)
                    if share >= contained:
                        at = np.flatnonzero(inside)
                        out.append((t, template, int(start + at[0] - limit[t]), int(start + at[-1] + k - 1 - limit[t]), share))
        return out


def fullest(matches: list[dict]) -> list[dict]:
    """The matches that no fuller one overlaps: of two licenses that differ in few words the one at hand stays."""
    return [m for m in matches if not any(x["contained"] > m["contained"] and x["first"] <= m["last"] and m["first"] <= x["last"] for x in matches)]


RESULT = "doc_id long, n_words long, licenses array<string>, matches array<struct<license: string, first: int, last: int, contained: double>>"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED, shingle: int = SHINGLE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, licenses (sorted ids), matches (a template's windows that overlap: the fullest)."""
    spark = common.tuned(docs.sparkSession)
    shares: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in TEMPLATES if templates is None else templates:
        if size + len(text or "") > part_bytes and shares[-1]:
            shares.append([])
            size = 0
        shares[-1].append((name, text or ""))
        size += len(text or "")
    key = common.row_keys(F.col(id_col), F.col(text_col))
    source = docs.select(*key, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(shares) == 1:
        return source.select("doc_id", "text").mapInArrow(look(spark, shares[0], shingle, contained, True), RESULT)
    # which match is the fullest shows when those of all passes are together
    first = source.mapInArrow(look(spark, shares[0], shingle, contained), "__k1 long, __k2 long, " + RESULT)
    rest = None
    for share in shares[1:]:
        own = source.mapInArrow(look(spark, share, shingle, contained), "__k1 long, __k2 long, " + RESULT).where(F.size("licenses") > 0).select("__k1", "__k2", F.col("matches").alias("m"))
        rest = own if rest is None else rest.unionAll(own)
    # repeated rows have one and the same result
    rest = rest.groupBy("__k1", "__k2").agg(F.flatten(F.collect_set("m")).alias("m"))
    joined = first.join(rest, ["__k1", "__k2"], "left").withColumn("all", F.when(F.col("m").isNull(), F.col("matches")).otherwise(F.concat("matches", "m")))
    fuller = lambda m: F.exists("all", lambda x: (x["contained"] > m["contained"]) & (x["first"] <= m["last"]) & (m["first"] <= x["last"]))
    kept = joined.withColumn("matches", F.filter("all", lambda m: ~fuller(m)))
    return kept.select("doc_id", "n_words", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"), "matches")


def look(spark: SparkSession, templates: list[tuple[str, str]], shingle: int, contained: float, alone: bool = False):
    shared = spark.sparkContext.broadcast(Templates(templates, shingle))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text")):
                words = Words(data, off, WORD)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                last: dict[tuple[int, int], dict] = {}
                for text, template, first, end, share in t.matches(words, contained):
                    row = {"license": t.names[template], "first": first, "last": end, "contained": share}
                    before = last.get((text, template))
                    if before and first <= before["last"]:
                        if share > before["contained"]:
                            before.update(row)
                        continue
                    last[text, template] = row
                    found[text].append(row)
                if alone:
                    found = [fullest(ms) if len(ms) > 1 else ms for ms in found]
                names = [sorted({m["license"] for m in ms}) for ms in found]
                columns = [*(batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"), pa.array(np.diff(words.first)), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != "text"), "n_words", "licenses", "matches"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents"))
    best = F.aggregate("matches", F.lit(0.0), lambda a, m: F.greatest(a, m["contained"]))
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), best.alias("contained"))
