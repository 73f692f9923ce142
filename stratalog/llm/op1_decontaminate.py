"""Benchmark decontamination by winnowing.

Every benchmark item is cut to windows of ``window`` words. Of the hashes of the k-word runs in a window the least one
is its fingerprint, and every window of a document chooses its own in the same way, so that a shared window always has
a shared fingerprint. Fingerprints are joined; a hit is extended to the windows round it, whose words are compared.

A benchmark of at most ``PART_BYTES`` of distinct item text (it is summed first) goes to the workers as a table of
windows; texts are read in place and nothing is shuffled. A larger one is never collected: documents and items give rows
of fingerprints, which are joined; texts with a hit are read once more for the windows round the shared fingerprints only,
and these are joined with the items' windows, word by word. Fingerprints of a document are distinct, and those of the
items too, so a passage that many documents share makes one row a document, and hot ones fall under Spark's skew join.

Null or wordless texts have no words and are clean; null items have no windows; items with one id count once; a null
item_id is written as an empty string; tied fingerprints choose the last place; repeated rows give repeated results;
empty tables give empty or clean results. Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .texts import WORD, Rolling, Words, blocks, chosen

WINDOW = 10
#: Item text that is taken to the workers at most.
PART_BYTES = 8 << 20


class Windows:
    """The distinct windows of some items, findable by fingerprint."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.known: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        hashes: dict[int, set[int]] = {}
        prints: dict[int, set[int]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            words = Words(data, np.array([0, len(data)]), WORD)
            size = min(window, len(words))
            if not size:
                continue
            roll = Rolling(words.hashes())
            grams = roll.grams((size + 1) // 2)
            picks = chosen(grams, size - (size + 1) // 2 + 1)
            hashes.setdefault(size, set()).update(roll.grams(size).tolist())
            prints.setdefault(size, set()).update(grams[picks].tolist())
            for i in range(len(words) - size + 1):
                key = words.joined(i, i + size)
                if key not in self.known:
                    self.known[key] = len(self.items)
                    self.items.append(set())
                self.items[self.known[key]].add(item)
        #: By length: sorted window hashes, sorted fingerprints.
        self.by_length = {n: (np.array(sorted(hashes[n]), np.uint64), np.array(sorted(prints[n]), np.uint64)) for n in sorted(hashes)}

    def matches(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Marks of the words inside an occurrence, and the occurrences as pairs (text, window)."""
        n, found = len(words), []
        marks = np.zeros(n + 1, np.int64)
        if not n or not self.items:
            return marks[:n] > 0, found
        owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        limit = words.first[1:][owner]  # the end of each word's text
        roll = Rolling(words.hashes())
        for size, (hashes, prints) in self.by_length.items():
            if n < size:
                continue
            k = (size + 1) // 2
            w = size - k + 1
            grams = roll.grams(k)
            picks = chosen(grams, w)
            picks = picks[np.r_[True, picks[1:] != picks[:-1]]]
            picks = picks[among(grams[picks], prints)]
            if not len(picks):
                continue
            starts = np.unique((picks[:, None] - np.arange(w)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + size <= n)]
            starts = starts[starts + size <= limit[starts]]
            for i in starts[among(roll(starts, starts + size), hashes)].tolist():
                window = self.known.get(words.joined(i, i + size))
                if window is not None:
                    marks[i] += 1
                    marks[i + size] -= 1
                    found.append((int(owner[i]), window))
        return np.cumsum(marks)[:n] > 0, found


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def items_of(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> tuple[DataFrame, bool]:
    """The distinct items with text, and whether their texts together have at most so many bytes."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    return items, (items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0) <= most


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items (sorted ids of the items with an occurring window), spans (runs of hit
    words as first and last place)."""
    if not 0 < window < 256:
        raise ValueError("a window has 1 to 255 words")
    spark = common.tuned(docs.sparkSession)
    items, small = items_of(benchmark, item_col, item_text, part_bytes)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<int>>"
    if small:
        return source.mapInArrow(scan(spark, items, window), schema)
    keyed = source.select("doc_id", *common.row_keys(F.col("doc_id"), F.col("text")), "text")
    hits = joined(keyed, items, window)
    found = hits.groupBy("__k1", "__k2").agg(F.collect_set("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return keyed.select("doc_id", "__k1", "__k2", "text").join(found.hint("shuffle_merge"), ["__k1", "__k2"], "left").select("doc_id", "text", "at", "items").mapInArrow(marked, schema)


def joined(keyed: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Of (__k1, __k2, text) the occurring windows: (__k1, __k2, at: first word << 8 | words, items)."""
    windows = items.mapInArrow(windows_of(window), "item string, n int, fp long, win string")
    windows = common.written(windows.groupBy("n", "fp", "win").agg(F.array_sort(F.collect_set("item")).alias("items")), "op1-windows")
    prints = windows.select("n", "fp").distinct()
    sizes = tuple(sorted(r.n for r in windows.select("n").distinct().collect()))  # at most window numbers
    text = keyed.select("__k1", "__k2", "text")
    own = text.mapInArrow(prints_of(sizes), "__k1 long, __k2 long, n int, fp long").join(prints.hint("shuffle_merge"), ["n", "fp"], "left_semi")
    hit = own.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("n", "fp")).alias("hits"))
    # equal rows are one text here
    again = text.join(hit.hint("shuffle_merge"), ["__k1", "__k2"]).groupBy("__k1", "__k2").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    near = again.mapInArrow(round_hits, "__k1 long, __k2 long, at long, n int, fp long, win string")
    return near.join(windows.hint("shuffle_merge"), ["n", "fp", "win"]).select("__k1", "__k2", "at", "items")


def picked(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of texts the first words of all windows of so many words within a text, and each one's fingerprint."""
    k = (size + 1) // 2
    grams = Rolling(words.hashes()).grams(k)
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(len(words) - size + 1)
    end = np.repeat(words.first[1:], np.diff(words.first))
    own = start + size <= end[start]
    return start[own], grams[chosen(grams, size - k + 1)[own]]


def windows_of(window: int):
    """(item, text) to (item, n, fp, win)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in blocks(batch.column("text")):
                words = Words(data, off, WORD)
                counts = np.minimum(np.diff(words.first), window)
                owner = np.repeat(np.arange(len(counts)), np.diff(words.first))
                for size in np.unique(counts[counts > 0]).tolist():
                    start, fp = picked(words, size)
                    own = counts[owner[start]] == size
                    start, fp = start[own], fp[own]
                    wins = [words.joined(s, s + size).decode() for s in start.tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(i + owner[start])), pa.array(np.full(len(start), size, np.int32)), pa.array(fp.view(np.int64)), pa.array(wins, pa.string())], ["item", "n", "fp", "win"])

    return run


def prints_of(sizes: tuple[int, ...]):
    """(k1, k2, text) to the distinct fingerprints of each text, for windows of each size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in blocks(batch.column("text")):
                words = Words(data, off, WORD)
                owner = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
                for size in sizes:
                    start, fp = picked(words, size)
                    text = owner[start]
                    order = np.lexsort((fp, text))
                    text, fp = text[order], fp[order]
                    new = np.r_[True, (text[1:] != text[:-1]) | (fp[1:] != fp[:-1])] if len(fp) else np.zeros(0, bool)
                    rows = pa.array(i + text[new])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(rows), size, np.int32)), pa.array(fp[new].view(np.int64))], ["__k1", "__k2", "n", "fp"])

    return run


def round_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, hits) to the windows whose fingerprints are among the hits."""
    for batch in batches:
        for i, j, data, off in blocks(batch.column("text")):
            words = Words(data, off, WORD)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
            hits = [{(h["n"], h["fp"]) for h in batch.column("hits")[r].as_py()} for r in range(i, j)]
            rows: list[tuple] = []
            for size in sorted({n for h in hits for n, _ in h}):
                start, fp = picked(words, size)
                wanted = np.array(sorted({f for h in hits for n, f in h if n == size}), np.int64)
                at = np.flatnonzero(among(fp.view(np.int64), wanted))
                for s, f in zip(start[at].tolist(), fp.view(np.int64)[at].tolist()):
                    text = int(owner[s])
                    if (size, f) in hits[text]:
                        rows.append((i + text, (s - int(words.first[text])) << 8 | size, size, f, words.joined(s, s + size).decode()))
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.string())))], ["__k1", "__k2", "at", "n", "fp", "win"])


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, at, items) to the columns of decontaminate()."""
    for batch in batches:
        for i, j, data, off in blocks(batch.column("text")):
            n_words = np.diff(Words(data, off, WORD).first)
            spans, items, n_hit = [], [], []
            for r, n in zip(range(i, j), n_words.tolist()):
                edges = np.zeros(n + 1, np.int64)
                for at in batch.column("at")[r].as_py() or ():
                    edges[at >> 8] += 1
                    edges[(at >> 8) + (at & 255)] -= 1
                spans.append(runs(np.cumsum(edges)[:n] > 0))
                n_hit.append(sum(e - s + 1 for s, e in spans[-1]))
                items.append(batch.column("items")[r].as_py() or [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc_id", "n_words", "n_hit", "items", "spans"])


def runs(marks: np.ndarray) -> list[list[int]]:
    """First and last place of each run of marks."""
    own = np.r_[0, marks.view(np.int8), 0]
    return np.stack([np.flatnonzero(np.diff(own) == 1), np.flatnonzero(np.diff(own) == -1) - 1], 1).tolist()


def scan(spark: SparkSession, items: DataFrame, window: int):
    """The function for mapInArrow over (doc_id, text); items: bounded by items_of()."""
    rows = sorted((r.item, r.text) for r in items.collect())
    shared = spark.sparkContext.broadcast(Windows(rows, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text")):
                words = Words(data, off, WORD)
                marks, found = windows.matches(words)
                items: list[set[int]] = [set() for _ in range(j - i)]
                for text, window in found:
                    items[text].add(window)
                n_words = np.diff(words.first)
                sums = np.r_[0, np.cumsum(marks)]
                n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
                names = [sorted(set().union(*(windows.items[w] for w in ids))) if ids else [] for ids in items]
                spans: list[list[list[int]]] = [[] for _ in range(j - i)]
                for text in np.flatnonzero(n_hit):
                    spans[text] = runs(marks[words.first[text] : words.first[text + 1]])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark window."""
    spark = common.tuned(docs.sparkSession)
    items, small = items_of(benchmark, item_col, item_text, part_bytes)
    if small:
        return docs.mapInArrow(sieve(spark, items, window, docs.columns.index(text_col)), docs.schema)
    # equal texts are clean or not alike: the key is the text's hash alone
    names = common.free(docs.columns, "__k1", "__k2")
    keys = [F.xxhash64(F.col(text_col).cast("string")), F.hash(F.col(text_col).cast("string")).cast("long")]
    text = docs.select(*(k.alias(n) for k, n in zip(keys, ("__k1", "__k2"))), F.col(text_col).cast("string").alias("text")).where("text is not null")
    bad = joined(text, items, window).select(*(F.col(k).alias(n) for k, n in zip(("__k1", "__k2"), names))).distinct()
    return docs.withColumns(dict(zip(names, keys))).join(bad.hint("shuffle_merge"), names, "left_anti").select(docs.columns)


def sieve(spark: SparkSession, items: DataFrame, window: int, at: int):
    shared = spark.sparkContext.broadcast(Windows(sorted((r.item, r.text) for r in items.collect()), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, data, off in blocks(batch.column(at)):
                for text, _ in shared.value.matches(Words(data, off, WORD))[1]:
                    keep[i + text] = False
            yield batch.filter(pa.array(keep))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
