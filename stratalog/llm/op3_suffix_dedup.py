"""Removal of long strings that occur more than once, found exactly with suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Every window of ``length`` bytes chooses the least hashed run of ``GRAM`` bytes in it as its anchor, so equal windows
   have equal anchors, and windows that differ in their anchor differ. An anchor serves a run of neighbouring windows;
   its context is all bytes of these. Rows (anchor hash, context hash, text, place) are grouped by anchor.
2. An anchor seen once is done with. One that has equal contexts only (64-bit hashes under one 64-bit anchor hash) marks
   all its windows. Only where an anchor has different contexts are the bytes of one text for each context fetched.
3. Groups of such contexts are cut into blocks of ``BLOCK_BYTES`` from the anchor on, whose ranks form one sequence;
   its suffix array and the common prefixes of neighbours in it tell which windows of a group are the same.
   A group of more than ``group_limit`` contexts isn't gathered: its windows are counted one by one by their hashes.
4. The marks go back to their places and texts are cut.

Counting combines before it shuffles, so a hot anchor or context is one row a task; places of hot ones are joined under
Spark's skew-join splitting; a text's marks are bounded by its length. No text is moved but once, to meet its marks.

Null or short texts lose nothing; equal rows are repeats of each other; windows never cross texts; an empty table gives
an empty result; a row with a null id keeps it. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffixes import suffix_array
from .texts import TABLE, Rolling, U, blocks, chosen, mixed

LENGTH = 200
GRAM = 40
BLOCK_BYTES = 32
GROUP_LIMIT = 20_000
#: Window starts of one long text that are worked on together.
SEGMENT = 8 << 20
#: Bytes of contexts in one suffix array.
CHUNK = 3 << 20
PLACES = "a long"  # start << 20 | windows << 10 | anchor's distance from the start


def pack(start: np.ndarray, windows: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 20) | (windows.astype(np.int64) << 10) | distance.astype(np.int64)


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts in one block, by anchor: text, first window, windows, anchor's distance, anchor hash, context hash."""
    parts = []
    if len(off) == 2 and len(data) > SEGMENT + length:
        for s in range(0, len(data) - length + 1, SEGMENT):
            part = data[s : s + SEGMENT + length - 1]
            found = anchors(part, np.array([0, len(part)]), length, gram)
            parts.append((found[0], found[1] + s, *found[2:]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    n = len(data) - length + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    roll = Rolling(TABLE[data])
    grams = roll.grams(gram)
    at = chosen(grams, length - gram + 1)
    valid = np.ones(n, bool)
    for e in off[1:-1].tolist():
        valid[max(0, e - length + 1) : e] = False
    same = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    starts = np.flatnonzero(valid & ~np.r_[False, same])
    ends = np.flatnonzero(valid & ~np.r_[same, False])
    text = np.searchsorted(off, starts, "right") - 1
    anchor = at[starts]
    context = mixed(roll(starts, ends + length) ^ (anchor - starts).astype(np.uint64))
    return text, starts - off[text], ends - starts + 1, anchor - starts, grams[anchor], context


def emit(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for i, _, data, off in blocks(batch.column(2)):
                text, start, windows, distance, anchor, context = anchors(data, off, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), k1[i + text], k2[i + text], pack(start, windows, distance))], ["fp", "ctx", "k1", "k2", "a"])

    return run


def cut_contexts(length: int):
    """(fp, ctx, c, k1, k2, a, text) to (fp, ctx, c, windows, distance, bytes); the rows of one text share its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("wanted").offsets.to_numpy()
            flat = batch.column("wanted").values
            fp, ctx, c, a = (flat.field(i).to_numpy() for i in range(4))
            texts = batch.column("text").cast(pa.binary())
            done = 0
            while done < batch.num_rows:  # few megabytes of contexts at a time
                upto, size = done, 0
                while upto < batch.num_rows and (size < 20_000 or upto == done):
                    size += offsets[upto + 1] - offsets[upto]
                    upto += 1
                rows = slice(offsets[done] - offsets[0], offsets[upto] - offsets[0])
                owner = np.repeat(np.arange(done, upto), np.diff(offsets[done : upto + 1]))
                out, last, raw = [], -1, b""
                for row, place in zip(owner.tolist(), a[rows].tolist()):
                    if row != last:
                        last, raw = row, texts[row].as_buffer()
                    start = place >> 20
                    out.append(raw[start : start + ((place >> 10) & 1023) + length - 1].to_pybytes())
                place = a[rows]
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(ctx[rows]), pa.array(c[rows]), pa.array((place >> 10) & 1023), pa.array(place & 1023), pa.array(out, pa.binary())], ["fp", "ctx", "c", "n", "d", "bytes"])
                done = upto

    return run


def same_windows(fp: np.ndarray, n: np.ndarray, d: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """A mark for each window of all contexts in turn: whether its bytes are those of a window of another context with
    the same anchor hash at the same distance."""
    size = BLOCK_BYTES
    lengths = np.array([len(x) for x in texts], np.int64)
    left = (-d) % size  # anchors stand at a block's start
    n_blocks = (left + lengths + size - 1) // size
    base = np.r_[0, np.cumsum(n_blocks)]
    padded = np.zeros((int(base[-1]) + 1) * size, np.uint8)
    heads = base[:-1] * size + left
    for at, text in zip(heads.tolist(), texts):
        padded[at : at + len(text)] = np.frombuffer(text, np.uint8)
    rows = padded[:-size].reshape(-1, size)
    names = np.unique(rows.view(f"S{size}").ravel(), return_inverse=True)[1].astype(np.int64)
    order = np.array(suffix_array(names.tolist()), np.int64)
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = len(order)  # no block follows
    # bytes that neighbours in the suffix array have in common, as far as a window goes
    common_bytes = np.zeros(len(order), np.int64)
    tail = np.r_[names, np.arange(-1, -length // size - 3, -1)]
    i, j, live = order[1:], order[:-1], np.arange(1, len(order))
    for _ in range(length // size + 1):
        equal = tail[i] == tail[j]
        differ = ~equal & (i < len(rows)) & (j < len(rows))
        if differ.any():
            common_bytes[live[differ]] += np.argmax(rows[i[differ]] != rows[j[differ]], 1)
        live, i, j = live[equal], i[equal] + 1, j[equal] + 1
        common_bytes[live] += size
    owner = np.repeat(np.arange(len(n)), n)
    first = np.r_[0, np.cumsum(n)]
    x = np.arange(first[-1]) - first[owner]
    place = heads[owner] + x
    block, o = place // size, place % size
    roll = Rolling(TABLE[padded])
    head = roll(place, (block + 1) * size)  # the rest of the window's first block
    classes = np.zeros(len(place), np.int64)
    for at in range(size):
        own = np.flatnonzero(o == at)
        if len(own):
            number = np.r_[np.cumsum(common_bytes < length - (size - at)), -1]
            classes[own] = number[rank[block[own] + 1]]
    key = mixed(mixed(mixed(fp[owner].view(np.uint64) + (d[owner] - x).astype(np.uint64)) ^ head) + classes.astype(np.uint64))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back] > 1


def runs(marks: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.view(np.int8), 0]))
    return edge.reshape(-1, 2).tolist()


def compare(length: int):
    """Contexts sorted by anchor to (fp, ctx, first, end): the runs of windows that occur in another context too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def result(rows: list[tuple]) -> pa.RecordBatch:
            fp, ctx, n, d = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3, 4))
            marks = same_windows(fp, n, d, [r[5] for r in rows], length)
            first = np.r_[0, np.cumsum(n)]
            out = [(int(fp[i]), int(ctx[i]), s, e) for i in range(len(rows)) for s, e in runs(marks[first[i] : first[i + 1]])]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["fp", "ctx", "first", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield result(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield result(held)

    return run


def each_window(length: int):
    """Contexts of crowded anchors to one row a window: (fp, ctx, x, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, ctx, _, n, d, raw in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(raw, np.uint8)
                x = np.arange(n)
                h = Rolling(TABLE[data])(x, x + length)
                g = Rolling(mixed(TABLE[data]))(x, x + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fp)), pa.array(np.full(n, ctx)), pa.array(x), pa.array((h + (d - x).astype(np.uint64)).view(np.int64)), pa.array(g.view(np.int64))], ["fp", "ctx", "x", "h1", "h2"])

    return run


def cut(length: int):
    """(doc_id, text, marks: array of start << 20 | windows << 10) to (doc_id, n_bytes, spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            marks = batch.column("marks")
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                n_bytes.append(len(data))
                places = marks[i].values.to_numpy() if marks[i].is_valid else np.zeros(0, np.int64)
                if not len(places):
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                edges = np.zeros(len(data) + 1, np.int64)
                start = places >> 20
                np.add.at(edges, start, 1)
                np.add.at(edges, start + ((places >> 10) & 1023) + length - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                spans.append(runs(gone))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (removed runs of bytes as start and end), kept (the remaining bytes)."""
    if not gram <= length < 900:
        raise ValueError("gram <= length < 900")
    common.tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = source.select("doc_id", *common.row_keys(F.col("doc_id"), F.col("text")), "text").withColumnsRenamed({"__k1": "k1", "__k2": "k2"})
    places = keyed.select("k1", "k2", "text").mapInArrow(emit(length, gram), "fp long, ctx long, k1 long, k2 long, " + PLACES)
    seen = places.groupBy("fp").agg(F.count("*").alias("seen"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("seen > 1")
    repeated = places.join(seen.select("fp", (F.col("lo") == F.col("hi")).alias("alike")).hint("shuffle_merge"), "fp")
    common_places = common.written(repeated.select("fp", "ctx", "k1", "k2", "a", "alike"), "op3-places")
    mixed_places = common_places.where("not alike")
    contexts = mixed_places.groupBy("fp", "ctx").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("k1", "k2", "a")))
    crowd = contexts.groupBy("fp").agg(F.count("*").alias("__n")).where(F.col("__n") > group_limit).select("fp")
    wanted = contexts.groupBy("k1", "k2").agg(F.collect_list(F.struct("fp", "ctx", "c", "a")).alias("wanted"))
    cuts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(cut_contexts(length), "fp long, ctx long, c long, n long, d long, bytes binary")
    cuts = common.written(cuts.dropDuplicates(["fp", "ctx"]), "op3-contexts")
    few = cuts.join(crowd, "fp", "left_anti").repartition("fp").sortWithinPartitions("fp", "ctx")
    found = few.mapInArrow(compare(length), "fp long, ctx long, first long, end long")
    windows = cuts.join(crowd, "fp", "left_semi").mapInArrow(each_window(length), "fp long, ctx long, x long, h1 long, h2 long")
    twice = windows.groupBy("fp", "h1", "h2").agg(F.count("*").alias("__n")).where("__n > 1").select("fp", "h1", "h2")
    found = found.unionAll(windows.join(twice, ["fp", "h1", "h2"]).select("fp", "ctx", F.col("x").alias("first"), (F.col("x") + 1).alias("end")))
    found = found.unionAll(contexts.where("c > 1").select("fp", "ctx", F.lit(0).cast("long"), F.shiftright("a", 10).bitwiseAND(1023)))
    start, count = F.shiftright("a", 20), F.col("end") - F.col("first")
    partly = mixed_places.join(found, ["fp", "ctx"]).select("k1", "k2", (F.shiftleft(start + F.col("first"), 20) + F.shiftleft(count, 10)).alias("a"))
    marks = common_places.where("alike").select("k1", "k2", F.shiftleft(F.shiftright("a", 10), 10).alias("a")).unionAll(partly)
    marks = marks.groupBy("k1", "k2").agg(F.collect_set("a").alias("marks"))
    return keyed.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(cut(length), "doc_id long, n_bytes long, spans array<array<int>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text by a table of all windows; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        keep = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(keep).hexdigest()))
    return out
