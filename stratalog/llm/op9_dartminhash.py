"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its runs of ``SHINGLE`` words, weighted by how often they occur. Darts fall on every
unit of an element's weight at a fixed rate, each with a random rank and one of ``BANDS * ROWS`` coordinates, all drawn
from the unit's hash; those below a rank that falls with the document's total weight are thrown, and the earliest of
each coordinate is kept. Two documents keep the same dart with a chance equal to their weighted Jaccard similarity.
A document with an empty coordinate throws again up to twice the rank.

Documents with the same words form one class at once. Classes that share a band are joined to the band's leader;
similarities are then computed from all elements and links below ``threshold`` dropped. Where a band still holds several
components, its members of different components are compared too, so sharing a band with a similar text is never lost:
in bands of up to ``CROWD`` members as pairs, in larger ones as blocks of about ``UNIT`` elements, each pair of blocks a
task's unit that gives each member its root within the unit, so pairs are never written. With 32 bands of 5 a pair at
0.8 shares none with a chance of 3e-6.

Bands are aggregated before they are shuffled; a leader's links are sorted next to it and streamed, and a leader of more
than ``SPREAD`` of them is sent to several tasks.

Texts of fewer words than a shingle are one element; null and wordless texts link with nothing. Documents are told apart
by their words, never by their ids, so unlike texts under one id are documents of their own. A class has the smallest id
in it, null if it has none; what is kept of it is a row with that id. Rows of one id and text are one document. An empty
table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .texts import WORD, Rolling, U, Words, blocks, mixed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
CROWD, UNIT, SPREAD = 64, 200_000, 4096
#: Numbers in a table of a unit's elements by a stretch of its members; memory only, no result depends on it.
WORK = 4 << 20
_STEP = U(0x9E3779B97F4A7C15)


def units(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of texts the places where each text's units begin and end, and the units, sorted within a text."""
    n = len(words.first) - 1
    hashes = words.hashes()
    roll = Rolling(hashes)
    counts = np.diff(words.first)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    off = np.r_[0, np.cumsum(own)]
    owner = np.repeat(np.arange(n), own)
    start = words.first[:-1][owner] + np.arange(off[-1]) - off[owner]
    shingle = roll(start, start + np.minimum(size, counts)[owner])
    order = np.lexsort((shingle, owner))
    shingle = shingle[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])] if len(shingle) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(shingle)), 0)) if len(shingle) else new
    unit = mixed(shingle + (np.arange(len(shingle)) - first).astype(np.uint64) * _STEP)
    return off, unit[np.lexsort((unit, owner))]


def signatures(off: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """The kept dart of each coordinate, for each text; zeros for a text without units."""
    n = len(off) - 1
    weight = np.diff(off)
    best = np.full(n * k, ~U(0), np.uint64)  # rank above, dart's hash below
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero(weight)
    limit = (math.log(k) + 2) / np.maximum(weight, 1)
    while len(todo):
        best[(todo[:, None] * k + np.arange(k)).ravel()] = ~U(0)
        owner = np.repeat(todo, weight[todo])
        own = unit[np.repeat(off[:-1][todo], weight[todo]) + np.arange(len(owner)) - np.repeat(np.cumsum(weight[todo]) - weight[todo], weight[todo])]
        state, rank, top = own, np.zeros(len(own)), limit[owner]
        while len(state):
            state = mixed(state + _STEP)
            rank = rank - np.log((state >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / k
            live = rank <= top
            state, rank, top, owner = state[live], rank[live], top[live], owner[live]
            dart = mixed(state ^ U(0xD6E8FEB86659FD93))
            at = owner * k + (dart % U(k)).astype(np.int64)
            # ranks of a text are at most top; 31 bits of them order the darts, ties go to the hash
            np.minimum.at(best, at, ((rank / top * 0x7FFFFFFF).astype(np.uint64) << U(33)) | (dart >> U(31)))
        rows = best.reshape(n, k)[todo]
        full = (rows != ~U(0)).all(1)
        out[todo[full]] = rows[full] & U((1 << 33) - 1)
        todo = todo[~full]
        limit[todo] *= 2
    return out


def sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
        for batch in batches:
            for i, j, data, off in blocks(batch.column(2)):
                words = Words(data, off, WORD)
                at, unit = units(words, size)
                sig = signatures(at, unit, bands * rows).reshape(j - i, bands, rows)
                band = np.broadcast_to(salt, (j - i, bands)).copy()
                for r in range(rows):
                    band = mixed(band * U(31) + sig[:, :, r])
                node = Rolling(words.hashes())(words.first[:-1], words.first[1:]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * bands + 1, bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(node), pa.array(np.diff(at)), lists], ["doc_id", "k2", "node", "n", "bands"])
        common.trimmed()

    return run


def sets(size: int):
    """(node, text) to (node, its sorted units as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in blocks(batch.column(1)):
                at, unit = units(Words(data, off, WORD), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([unit[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], ["node", "units"])

    return run


def compare(threshold: float):
    """Rows (leader, salt, member or null, units), a leader's own first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    leader, own = a, other.copy()
                    continue
                if a != leader:
                    raise AssertionError("a link without its leader")
                both = len(own) + len(other)
                if min(len(own), len(other)) < threshold * max(len(own), len(other)):
                    continue
                same = both - len(np.union1d(own, other))
                if same >= threshold * (both - same):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def compare_blocks(threshold: float):
    """Rows (band, i, j, mine, node, root, units), sorted by unit, to links (a, b) of members of different roots."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        cross = rows[0][1] != rows[0][2]
        mine, node, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), size)
        owner, token = owner[often[token] > 1], token[often[token] > 1]
        place = np.cumsum(often > 1) - 1
        token = place[token]
        first = np.searchsorted(owner, np.arange(len(rows) + 1))
        filled = np.flatnonzero(np.diff(first))
        label = list(range(len(rows)))

        def top(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        step = max(1, min(64, WORK // max(1, len(token), 4 * len(rows))))
        for s in range(0, len(rows), step):
            e = min(len(rows), s + step)
            has = np.zeros((int((often > 1).sum()), e - s), np.uint32)
            has[token[first[s] : first[e]], owner[first[s] : first[e]] - s] = 1
            same = np.zeros((len(rows), e - s), np.int64)
            if len(filled):
                same[filled] = np.add.reduceat(has[token], first[filled], 0, np.uint32)  # else a copy in 64 bits is made first
            near = same >= threshold * (size[:, None] + size[None, s:e] - same)
            near &= (same > 0) & (root[:, None] != root[None, s:e])
            if cross:
                near &= mine[:, None] != mine[None, s:e]
            for k, i in zip(*np.nonzero(near)):
                x, y = top(int(k)), top(s + int(i))
                label[max(x, y)] = min(x, y)
        found = [(int(node[k]), int(node[top(k)])) for k in range(len(rows)) if top(k) != k]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield solve(held)
                    held = []
                    common.trimmed()
                held.append(row)
        if held:
            yield solve(held)
            del held
            common.trimmed()

    return run


def element_sets(nodes: DataFrame, forms: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, units) of nodes (node); texts: (k1, k2, text)."""
    keys = forms.join(nodes.distinct().hint("shuffle_merge"), "node", "left_semi").select("node", "head.k1", "head.k2")
    found = texts.join(keys.hint("shuffle_merge"), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))
    return common.written(found.mapInArrow(sets(size), "node long, units binary"), "op9-sets")


def verified(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those at least so similar; found: (node, units) of them all."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).alias("m"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).alias("salt"))
    leaders = salted.select("a", "salt").distinct().join(found.hint("shuffle_merge"), F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "units")
    members = salted.join(found.hint("shuffle_merge"), F.col("b") == F.col("node")).select("a", "salt", "b", "units")
    rows = leaders.unionAll(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare(threshold), "a long, b long")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, crowd: int = CROWD, unit: int = UNIT) -> DataFrame:
    """Per row of docs: doc_id, class_id (the smallest id of its class), kept (whether it is the row that stays), and the
    row's keys __k1, __k2."""
    spark = common.tuned(docs.sparkSession)
    key = common.row_keys(F.col(id_col), F.col(text_col).cast("string"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), key[1].alias("k2"), F.col(text_col).cast("string").alias("text"))
    signed = common.written(source.mapInArrow(sign(shingle, bands, rows), "doc_id long, k2 long, node long, n long, bands array<long>"), "op9-signatures")
    k1 = F.coalesce("doc_id", F.lit(-(2**63))).alias("k1")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), k1, "k2")).alias("head")
    forms = common.written(signed.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), head, F.first("bands").alias("bands")), "op9-forms")
    members = forms.select("node", "n", F.explode("bands").alias("band"))
    order = F.xxhash64("node")
    lead = members.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct(order.alias("o"), "node", "n")).alias("lead")).where("m > 1")
    shared = members.join(lead.hint("shuffle_merge"), "band").select("band", "node", "n", F.col("lead.node").alias("leader"), F.col("lead.n").alias("ln"))
    shared = common.written(shared, "op9-bands")
    alike = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)
    first = shared.where((F.col("node") != F.col("leader")) & alike(F.col("n"), F.col("ln"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = common.written(first, "op9-pairs")
    texts = source.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), "k2", "text")
    found = element_sets(first.select(F.col("a").alias("node")).unionAll(first.select("b")), forms, texts, shingle)
    links = common.written(verified(first, found, threshold), "op9-links")
    common.dropped(spark, found)
    roots = common.components(links)
    # bands that still hold several components: their members of different components
    label = shared.select("band", "node", "n").join(roots.hint("shuffle_merge"), "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    label = common.written(label, "op9-labels")
    several = label.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "m", "total")
    rest = common.written(label.join(several.hint("shuffle_merge"), "band"), "op9-rest")
    x, y = (rest.where(F.col("m") <= crowd).alias(side) for side in "xy")
    pairs = x.join(y.hint("shuffle_merge"), (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & alike(F.col("x.n"), F.col("y.n")))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = common.written(pairs.join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti"), "op9-pairs")
    crowded = rest.where(F.col("m") > crowd)
    found = element_sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(crowded.select("node")), forms, texts, shingle)
    p = F.ceil(F.col("total") / unit).cast("int")
    placed = crowded.withColumn("p", p).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("p")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    # a unit of two blocks holds either's rows; one of a single block serves the pairs within it
    placed = placed.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root").join(found.hint("shuffle_merge"), "node")
    blocks = placed.select("band", "i", "j", "mine", "node", "root", "units").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    more = common.written(verified(pairs, found, threshold).unionAll(blocks.mapInArrow(compare_blocks(threshold), "a long, b long")), "op9-links")
    for done in (found, shared, first, label, rest, pairs):
        common.dropped(spark, done)
    if not more.isEmpty():
        roots = common.components(links.unionAll(more))
    nodes = forms.select("node", "head").join(roots.hint("shuffle_merge"), "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    heads = nodes.groupBy("root").agg(F.min("head").alias("first"))
    nodes = nodes.select("node", "root").join(heads.hint("shuffle_merge"), "root").select("node", "first")
    out = signed.join(nodes.hint("shuffle_merge"), "node", "left").withColumn("k1", k1)
    alone = F.col("first").isNull()
    mine = (F.col("k1") == F.col("first.k1")) & F.col("k2").eqNullSafe(F.col("first.k2")) & (F.col("doc_id").isNull() == F.col("first.nameless"))
    class_id = F.when(alone, F.col("doc_id")).when(~F.col("first.nameless"), F.col("first.k1"))
    return out.select("doc_id", class_id.alias("class_id"), (alone | mine).alias("kept"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all columns, one of each class."""
    names = common.free(docs.columns, "__k1", "__k2")
    kept = classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(*(F.col(k).alias(name) for k, name in zip(("__k1", "__k2"), names))).distinct()
    keys = common.row_keys(F.col(id_col), F.col(text_col).cast("string"))
    rows = docs.withColumns(dict(zip(names, keys)))
    return rows.join(kept.hint("shuffle_merge"), names, "left_semi").dropDuplicates(names).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).drop("__k1", "__k2")
