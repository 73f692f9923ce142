"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction with a cap round it. Vectors are first turned by a fixed random rotation, so that recall does
not depend on how they spread over the coordinates (without it, it was 0.15 to 0.66 in the tests' vectors of zeros in half
of them). The directions are a product code: each part of the turned coordinates has random unit codewords, and every
combination is a direction, whose inner product with a vector is the sum of the parts' products. A vector is list-decoded
to all filters that exceed its cap's inner product, which is set so that a fixed number do: lists of the parts' best
codewords are merged, and only ranks whose product is at most that number can be among the best sums. A cap of one inner
product for all vectors was tried: the lists' lengths then vary so much (most are empty, some hold over a thousand) that
recall was 0.04 in the supplied tables; with caps set by the list it is 1.0 there. Vectors of one label that share a filter
are compared by cosine in double precision.

The code grows with the vectors (``size_of_code``), so that a filter holds about one vector by chance at any size: two parts
of 1,024 codewords up to 65,536 vectors, three parts beyond. Of random pairs at exactly 0.98 these filters find 0.999 or
more (tests measure it for each size of the code).

Equal vectors of a label are one node with a multiplicity. Filters with one node are dropped before any vector moves.
The nodes of a filter are compared as blocks of matrices of at most about ``UNIT`` rows; a crowded filter is split into
pairs of blocks, each a task's unit, so no group is gathered whole and no pairs are written: a unit counts the links of
its nodes (a pair counts in the least filter that both share) and gives each node's root within the unit. Roots are then
united into components.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing; the
others are compared with those of their own length. Rows with a null vec_id count as vectors; a component of such rows only has the id null.
Repeated rows are vectors of their own. An empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .texts import U, mixed

COSINE = 0.98
UNIT = 1024
#: Rows of small units that are compared together.
JOINT = 512
SEED = 71


def size_of_code(n: int) -> tuple[int, int, int]:
    """Parts, codewords a part, and filters a vector, for n vectors: at least as many filters as vectors are listed in."""
    parts, least, listed = (2, 1 << 10, 16) if n <= 1 << 16 else (3, 1 << 8, 32)
    bits = max(least.bit_length() - 1, -(-(max(1, n) * listed - 1).bit_length() // parts))
    return parts, 1 << min(bits, 13), listed


class Code:
    """A product code for vectors of d coordinates; of fewer parts where they would have fewer than eight each."""

    def __init__(self, d: int, size: tuple[int, int, int]):
        rng = np.random.Generator(np.random.PCG64(SEED))
        parts, self.codes, self.listed = size
        self.parts, self.words = np.array_split(np.arange(d), min(parts, max(1, d // 8))), []
        for part in self.parts:
            words = rng.standard_normal((self.codes, len(part)))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True))
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        self.turn = q * np.sign(np.diag(r))

    def best(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest of each row, in falling order, and their places."""
        n = min(self.listed, values.shape[1])
        at = np.argpartition(-values, n - 1, 1)[:, :n]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(values, at, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(values, at, 1), at

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The filters of unit vectors x, by row."""
        x = x @ self.turn
        total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for part, words in zip(self.parts, self.words):
            value, word = self.best(x[:, part] @ words.T)
            ranks = [(i, j) for i in range(total.shape[1]) for j in range(value.shape[1]) if (i + 1) * (j + 1) <= self.listed]
            a, b = np.array(ranks).T
            total, at = self.best(total[:, a] + value[:, b])
            code = np.take_along_axis(code[:, a] * self.codes + word[:, b], at, 1)
        return code


@lru_cache(8)
def code_for(d: int, size: tuple[int, int, int]) -> Code:
    return Code(d, size)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The vectors of a list column of float64, by length: their places, the vectors as rows, and which are to compare."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    off = column.offsets.to_numpy()
    length = np.where(valid, np.diff(off), 0)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        x = flat[off[at][:, None] + np.arange(size)]
        ok = valid[at] & np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
        yield at, x, ok


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v) to (vec_id, node or null, v as the bytes of a unit vector)."""
    for batch in batches:
        labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        label = batch.column(1).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
        node, use, rows = np.zeros(len(label), np.uint64), np.zeros(len(label), bool), [None] * len(label)
        for at, x, ok in matrices(batch.column(2)):
            at, x = at[ok & labelled[at]], x[ok & labelled[at]]
            bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
            h = mixed(label[at] + U(x.shape[1]))
            for i in range(bits.shape[1]):
                h = mixed(h ^ bits[:, i]) + U(i)
            node[at], use[at] = h, True
            for i, r in zip(at.tolist(), unit_rows(x) if len(x) else ()):
                rows[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.view(np.int64), mask=~use), batch.column(1), pa.array(rows, pa.binary())], ["vec_id", "node", "label", "v"])


def filters(code_size: tuple[int, int, int]):
    """(node, label, v) to (node, bucket): a bucket is a filter of a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            label = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                for s in range(0, len(own), 512):
                    part = own[s : s + 512]
                    x = np.frombuffer(b"".join(raw[i] for i in part), np.float64).reshape(len(part), -1)
                    code = code_for(size // 8, code_size).decode(x)
                    row = np.repeat(part, code.shape[1])
                    bucket = mixed(mixed(label[row] + U(size)) ^ code.ravel().astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(bucket.view(np.int64))], ["node", "bucket"])

    return run


def compare(least: float):
    """Rows (bucket, i, j, mine, node, copies, buckets, v), sorted by unit, to (node, links, root)."""

    def solve(rows: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
        """Whole units together; unit: the number of each row's."""
        n = rows.num_rows
        bucket, i, j, mine, node, copies = (rows.column(c).to_numpy() for c in range(6))
        lists, raw = rows.column(6).combine_chunks(), rows.column(7).to_pylist()
        sizes = np.array([len(r) for r in raw])
        near = np.zeros((n, n), bool)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join([raw[k] for k in own]), np.float64).reshape(len(own), -1)
            near[np.ix_(own, own)] = x @ x.T >= least
        near &= unit[:, None] == unit[None, :]
        np.fill_diagonal(near, False)
        # pairs that share a lesser bucket are counted there
        off = lists.offsets.to_numpy()
        owner, other = np.repeat(np.arange(n), np.diff(off)), lists.values.to_numpy()[off[0] : off[-1]]
        lesser = other < bucket[owner]
        owner, other = owner[lesser], other[lesser]
        _, name, often = np.unique(mixed(other.view(np.uint64) ^ mixed(unit[owner].astype(np.uint64) + U(1))), return_inverse=True, return_counts=True)
        owner, name = owner[often[name] > 1], (np.cumsum(often > 1) - 1)[name[often[name] > 1]]
        member = np.zeros((n, int((often > 1).sum())), np.float32)
        member[owner, name] = 1
        counted = near & ~(member @ member.T > 0)
        counted &= ~((i != j)[:, None] & (mine[:, None] == mine[None, :]))
        links = counted @ copies
        root = np.arange(n)
        while True:  # the least place reachable
            new = np.minimum(root, np.where(near, root[None, :], n).min(1, initial=n))
            new = new[new]
            if (new == root).all():
                break
            root = new
        use = (links > 0) | (root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(links[use].astype(np.int64)), pa.array(node[root[use]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def whole(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """The results of all whole units, and the rows of the one that may go on."""
            key = np.stack([rows.column(c).to_numpy() for c in range(3)])
            unit = np.cumsum(np.r_[0, (key[:, 1:] != key[:, :-1]).any(0)]) if rows.num_rows else np.zeros(0, int)
            edge = np.flatnonzero(np.r_[True, np.diff(unit) > 0, True]) if len(unit) else np.zeros(1, int)
            done, out, ends = 0, [], edge[1:] if last else edge[1:-1]
            for k, end in enumerate(ends.tolist()):
                if k + 1 == len(ends) or ends[k + 1] - done > JOINT:
                    if end - done > 1:
                        out.append(solve(rows.slice(done, end - done), unit[done:end]))
                    done = end
            return out, rows.slice(done)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= 2 * JOINT:
                out, held = whole(held, False)
                yield from out
        if held is not None:
            yield from whole(held, True)[0]

    return run


def near(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, code: tuple[int, int, int] | None = None, unit: int = UNIT) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept. The code is sized by the distinct vectors, if not given."""
    common.tuned(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = common.written(source.mapInArrow(prepare, "vec_id long, node long, label long, v binary"), "op10-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = common.written(nodes, "op10-nodes")
    member = nodes.select("node", "label", "v").mapInArrow(filters(code or size_of_code(nodes.count())), "node long, bucket long")
    crowd = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = common.written(member.join(crowd.hint("shuffle_merge"), "bucket"), "op10-members")
    lists = shared.groupBy("node").agg(F.collect_list(F.struct("bucket", "m")).alias("b"))
    parts = F.ceil(F.col("m") / unit).cast("int")
    full = nodes.select("node", "copies", "v").join(lists, "node").select("node", "copies", "v", F.transform("b", lambda x: x["bucket"]).alias("buckets"), F.inline("b"))
    block = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    full = full.withColumn("p", parts).withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    # a unit of two blocks holds either's rows; one of a single block serves the pairs within it
    units = full.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "buckets", "v")
    found = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(compare(cosine), "node long, links long, root long")
    found = common.written(found, "op10-links")
    common.dropped(vectors.sparkSession, shared)
    roots = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = whole.join(named, "root").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(whole.hint("shuffle_merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.x
"""
