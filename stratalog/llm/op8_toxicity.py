"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - weights . x), with one weight vector for all thresholds. x holds log(1 + count) of
words that tell toxic documents apart in the sample. The table of labels has no grades, so a toxic document is graded
by how many of its words are such words: 1 up to the median of toxic documents, 2 above it. A document's severity is
the expected grade; it is toxic if P(grade >= 1) reaches ``CUT``.

The model learns from at most ``SAMPLE`` labelled documents, those with the least hashes of their ids. Their words are
counted by the cluster; the at most ``FEATURES`` words that tell best are features, so what the driver fits on is at most
that many counts a document. A word needs ``LEAST`` documents at any size of the sample; texts of equal words count once,
toxic if any of them is. Scoring reads each text in place.

Labels with a null id or null toxic are left out; an id with several labels takes the highest. Without labels of both
kinds no weights are fitted and nothing is toxic. A null or wordless text has no features. Repeated rows score alike.
Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .texts import WORD, Rolling, Words, blocks

SAMPLE = 20_000
FEATURES = 4_000
GRADES = 3
CUT = 0.5
#: A feature is in at least so many documents of the sample, and so far from its expected share of toxic ones.
LEAST, Z = 5, 5.0
RIDGE, STEPS = 2e-4, 400


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def scores(self, n: int, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        """weights . x of n texts, given the words of each."""
        if not len(self.words) or not len(word):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        pair, count = np.unique(owner[hit] * len(self.words) + at[hit], return_counts=True)
        return np.bincount(pair // len(self.words), np.log1p(count) * self.weights[pair % len(self.words)], n)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, by column."""
        return 1 - sigmoid(self.thresholds[None, :] - scores[:, None])


def nothing() -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0] * (GRADES - 1)))


def fit(words: np.ndarray, telling: np.ndarray, toxic: np.ndarray, owner: np.ndarray, column: np.ndarray, count: np.ndarray) -> Model:
    """words: the features' hashes, in order, and which tell toxic documents; toxic: a label a document; then the counts
    of features in documents, by document and feature."""
    n = len(toxic)
    if not n or toxic.all() or not toxic.any() or not len(words):
        return nothing()
    x = np.log1p(count)
    hits = np.bincount(owner, telling[column] * count, n)
    median = np.median(hits[(toxic > 0) & (hits > 0)]) if ((toxic > 0) & (hits > 0)).any() else 0
    grade = toxic.astype(int) + ((toxic > 0) & (hits > median))
    used = [k for k in range(1, GRADES) if (grade >= k).any()]
    w, cut = np.zeros(len(words)), np.array([np.log((grade < k).mean() / (grade >= k).mean()) for k in used])
    m, v, lr = np.zeros(len(w) + len(cut)), np.zeros(len(w) + len(cut)), 0.1
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, x * w[column], n)
        _, dscore, gc = loss(score, cut, np.searchsorted(np.array(used), grade, "right"))
        g = np.concatenate([np.bincount(column, x * dscore[owner], len(w)) + RIDGE * w, gc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        cut = np.maximum.accumulate(cut - move[len(w) :])
        lr *= 0.995
    thresholds = np.full(GRADES - 1, 40.0)
    thresholds[[k - 1 for k in used]] = cut
    return Model(words, w, np.maximum.accumulate(thresholds))


def loss(score: np.ndarray, cut: np.ndarray, level: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of levels, and its gradients by score and by threshold.

    The likelihood of level g is P(<= g) - P(<= g - 1); at an end the term is 1 or 0."""
    n = len(score)
    edges = np.concatenate([np.full((n, 1), 0.0), sigmoid(cut[None, :] - score[:, None]), np.full((n, 1), 1.0)], 1)
    hi, lo = edges[np.arange(n), level + 1], edges[np.arange(n), level]
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_cut = np.array([-(dhi[level == k].sum() - dlo[level == k + 1].sum()) / n for k in range(len(cut))])
    return float(-np.log(p).mean()), (dhi - dlo) / n, by_cut


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, toxic, text) to (form, order, toxic, words, counts): a hash of all words in turn, distinct words' hashes."""
    for batch in batches:
        for i, j, data, off in blocks(batch.column(2)):
            words = Words(data, off, WORD)
            hashes = words.hashes()
            form = Rolling(hashes)(words.first[:-1], words.first[1:])
            found = [np.unique(hashes[s:e], return_counts=True) for s, e in zip(words.first[:-1], words.first[1:])]
            lists = [pa.array([x[k].view(np.int64).tolist() for x in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(form.view(np.int64)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], ["form", "order", "toxic", "words", "counts"])


def model_of(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    spark = common.tuned(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.select("id", "toxic", F.xxhash64("id").alias("order")).orderBy("order", "id").limit(sample)  # at most SAMPLE rows of 24 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("order", "toxic", "text")
    # an id may have many rows: of texts of equal words one stays
    forms = texts.mapInArrow(word_counts, "form long, order long, toxic int, words array<long>, counts array<long>").groupBy("form").agg(F.max("toxic").alias("toxic"), F.min("order").alias("order"), F.first("words").alias("words"), F.first("counts").alias("counts"))
    forms = common.written(forms.where(F.size("words") > 0), "op8-words")
    n, bad = forms.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not bad or bad == n:
        return nothing()
    share = bad / n
    df = forms.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("bad"))
    z = (F.col("bad") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)))
    # words that occur in a handful of documents only tell those apart; copies with small changes make many of them
    best = df.where(F.col("df") >= LEAST).select("word", z.alias("z")).where(F.abs("z") >= Z).orderBy(F.abs("z").desc(), "word").limit(FEATURES)
    best = sorted((r.word & (2**64 - 1), r.z) for r in best.collect())
    words = np.array([w for w, _ in best], np.uint64)
    if not len(words):
        return nothing()
    picked = F.broadcast(spark.createDataFrame([(int(w), k) for k, w in enumerate(words.view(np.int64))], "word long, k int"))
    flat = forms.select("form", "order", "toxic", F.explode(F.arrays_zip("words", "counts")).alias("w")).join(picked, F.col("w.words") == F.col("word"))
    kept = flat.groupBy("form").agg(F.collect_list(F.struct("k", F.col("w.counts").alias("n"))).alias("own"))
    rows = forms.select("form", "order", "toxic").join(kept, "form", "left").orderBy("order", "form").collect()  # at most SAMPLE, of FEATURES counts each
    common.dropped(spark, forms)
    own = [sorted((x.k, x.n) for x in r.own or ()) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in own])
    flat_counts = np.array([x for r in own for x in r], np.int64).reshape(-1, 2)
    return fit(words, np.array([z > 0 for _, z in best]), np.array([r.toxic for r in rows], float), owner, flat_counts[:, 0], flat_counts[:, 1])


def grade(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Per row of docs: doc_id, severity, p_toxic, grade (the likeliest), toxic."""
    spark = common.tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.words, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text")):
                above = own.above(block_scores(own, data, off))
                edges = np.concatenate([np.ones((j - i, 1)), above, np.zeros((j - i, 1))], 1)
                likeliest = np.argmax(edges[:, :-1] - edges[:, 1:], 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(likeliest, pa.int64()), pa.array(above[:, 0] >= cut)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade long, toxic boolean")


def block_scores(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    words = Words(data, off, WORD)
    return model.scores(len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(words.first)), words.hashes())


def harmless(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, with all columns, that are not toxic."""
    spark = common.tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.words, model.weights, model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            parts = [own.above(block_scores(own, data, off))[:, 0] < cut for _, _, data, off in blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return grade(docs, model_of(docs, common.table(spark, sf_dir, "labels")))
