"""Language-model scores by n-grams with Katz backoff; the order is a parameter, three by default.

P(w | h) is d_r r / c(h) for an n-gram seen r times in training, else a(h) P(w | h') where h' is h without its first word,
down to d_c c / N for a word seen c times, else what is left for unknown words, taken as one type. A context that was
never seen passes its word on to the shorter one. d are Good-Turing discounts for counts up to ``K``, from the counts of
counts of all training text, for each length. a(h) makes the probabilities given h add up to one exactly: the words seen
after h are also seen after h', so all it needs of them are their counts there, which are whole numbers. A text starts
with a start mark and ends with an end, which is a token.

1. Texts are cut to words and written as chunks of local word numbers.
2. Chunks send their words with counts to buckets by hash; a bucket adds up, numbers its words by frequency, and answers
   each chunk. Answers are a table partitioned by the scan partition that the chunk came from.
3. For each length from two on, chunks send their distinct n-grams likewise, to buckets by context, in order of word
   numbers, of which only the steps are written. Left out are those of which a shorter part was never seen. A bucket answers
   with each n-gram's count and, by context, the counts that a(h) needs where a text that wasn't learnt from may back off.
4. Each chunk reads its answers and evaluates its texts token by token, from the word upwards.

N-grams of a chunk are counted before they are sent. A context with more than ``SALTED`` occurrences has its n-grams
spread over several buckets, whose answers are added up, so no bucket grows with a hot context. Buckets grow in number with
the corpus, so a chunk's row for one bucket holds about chunk x bucket / corpus tokens: 30,000 at 0.5 GB, 500 at 30 GB.
Beyond some terabytes ``chunk`` and ``bucket`` should be raised with the executors' memory (about 40 bytes a byte of chunk).
Words are known by 64-bit hashes, contexts by those of their word numbers.

Null and empty texts are an end alone. A null id belongs to the training texts. Repeated rows are counted each.
Without training texts all probabilities are those of the unknown. Only the named columns are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .texts import BLOCK, SOLID, U, Words, blocks, mixed

ORDER = 3
CHUNK = 10 << 20
K = 5
SALTED = 1_000_000
#: Words, or tokens whose n-grams are in a bucket, all chunks' together.
BUCKET = 1_500_000
END = 2
#: Bytes of a number as written: word numbers and counts stay below 2**48.
WIDE = 6
ENCODED = "part int, chunk int, ids array<long>, held array<boolean>, lengths binary, vocab binary, tokens binary, n_vocab long, n_tokens long, n_train long"


def planes(*arrays: np.ndarray, n: int = WIDE) -> bytes:
    """Numbers as n byte planes, lowest first, which compress better than the numbers in a row; arrays stand in turn."""
    parts = [np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes() for a in arrays]
    return pa.compress(b"".join(parts), "zstd", asbytes=True) if any(map(len, parts)) else b""


def unplaned(raw: bytes, *sizes: int, n: int = WIDE) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(raw, n * sum(sizes), "zstd", asbytes=True), np.uint8) if raw else np.zeros(0, np.uint8)
    found, at = [], 0
    for size in sizes:
        out = np.zeros((size, 8), np.uint8)
        out[:, :n] = flat[at : at + n * size].reshape(n, size).T
        found.append(out.view(np.uint64).ravel())
        at += n * size
    return found


def encode(size: int):
    """(doc_id, held, text) to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number
            vocab, tokens, often = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            # frequent words get small numbers
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            vocab, tokens = vocab[order], rank[tokens]
            lengths = np.concatenate([h[2] for h in held])
            ids, flags = [i for h in held for i in h[0]], [f for h in held for f in h[1]]
            row = [[part], [number], [ids], [flags], [planes(lengths)], [vocab.tobytes()], [planes(tokens, n=4)], [len(vocab)], [len(tokens)], [len(flags) - sum(flags)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], [f.split()[0] for f in ENCODED.split(", ")])

        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j, data, off in blocks(batch.column(2), min(size, BLOCK)):
                if total + len(data) > size and held:
                    yield chunk()
                    held, total = [], 0
                words = Words(data, off, SOLID)
                n = np.diff(words.first)
                hashes = np.full(len(words) + j - i, END, np.uint64)
                hashes[np.arange(len(words)) + np.repeat(np.arange(j - i), n)] = np.maximum(words.hashes(), U(3))
                held.append((ids[i:j], flags[i:j], n + 1, hashes))
                total += len(data)
        if held:
            yield chunk()

    return run


class Chunk:
    def __init__(self, row: dict):
        self.part, self.chunk, self.ids = row["part"], row["chunk"], row["ids"]
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.tokens = unplaned(row["tokens"], row["n_tokens"], n=4)[0].astype(np.int32)
        self.lengths = unplaned(row["lengths"], len(self.ids))[0].astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.held = np.array(row["held"], bool)
        self.trained = np.repeat(~self.held, self.lengths)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: value, start, end."""
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(bucket[s]), s, e


ROWS = "bucket int, part int, chunk int, n int, n_first int, data binary"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], NAMES)


def histogram(counts: np.ndarray) -> np.ndarray:
    """Total, types, then the numbers of types seen 1 to K + 1 times."""
    counts = counts.astype(np.int64)
    return np.array([counts.sum(), (counts > 0).sum(), *np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]], np.int64)


def merged(rows: list[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(rows), most):
        yield batch_of(rows[s : s + most])


# --- words ---


def word_order(vocab: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (mixed(vocab) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def ask_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            counts = np.bincount(c.tokens[c.trained], minlength=len(c.vocab))
            order, bucket = word_order(c.vocab, n)
            yield from merged([(b, c.part, c.chunk, e - s, 0, c.vocab[order[s:e]].tobytes() + planes(counts[order[s:e]])) for b, s, e in slices(bucket)])

    return run


def answer_words(n: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]))
        bucket = rows[0]["bucket"]
        words = np.concatenate([np.frombuffer(r["data"], np.uint64, r["n"]) for r in rows])
        local = np.concatenate([unplaned(r["data"][8 * r["n"] :], r["n"])[0] for r in rows])
        names, at = np.unique(words, return_inverse=True)
        counts = np.bincount(at, local, len(names)).astype(np.int64)
        number = np.empty(len(names), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(names)) * n + bucket + 1  # 0 is the start mark
        out, s = [(bucket, -1, -1, 0, 0, histogram(counts).tobytes())], 0
        for r in rows:
            own = at[s : s + r["n"]]
            out.append((bucket, r["part"], r["chunk"], r["n"], 0, planes(counts[own], number[own])))
            s += r["n"]
        return pa.Table.from_batches([batch_of(out)])

    return run


class Answers:
    """A table partitioned by part, of which a worker holds the last part that it read."""

    def __init__(self, where: str):
        self.fs, self.root = pafs.FileSystem.from_uri(where)
        self.part, self.rows = None, []

    def of(self, part: int, chunk: int) -> list[dict]:
        if part != self.part:
            found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/part={part}", allow_not_found=True))
            files = [f.path for f in found if f.base_name.endswith(".parquet")]
            self.rows = [r for f in sorted(files) for r in pq.ParquetFile(self.fs.open_input_file(f)).read().to_pylist()]
            self.part = part
        return sorted((r for r in self.rows if r["chunk"] == chunk), key=lambda r: r["bucket"])


# --- discounts ---


class Discount:
    """Good-Turing discounts of counts from their histogram; 1 where the estimate isn't between 0 and 1."""

    def __init__(self, stats: np.ndarray):
        self.total, self.types, n = int(stats[0]), int(stats[1]), stats[2:].astype(float)
        self.d = np.ones(K + 2)
        over = (K + 1) * n[K] / n[0] if n[0] else 0.0
        for r in range(1, K + 1):
            if n[r - 1] and n[0] and over < 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - over) / (1 - over)
                if 0 < d < 1:
                    self.d[r] = d
        if n[0] and (self.d[1 : K + 1][n[:K] > 0] == 1).all():
            self.d[1] = 0.5  # else nothing would be left for what wasn't seen

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.d[np.minimum(counts, K + 1)]

    def gone(self, few: np.ndarray) -> np.ndarray:
        """What the discounts take from counts of which so many are 1 to K."""
        return (few * (np.arange(1, K + 1) * (1 - self.d[1 : K + 1]))[:, None]).sum(0)


class Unigram:
    def __init__(self, stats: np.ndarray):
        self.discount = Discount(stats)
        self.n, self.types = self.discount.total, self.discount.types
        low = np.arange(1, K + 1)
        gone = float((stats[2 : 2 + K] * low * (1 - self.discount.d[1 : K + 1])).sum())
        # without discounts one more occurrence stands for the unknown
        self.size = self.n if gone else self.n + 1
        self.unknown = (gone or 1.0) / self.size if self.n else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount.of(counts) / max(1, self.size), self.unknown)


# --- n-grams ---


def ordered(key: np.ndarray) -> np.ndarray:
    """The order of numbers that aren't negative; sorting them together with their places is several times faster."""
    bits = max(1, len(key)).bit_length()
    if len(key) and int(key.max()) >> (63 - bits) == 0:
        return np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def stepped(columns: list[np.ndarray], starts: np.ndarray | None = None) -> list[np.ndarray]:
    """Steps of columns of rows in order: a number's distance from the one above where all before it are the same."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    if starts is not None:
        new[starts] = True
    out = []
    for c in columns:
        c = c.astype(np.uint64)
        step = np.diff(c, prepend=U(0))
        out.append(np.where(new, c, step))
        new = new | (step != 0)
    return out


def risen(steps: list[np.ndarray], starts: np.ndarray | None = None) -> list[np.ndarray]:
    """What stepped() was given."""
    n = len(steps[0])
    new = np.zeros(n, bool)
    new[:1] = True
    if starts is not None:
        new[starts] = True
    out = []
    for step in steps:
        total = np.cumsum(step, dtype=np.uint64)
        start = np.flatnonzero(new)
        c = total - np.repeat(total[start] - step[start], np.diff(np.r_[start, n]))
        out.append(c)
        new = new | (np.diff(c, prepend=U(0)) != 0)
    return out


def tuple_hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x51ED270B, np.uint64)
    for c in columns:
        h = mixed(h ^ c.astype(np.uint64)) + U(0x9E3779B97F4A7C15)
    return h


class Level:
    """A chunk's distinct n-grams of one length, of which all shorter parts have been seen: context and last word, the
    shorter n-gram without the first word, training counts here, each token's n-gram and context (-1: none)."""

    def __init__(self, c: Chunk, below: Level | None, start: int):
        n = len(c.tokens)
        self.below = below
        if below is None:
            # the start mark comes last
            self.at, self.context = c.tokens, np.full(n, -1, np.int32)
            self.local = np.r_[np.bincount(c.tokens[c.trained], minlength=len(c.vocab)), start]
            return
        context = np.full(n, -1, np.int64)
        context[1:] = below.at[:-1]
        context[c.first] = len(c.vocab) if below.below is None else -1
        context[context >= 0] = np.where(below.counts[context[context >= 0]] > 0, context[context >= 0], -1)
        self.context = context.astype(np.int32)
        #: Contexts in texts that weren't learnt from: only there can a known context go on in a way that was never seen.
        self.asks = np.zeros(len(below.counts), bool)
        self.asks[context[(context >= 0) & ~c.trained]] = True
        live = np.flatnonzero((context >= 0) & (below.at >= 0))
        live = live[below.counts[below.at[live]] > 0]
        key = context[live] * (len(c.vocab) + 1) + c.tokens[live]
        order = ordered(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        key = key[new]
        self.prefix, self.last = (key // (len(c.vocab) + 1)).astype(np.int32), (key % (len(c.vocab) + 1)).astype(np.int32)
        self.at = np.full(n, -1, np.int32)
        self.at[live] = place
        self.suffix = np.empty(len(key), np.int32)
        self.suffix[place] = below.at[live]
        self.local = np.bincount(place[c.trained[live]], minlength=len(key))

    def words(self, own: np.ndarray) -> list[np.ndarray]:
        """The words of n-grams, by place."""
        return [own] if self.below is None else [*self.below.words(self.prefix[own]), self.last[own]]

    def parcels(self, numbers: np.ndarray, n: int, salted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """What is sent: bucket, contexts, numbers of n-grams of each, n-grams; contexts and n-grams in order."""
        below, size = self.below, len(numbers)
        word = np.empty(size, np.int64)
        word[np.argsort(numbers, kind="stable")] = np.arange(size)
        used = np.zeros(len(below.counts), bool)
        used[self.context[self.context >= 0]] = True  # also contexts with which no seen n-gram goes on here
        who = np.flatnonzero(used)
        ids = below.words(who)
        key = word[ids[0]]
        for x in ids[1:]:
            key = np.unique(key, return_inverse=True)[1] * size + word[x]
        order = ordered(key)
        who, n_who = who[order], max(1, len(who))
        rank = np.zeros(len(below.counts), np.int64)
        rank[who] = np.arange(len(who))
        ids = [x[order] for x in ids]
        # contexts with one first word go together, so their steps are small; a hot first word's are spread
        single = self
        while single.below is not None:
            single = single.below
        spread = (single.counts[ids[0]] // salted + 1).astype(np.uint64)
        hashes = mixed(numbers[ids[0]] + U(1)) + (tuple_hashes([numbers[x] for x in ids[1:]]) % spread if len(ids) > 1 else U(0))
        parts = below.counts[who] // salted + 1
        place = lambda r, salt: (mixed(hashes[r] + salt.astype(np.uint64) * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
        # a context asks all buckets that its n-grams may be in, with n-grams there or not
        asked = np.repeat(np.arange(len(who)), parts)
        salt = np.arange(len(asked)) - np.repeat(np.cumsum(parts) - parts, parts)
        entry = np.unique(place(asked, salt) * n_who + asked)
        at = np.zeros(n_who, np.int64)
        at[entry % n_who] = np.arange(len(entry))
        first = rank[self.prefix]
        own = at[first]
        hot = np.flatnonzero(parts[first] > 1) if len(first) else first
        if len(hot):
            salt = mixed(numbers[self.last[hot]]) % parts[first[hot]].astype(np.uint64)
            own[hot] = np.searchsorted(entry, place(first[hot], salt) * n_who + first[hot])
        sent = ordered(own * size + word[self.last])
        sizes = np.bincount(own, minlength=len(entry))
        upto = np.r_[0, np.cumsum(sizes)]
        for b, s, e in slices(entry // n_who):
            yield b, who[entry[s:e] % n_who], sizes[s:e], sent[upto[s] : upto[e]]


def levels(c: Chunk, answers: list[Answers], n_words: int, n_grams: int, start: int, salted: int, discounts: list[Discount] | None = None) -> tuple[list[Level], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The levels for which there are answers; word numbers; and if discounts are given, for the contexts of each level
    from the second on what discounts take from their n-grams' counts, the discounted sum of the shorter ones', both where
    asked for only, and whether discounts take anything."""
    found = [Level(c, None, start)]
    order, _ = word_order(c.vocab, n_words)
    rows = answers[0].of(c.part, c.chunk)
    told, number = (np.concatenate(x) for x in zip(*(unplaned(r["data"], r["n"], r["n"]) for r in rows)))
    counts, numbers = np.empty(len(c.vocab), np.int64), np.zeros(len(c.vocab) + 1, np.uint64)
    counts[order], numbers[order] = told, number
    found[0].counts = np.r_[counts, start]
    needs = []
    for length, own in enumerate(answers[1:], 1):
        level = Level(c, found[-1], start)
        level.counts = np.zeros(len(level.prefix), np.int64)
        n = len(level.below.counts)
        gone, mass, cut = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        if discounts:
            here, shorter = discounts[length], discounts[length - 1]
            discounted = U(sum(1 << r for r in range(K) if here.d[r + 1] < 1))
            needs.append((gone, mass, cut))
        rows = {r["bucket"]: r for r in own.of(c.part, c.chunk)}
        for b, who, _, grams in level.parcels(numbers, n_grams, salted):
            asks = who[level.asks[who]]
            told, kinds, more = unplaned(rows[b]["data"], len(grams), len(who), (2 * K + 1) * len(asks))
            level.counts[grams] = told
            if discounts:
                more = more.astype(np.int64).reshape(2 * K + 1, -1)
                gone[asks] += here.gone(more[:K])
                mass[asks] += more[K] - shorter.gone(more[K + 1 :])
                cut[who] |= (kinds & discounted) > 0
        found.append(level)
    return found, numbers, needs


def tallied(owner: np.ndarray, counts: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """Of seen n-grams by context: how many have each count from 1 to K, the sum of the shorter n-grams' counts, and how
    many of these are each from 1 to K."""
    of = lambda x: [np.bincount(owner[x == r], minlength=n) for r in range(1, K + 1)]
    total = np.zeros(n, np.int64)
    np.add.at(total, owner, lower)
    return np.stack([*of(counts), total, *of(lower)]).astype(np.int64)


def ask_grams(wheres: list[str], n_words: int, n_grams: int, start: int, salted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [Answers(w) for w in wheres]
        for c in chunks(batches):
            found, numbers, _ = levels(c, answers, n_words, n_grams, start, salted)
            level = Level(c, found[-1], start)
            lower = level.below.counts[level.suffix]
            rows: list[tuple] = []
            for b, who, size, grams in level.parcels(numbers, n_grams, salted):
                starts = (np.cumsum(size) - size)[size > 0]
                columns = stepped([numbers[x] for x in level.below.words(who)])
                (step,) = stepped([numbers[level.last[grams]]], starts)
                rows.append((b, c.part, c.chunk, len(grams), len(who), planes(*columns, 2 * size + level.asks[who], step, level.local[grams], lower[grams])))
                if len(rows) >= 64:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)
            del found, level, rows
            common.trimmed()

    return run


def answer_grams(length: int):
    """Answers to n-grams with contexts of so many words."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["bucket", "part", "chunk", "n", "n_first", "data"]).to_pylist(), key=lambda r: (r["part"], r["chunk"]))
        bucket = rows[0]["bucket"]
        first, size, last, local, lower = [], [], [], [], []
        for r in rows:
            *columns, sizes, step, here, below = unplaned(r.pop("data"), *[r["n_first"]] * (length + 1), *[r["n"]] * 3)
            r["asks"], sizes = np.flatnonzero(sizes & U(1)), (sizes >> U(1)).astype(np.int64)
            first.append(tuple_hashes(risen(columns)))
            last.append(risen([step], (np.cumsum(sizes) - sizes)[sizes > 0])[0])
            for x, y in ((size, sizes), (local, here), (lower, below)):
                x.append(y)
        names, name = np.unique(np.concatenate(first), return_inverse=True)
        owner = np.repeat(name, np.concatenate(size)).astype(np.int32)
        key = mixed(names[owner]) + mixed(np.concatenate(last))
        del last, first
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        at = order[new]
        gram = np.empty(len(key), np.int32)
        gram[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.r_[new, len(key)]))
        del key, order
        counts = np.bincount(gram, np.concatenate(local), len(at)).astype(np.int64)
        seen = counts > 0
        need = tallied(owner[at[seen]], counts[seen], np.concatenate(lower)[at[seen]].astype(np.int64), len(names))
        kinds = ((need[:K] > 0) << np.arange(K)[:, None]).sum(0)  # which of the counts 1 to K there are
        out, s, t = [(bucket, -1, -1, 0, 0, histogram(counts).tobytes())], 0, 0
        for r in rows:
            own = name[t : t + r["n_first"]]
            out.append((bucket, r["part"], r["chunk"], r["n"], r["n_first"], planes(counts[gram[s : s + r["n"]]], kinds[own], need[:, own[r["asks"]]].ravel())))
            s, t = s + r["n"], t + r["n_first"]
        common.trimmed()
        return pa.Table.from_batches([batch_of(out)])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def evaluate(wheres: list[str], n_words: int, n_grams: int, start: int, salted: int, stats: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [Answers(w) for w in wheres]
        unigram, *discounts = Unigram(np.frombuffer(stats[0], np.int64)), *(Discount(np.frombuffer(s, np.int64)) for s in stats[1:])
        for c in chunks(batches):
            found, _, needs = levels(c, answers, n_words, n_grams, start, salted, [unigram.discount, *discounts])
            counts = found[0].counts[:-1]
            chance, shorter_size = unigram.p(counts)[c.tokens], np.full(1, unigram.size)
            for level, (gone, mass, cut), discount in zip(found[1:], needs, discounts):
                total = level.below.counts  # c(h)
                size = np.where(cut, total, total + 1)  # without discounts one more occurrence stands for the unseen
                shorter = 0 if level.below.below is None else level.below.suffix
                with np.errstate(divide="ignore", invalid="ignore"):
                    back = np.where(total > 0, (1 - (total - gone) / size) / (1 - mass / shorter_size[shorter]), 1.0)
                seen = np.zeros(len(c.tokens), np.int64)
                seen[level.at >= 0] = level.counts[level.at[level.at >= 0]]
                # of no known context: as with the shorter one; a chunk may have no context at all
                known = np.flatnonzero(level.context >= 0)
                context, often = level.context[known], seen[known]
                chance[known] = np.where(often > 0, discount.of(often) / size[context], back[context] * chance[known])
                shorter_size = size
            logs = np.log10(np.maximum(chance, 1e-300))
            base = np.log10((counts + 1) / (unigram.n + unigram.types + 1))
            columns = [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(np.add.reduceat((counts > 0)[c.tokens].astype(np.int64), c.first)), pa.array(np.full(len(c.ids), unigram.n)), pa.array(np.add.reduceat(base[c.tokens], c.first)), pa.array(np.add.reduceat(logs, c.first))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])
            del found, needs
            common.trimmed()

    return run


def partitioned(rows: DataFrame, label: str) -> tuple[str, np.ndarray]:
    """Write answers by part; returns the folder and the sum of the histograms."""
    spark = rows.sparkSession
    where = common.new_path(spark, label)
    # the rows of one part are written by one task
    rows.repartition("part").write.option("compression", "none").partitionBy("part").parquet(where)
    sums = spark.read.schema(rows.schema).parquet(where).where("part = -1").select("data").mapInArrow(add_up, "v array<long>").collect()  # a row a task
    return where, np.sum([r.v for r in sums], axis=0, dtype=np.int64) if sums else np.zeros(K + 3, np.int64)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(K + 3, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(raw, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["v"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame, held: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET, salted: int = SALTED) -> DataFrame:
    """Per row of docs the columns of SCORES; rows for which held is true aren't learnt from."""
    if order < 1:
        raise ValueError("the order is at least 1")
    spark = common.tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    coded = common.written(source.mapInArrow(encode(chunk), ENCODED), "op5-chunks")
    size = coded.agg(F.sum("n_vocab"), F.sum("n_tokens"), F.sum("n_train")).first()
    n_words, n_grams = (max(1, math.ceil((x or 0) / bucket)) for x in size[:2])
    given = n_words, n_grams, size[2] or 0, salted
    where, stats = partitioned(coded.mapInArrow(ask_words(n_words), ROWS).groupBy("bucket").applyInArrow(answer_words(n_words), ROWS), "op5-words")
    wheres, found = [where], [stats.tobytes()]
    for length in range(1, order):
        asked = coded.mapInArrow(ask_grams(wheres, *given), ROWS)
        where, stats = partitioned(asked.groupBy("bucket").applyInArrow(answer_grams(length), ROWS), f"op5-{length + 1}-grams")
        wheres, found = [*wheres, where], [*found, stats.tobytes()]
    out = common.written(coded.mapInArrow(evaluate(wheres, *given, found), SCORES), "op5-scores")
    for done in (*wheres, coded):
        common.dropped(spark, done)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
