"""SentencePiece encoding and decoding as a max-plus scan.

A text's encoding is the sequence of pieces with the greatest sum of the vocabulary's scores (the unigram criterion; a
BPE vocabulary's scores are its ranks), characters without a piece becoming byte pieces. In max-plus algebra a stretch
of text is a matrix from states to states, a state being how far the piece that crosses a boundary reaches over it, and
stretches combine by matrix products. Long texts are cut to chunks of about ``CHUNK`` characters, each a row of its own:

1. every chunk gives its boundary-state transfer matrix,
2. a text's matrices are combined by an associative prefix scan, which yields the best score of each state at each
   boundary,
3. every chunk traces back from each of its exit states, given its entry states' scores, to the entry state it comes from;
   these maps, composed from the end, give the state at each boundary,
4. every chunk is traced back by itself from its exit state.

Step 3 makes ties fall as they do without chunks: ids don't depend on ``chunk``. It is left out where a boundary has one state.

No piece reaches from a word into the blank after it, so the path passes the start of every run of blanks: chunks end
there if they can and have one state then, and the inner words of any text are looked up in a bounded memo.
A chunk without any blank gets the full matrix, however long the text.

Encoding and decoding return every text unchanged: a literal U+2581 becomes bytes, blanks and line ends are kept.
Null is encoded as no pieces, as is an empty text. Equal sums choose the longest last piece. Repeated rows are encoded
alike; texts over a chunk meet by (id, text) while they are put together, repeated ones as one text. Other columns are
not looked at, but those named in ``keep`` are passed on.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
#: Words of up to 48 characters that a worker remembers.
MEMO = 400_000
LOW = -(1 << 60)
BLANK = "▁"


class Pieces(dict):
    """A vocabulary; as a mapping, a memo from words to their ids as little-endian 16-bit numbers."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        if m.vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits are too short for this vocabulary")
        self.table: list[bytes] = []
        self.byte = [0] * 256
        self.best: dict[str, tuple[int, int]] = {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.table.append(b"")
            elif m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            else:
                self.table.append(piece.replace(BLANK, " ").encode())
                self.best[piece] = (round(m.get_score(i)), i)
        self.starts = {p[:n] for p in self.best for n in range(1, len(p) + 1)}
        self.longest = max(map(len, self.best))
        # runs of blanks have no score of their own in a BPE vocabulary: they take the least one
        least = min(s for s, _ in self.best.values() if s > -(10**8))
        self.best = {p: (max(s, least), i) for p, (s, i) in self.best.items()}
        self.unknown = least - 10
        #: Whether every piece holds blanks at its start only, and no line ends or tabs beside others.
        self.parted = not any(BLANK in p.lstrip(BLANK) or len(p) > 1 and re.search("[\n\t]", p) for p in self.best)
        self.units = re.compile(" *[^ ▁\n\t]+| +|[▁\n\t]")
        # the library's own search for the best path, for words: their sums of scores are below 2**24, so exact
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
        spec = proto.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        for piece in proto.pieces:
            piece.score = max(piece.score, least)
        self.fast = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def arcs(self, text: str, at: int) -> list[tuple[int, int, bytes]]:
        """The pieces that start there: end, score, ids. In text a blank is U+2581 and a literal U+2581 is a blank."""
        found = []
        end = at + 1
        while end <= len(text) and text[at:end] in self.starts:
            hit = self.best.get(text[at:end])
            if hit:
                found.append((end, hit[0], hit[1]))
            end += 1
        if not found or found[0][0] != at + 1:
            found.append((at + 1, self.unknown, -1))
        return found

    def ids(self, text: str, start: int, piece: int) -> bytes:
        if piece >= 0:
            return piece.to_bytes(2, "little")
        char = text[start]
        return b"".join(self.byte[b].to_bytes(2, "little") for b in (BLANK if char == " " else char).encode())

    def path(self, text: str) -> tuple[int, bytes]:
        """The best path over all of text, in which blanks are U+2581: its score and ids."""
        n = len(text)
        score, back = [LOW] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0
        for at in range(n):
            here = score[at]
            if here == LOW:
                continue
            for end, s, piece in self.arcs(text, at):
                if here + s > score[end]:
                    score[end], back[end] = here + s, (at, piece)
        out, at = [], n
        while at:
            start, piece = back[at]
            out.append(self.ids(text, start, piece))
            at = start
        return score[n], b"".join(reversed(out))

    def __missing__(self, unit: str) -> bytes:
        ids = self.path(swapped(unit))[1]
        if len(unit) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.parted:
            return self.path(swapped(" " + text))[1]
        return b"".join(map(self.__getitem__, self.units.findall(" " + text)))

    def learn(self, units: set[str]) -> None:
        """Put words into the memo together."""
        new = [u for u in units - self.keys() if len(u) <= 48 and BLANK not in u]
        if len(self) + len(new) > MEMO:
            self.clear()
        for u, ids in zip(new, self.fast.encode([u.replace(" ", BLANK) for u in new], num_threads=1)):
            self[u] = array("H", ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.parted:
            return [self.encode(t) if t else b"" for t in texts]
        out: list[bytes] = []
        for s in range(0, len(texts), 128):
            lists = [self.units.findall(" " + t) if t else [] for t in texts[s : s + 128]]
            self.learn(set().union(*lists))
            out += [b"".join(map(self.__getitem__, units)) for units in lists]
        return out

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return out[1:].decode("utf-8", "replace")

    def cuts(self, text: str, size: int) -> list[tuple[int, int]]:
        """Chunk starts, and the number of states there: 1 before a run of blanks, else as many as a piece may reach."""
        out, at = [(0, 1)], 0
        while len(text) - at > size:
            near = text[at + size // 2 : at + size]
            found = re.search(" +[^ ]*$", near) if self.parted else None
            if found and (found.start() or text[at + size // 2 - 1] != " "):
                at += size // 2 + found.start()
                out.append((at, 1))
            else:
                at += size
                out.append((at, self.longest))
        return out

    def forward(self, text: str, body: int, entry: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """Best scores at every place, a column a column of entry (scores of the entry states); how each place of the first
        column is reached best, if not by an entry. Places at body or later are exits and have no arcs."""
        score = np.full((body + self.longest + 1, entry.shape[1]), LOW, np.int64)
        score[: len(entry)] = entry
        back = {}
        for at in range(body):
            here = score[at]
            if not (here > LOW // 2).any():
                continue
            for end, s, piece in self.arcs(text, at):
                new = here + s
                better = (new > score[end]) & (here > LOW // 2)
                if better.any():
                    score[end] = np.where(better, new, score[end])
                    if better[0]:
                        back[end] = (at, piece)
        return score, back

    def transfer(self, text: str, body: int, states: int, exits: int) -> np.ndarray:
        """The max-plus matrix of a chunk: text's first body characters, followed by what pieces may reach into."""
        entry = np.full((states, states), LOW, np.int64)
        np.fill_diagonal(entry, 0)
        score, _ = self.forward(text, body, entry)
        out = score[body : body + exits].T.copy()
        out[out < LOW // 2] = LOW
        return out

    def trace(self, text: str, body: int, entry: list[int], leave: int) -> tuple[int, bytes]:
        """The entry state that the best path to an exit state comes from, given the entry states' scores, and its ids."""
        _, back = self.forward(text, body, np.array(entry, np.int64)[:, None])
        out, at = [], body + leave
        while at in back:
            start, piece = back[at]
            out.append(self.ids(text, start, piece))
            at = start
        return at, b"".join(reversed(out))

    def entries(self, text: str, body: int, entry: list[int], exits: int) -> list[int]:
        """trace()'s entry state for each exit state; -1 for one that no path reaches."""
        score, back = self.forward(text, body, np.array(entry, np.int64)[:, None])
        out = []
        for at in range(body, body + exits):
            if score[at, 0] <= LOW // 2:
                out.append(-1)
                continue
            while at in back:
                at = back[at][0]
            out.append(at)
        return out


def swapped(text: str) -> str:
    return text.translate({0x20: BLANK, 0x2581: " "})


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix products of stacks of matrices."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(-2)
    return np.maximum(out, LOW)


def prefixes(matrices: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of square matrices, in about log2 steps."""
    step, out = 1, matrices.copy()
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def entry_scores(matrices: list[np.ndarray]) -> list[list[int]]:
    """The best score of each entry state of each chunk over all of the text before it; the greatest is 0."""
    width = max(max(m.shape) for m in matrices)
    stack = np.full((len(matrices), width, width), LOW, np.int64)
    for at, m in enumerate(matrices):
        stack[at, : m.shape[0], : m.shape[1]] = m
    upto = prefixes(stack)
    out = [[0]]
    for at in range(1, len(matrices)):
        v = upto[at - 1][0][: matrices[at].shape[0]]
        out.append(np.where(v > LOW // 2, v - v.max(), LOW).tolist())
    return out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_loaded: dict[int, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, the columns in keep, n_tokens, ids (16-bit little-endian numbers)."""
    spark = common.tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model_bytes(model))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("__text"))
    fields = source.drop("__text").schema.add("n_tokens", "long").add("ids", "binary")
    kept = len(source.columns) - 1
    # each path reads the texts for itself; none is moved but the long ones
    short = source.where(F.coalesce(F.char_length("__text"), F.lit(0)) <= chunk).mapInArrow(encode_rows(shared, kept), fields)
    long = source.where(F.char_length("__text") > chunk)
    keyed = long.select("*", *common.row_keys(F.col("doc_id"), F.col("__text")))
    texts = keyed.select("__k1", "__k2", "__text").dropDuplicates(["__k1", "__k2"])
    cut = texts.mapInArrow(chunks(shared, chunk), "__k1 long, __k2 long, at int, n int, body int, states int, exits int, part string")
    cut = common.written(cut.repartition("__k1", "__k2", "at"), "op2-chunks")
    matrices = cut.mapInArrow(transfers(shared), "__k1 long, __k2 long, at int, states int, exits int, m array<long>")
    lists = matrices.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("at", "states", "exits", "m"))).alias("ms"))
    scored = common.written(lists.mapInArrow(scan, "__k1 long, __k2 long, at int, exits int, entry array<long>"), "op2-scores")
    several = scored.where(F.size("entry") > 1).select("__k1", "__k2", "at", "entry")
    maps = cut.join(several, ["__k1", "__k2", "at"]).select("__k1", "__k2", "at", "body", "exits", "entry", "part").mapInArrow(leads(shared), "__k1 long, __k2 long, at int, to array<int>")
    maps = maps.unionAll(scored.where(F.size("entry") == 1).select("__k1", "__k2", "at", F.array_repeat(F.lit(0), F.col("exits"))))
    ways = maps.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("maps")).mapInArrow(walk, "__k1 long, __k2 long, at int, leave int")
    ways = ways.join(scored.select("__k1", "__k2", "at", "entry"), ["__k1", "__k2", "at"])
    traced = cut.join(ways, ["__k1", "__k2", "at"]).select("__k1", "__k2", "at", "body", "entry", "leave", "part").mapInArrow(traces(shared), "__k1 long, __k2 long, at int, ids binary")
    whole = traced.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")).mapInArrow(join_parts, "__k1 long, __k2 long, ids binary")
    joined = keyed.drop("__text").join(whole.hint("shuffle_merge"), ["__k1", "__k2"]).drop("__k1", "__k2").withColumn("n_tokens", (F.octet_length("ids") / 2).cast("long"))
    return short.unionByName(joined.select(short.columns))


def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["__k1", "__k2", "ids"])


def encode_rows(shared, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            ids = p.encode_all(batch.column(kept).to_pylist())
            names = batch.schema.names[:kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    return run


def chunks(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = " " + text
                cuts = p.cuts(text, size)
                ends = [c[0] for c in cuts[1:]] + [len(text)]
                exits = [c[1] for c in cuts[1:]] + [1]
                n = len(cuts)
                # a piece may reach over a whole short chunk only if chunks are shorter than pieces, which size forbids
                parts = [text[s : e + p.longest] if x > 1 else text[s:e] for (s, _), e, x in zip(cuts, ends, exits)]
                columns = [[k1] * n, [k2] * n, list(range(n)), [n] * n, [e - s for (s, _), e in zip(cuts, ends)], [c[1] for c in cuts], exits, parts]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["__k1", "__k2", "at", "n", "body", "states", "exits", "part"])

    return run


def split_units(p: Pieces, part: str, body: int, single: bool) -> tuple[int, int]:
    """The first and the last place in the body that every path passes; equal to (body, 0) if there is none."""
    if not p.parted:
        return body, 0
    first = 0 if single and part[:1] == " " else next((m.start() for m in re.finditer("(?<=[^ ]) ", part) if p.longest <= m.start() < body), body)
    last = max((m.start() for m in re.finditer("(?<=[^ ]) ", part[max(first, body - 4096) : body])), default=-1)
    return first, max(first, last + max(first, body - 4096)) if first < body else 0


def transfers(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                part, body, states, exits = swapped(r["part"]), r["body"], r["states"], r["exits"]
                first, last = split_units(p, r["part"], body, states == 1)
                if first < body:  # what lies between the two places adds the same to every path, so it may be left out
                    head = p.transfer(part[:first], first, states, 1) if first else np.zeros((1, 1), np.int64)
                    tail = p.transfer(part[last:], body - last, 1, exits)
                    m = product(head, tail)
                else:
                    m = p.transfer(part, body, states, exits)
                out.append(m.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__k1", "__k2", "at", "states", "exits")), pa.array(out, pa.list_(pa.int64()))], ["__k1", "__k2", "at", "states", "exits", "m"])

    return run


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k1, k2, ms in zip(*(c.to_pylist() for c in batch.columns)):
            entry = entry_scores([np.array(m["m"], np.int64).reshape(m["states"], m["exits"]) for m in ms])
            n = len(ms)
            yield pa.RecordBatch.from_arrays([pa.array([k1] * n), pa.array([k2] * n), pa.array(range(n), pa.int32()), pa.array([m["exits"] for m in ms], pa.int32()), pa.array(entry, pa.list_(pa.int64()))], ["__k1", "__k2", "at", "exits", "entry"])


def leads(shared):
    """Each chunk's entry states by exit state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            out = []
            for body, exits, entry, raw in zip(*(batch.column(c).to_pylist() for c in ("body", "exits", "entry", "part"))):
                first, _ = split_units(p, raw, body, False)
                part = swapped(raw)
                # a place that every path passes has one entry state behind it
                out.append([p.trace(part[:first], first, entry, 0)[0]] * exits if first < body else p.entries(part, body, entry, exits))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__k1", "__k2", "at")), pa.array(out, pa.list_(pa.int32()))], ["__k1", "__k2", "at", "to"])

    return run


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exit state of each chunk, from the end of its text."""
    for batch in batches:
        for k1, k2, maps in zip(*(c.to_pylist() for c in batch.columns)):
            state, way = 0, []
            for m in reversed(maps):
                way.append(state)
                state = m["to"][state]
            n = len(maps)
            yield pa.RecordBatch.from_arrays([pa.array([k1] * n), pa.array([k2] * n), pa.array(range(n), pa.int32()), pa.array(way[::-1], pa.int32())], ["__k1", "__k2", "at", "leave"])


def traces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            out = []
            for body, entry, leave, raw in zip(*(batch.column(c).to_pylist() for c in ("body", "entry", "leave", "part"))):
                part = swapped(raw)
                first, last = split_units(p, raw, body, len(entry) == 1)
                if first < body:
                    head = p.trace(part[:first], first, entry, 0)[1]
                    units = p.units.findall(raw[first:last])
                    p.learn(set(units))
                    middle = b"".join(map(p.__getitem__, units))
                    out.append(head + middle + p.trace(part[last:], body - last, [0], leave)[1])
                else:
                    out.append(p.trace(part, body, entry, leave)[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__k1", "__k2", "at")), pa.array(out, pa.binary())], ["__k1", "__k2", "at", "ids"])

    return run


def decode(encoded: DataFrame, *, ids_col: str = "ids", model: str = MODEL, into: str = "decoded") -> DataFrame:
    """The rows of encoded, with the text of their ids in a further column."""
    spark = common.tuned(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(model_bytes(model))
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            texts = [p.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("source_sha256", F.sha2("text", 256))
    back = decode(encode(source, keep=("source_sha256",), **options))
    decoded = F.sha2("decoded", 256)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"), (decoded == F.col("source_sha256")).alias("round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
