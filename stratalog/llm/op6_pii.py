"""Personal data: overlapping candidate spans, boosted trees over their format and context, calibrated thresholds.

All work is DataFrame expressions. Generators are regular expressions without backtracking over long runs (possessive
quantifiers); a match's place follows from the lengths of the pieces between matches. Those of the four base kinds
that pass their checks (octets, Luhn, digit counts) are personal data in any case. The other matches, and those of
further generators (phones without a plus, spelled-out addresses, long keys), are candidates.

The trees are fitted to labels that come from a value's own check, whichever generator found it: base matches; phones
without a plus whose area and exchange codes may be dialled; spelled-out addresses of a common top-level domain with a
cue word, brackets or a local part that is no plain word; keys after a cue word that mix letters and digits at
``ENTROPY`` bits a character. What a label looks at is withheld from the features of its generator (``WITHHELD``), so
the trees go by what else stands in and around a span. Candidates that overlap base spans can't be added, and pieces of
personal data are no negatives: they neither fit nor calibrate.

Features have few values each, so all candidates of the corpus are counted by feature vector, and at most ``VECTORS``
counts, a bound set by the features' ranges, come to the driver; half of the documents fit the trees, the other half
sets for each generator the least score above which ``PRECISION`` of at least ``LEAST`` candidates have the label.
Candidates that reach it are added unless they overlap base spans; of overlapping ones the best scored stays.

A match moves without its text, so shuffles are small; a document's matches are bounded by its length. Null and empty
texts have no spans. Repeated rows have the spans of one. Only the named columns are looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = "[A-Za-z0-9._%+-]"
#: Generator: kind, a cheap test that a text may have a match, the matches.
GENERATORS = {
    "email": ("email", "@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", r"[0-9][0-9 -]{14}", r"[0-9](?:[ -]?+[0-9])++"),
    "phone": ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "bare_phone": ("phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "spelled_email": ("email", r"(?i)[(\[]at[)\]]| at ", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at )[ ]?[a-z0-9-]{1,64}+ ?(?:\(dot\)|\[dot\]| dot )[ ]?[a-z]{2,10}+"),
    "secret": ("secret", r"[A-Za-z0-9]{24}", r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,128}+(?![A-Za-z0-9])"),
}
#: Words before a span that speak of personal data.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|account|ip|host|address|token|key|password|secret)[a-z]{0,3}[ :=\"'#]{0,4}$"
#: Features that a generator's label looks at.
WITHHELD = {"spelled_email": ("digits", "cue", "marks"), "secret": ("digits", "cue")}
ENTROPY = 3.0
#: Characters of a text that are cut together.
BLOCK = 1024
VECTORS = 20_000
ROUNDS, RATE = 40, 0.3
PRECISION = 0.9
LEAST = 20


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.char_length(digits))
    values = F.transform(at, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_ok(kind: Column, hit: Column) -> Column:
    """Whether a base generator's match is personal data by its kind's check."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    octets = F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?$"))
    return F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(False)


def entropy(hit: Column) -> Column:
    """Bits a character."""
    n = F.char_length(hit)
    share = lambda c: (n - F.char_length(F.replace(hit, c))) / n
    return F.aggregate(F.array_remove(F.array_distinct(F.split(hit, "")), ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def labelled(gen: Column, base: Column, hit: Column, before: Column) -> Column:
    """Whether a match has its kind's label; a look at the value and the cue before it, not at the generator's form."""
    number = {name: i for i, name in enumerate(GENERATORS)}
    cue = before.rlike(CUES)
    code = "[2-9](?!11)[0-9]{2}"
    phone = F.regexp_replace(hit, "[^0-9]", "").rlike(f"^{code}{code}[0-9]{{4}}$")
    domain = hit.rlike(r"(?i)[ )\]](?:com|org|net|edu|gov|mil|info|biz|dev|app|io|eu|de|fr|es|it|nl|uk|us|ca|ch|se|pl|jp|cn|br|au)$")
    address = domain & (cue | hit.rlike(r"(?i)^[a-z]*+[0-9._-]|[(\[]at[)\]]"))
    key = cue & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (entropy(hit) >= ENTROPY)
    return F.when(gen == number["bare_phone"], phone).when(gen == number["spelled_email"], address).when(gen == number["secret"], key).otherwise(base)


#: Features and how many values each has; none repeats a check.
FEATURES = {"gen": 7, "size": 6, "digits": 5, "cue": 2, "before": 4, "after": 4, "marks": 3}


def features(gen: Column, hit: Column, before: Column, after: Column) -> Column:
    n, digits = F.char_length(hit), F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
    steps = lambda x, *cuts: sum(((x >= c).cast("int") for c in cuts), F.lit(0))
    side = lambda x: F.when(x == "", 0).when(x.rlike("[A-Za-z0-9\u0080-￿]"), 1).when(x.rlike(r"\s"), 2).otherwise(3)
    marks = F.char_length(F.regexp_replace(hit, "[A-Za-z0-9]", ""))
    hidden = lambda k: gen.isin([i for i, name in enumerate(GENERATORS) if k in WITHHELD.get(name, ())])
    values = {"gen": gen, "size": steps(n, 8, 12, 16, 20, 32), "digits": steps(digits, 1, 8, 13, 17), "cue": before.rlike(CUES).cast("int"), "before": side(F.right(before, F.lit(1))), "after": side(after), "marks": steps(marks, 1, 4)}
    return F.struct(*(F.when(hidden(k), 0).otherwise(values[k].cast("int")).alias(k) if any(k in w for w in WITHHELD.values()) else values[k].cast("int").alias(k) for k in FEATURES))


def candidates(docs: DataFrame) -> DataFrame:
    """docs (k1, k2, text) to one row a match: k1, k2, kind, start, end, base, label, f, and whether it is free of (other) base spans."""
    names = list(GENERATORS)
    lists = []
    for i, name in enumerate(names):
        kind, test, pattern = GENERATORS[name]
        may = F.col("text").contains(test) if test == "@" else F.col("text").rlike(test)
        hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        lists.append(F.when(may, F.struct(F.lit(i).alias("gen"), F.lit(kind).alias("kind"), F.lit(name == kind and kind != "secret").alias("strict"), hits.alias("hits"), gaps.alias("gaps"))))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("k1", "k2", "row", F.explode(F.array_compact(F.array(*lists))).alias("g")).where(F.size("g.hits") > 0)
    zipped = F.transform("g.hits", lambda h, i: F.struct(h.alias("hit"), F.char_length(h).alias("n"), F.char_length(F.get("g.gaps", i)).alias("gap"), F.right(F.get("g.gaps", i), F.lit(24)).alias("before"), F.left(F.get("g.gaps", i + 1), F.lit(1)).alias("after")))
    flat = rows.select("k1", "k2", "row", "g.gen", "g.kind", "g.strict", F.posexplode(zipped).alias("at", "m"))
    upto = F.sum(F.col("m.n") + F.col("m.gap")).over(Window.partitionBy("k1", "k2", "row", "gen").orderBy("at"))
    placed = flat.withColumn("end", upto).withColumn("start", F.col("end") - F.col("m.n"))
    placed = placed.withColumn("base", F.col("strict") & base_ok(F.col("kind"), F.col("m.hit")))
    label = labelled(F.col("gen"), F.col("base"), F.col("m.hit"), F.col("m.before"))
    found = placed.select("k1", "k2", "row", "kind", "start", "end", "base", label.alias("label"), features(F.col("gen"), F.col("m.hit"), F.col("m.before"), F.col("m.after")).alias("f"))
    digits = F.col("f.digits")
    # a run of few digits is no candidate for a card
    found = found.where(F.col("base") | (F.col("kind") != "card") | (digits >= 3))
    # equal rows have equal matches: one of each stays
    found = found.groupBy("k1", "k2", "kind", "start", "end").agg(F.max("base").alias("base"), F.max("label").alias("label"), F.max("f").alias("f"))
    order = Window.partitionBy("k1", "k2").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return found.withColumn("free", F.col("base") | ~overlaps)


class Trees:
    """Boosted trees of depth two over small integer features, fitted to counted vectors by Newton steps."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]]):
        """rows: vector, count, positive count."""
        self.trees: list[tuple] = []
        total, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.start = math.log((good + 1) / (total - good + 1)) if rows else -20.0
        score = [self.start] * len(rows)
        splits = [(j, v) for j, n in enumerate(FEATURES.values()) for v in range(1, n)]
        for _ in range(ROUNDS if 0 < good < total else 0):
            p = [1 / (1 + math.exp(-s)) for s in score]
            stats = [(r[0], r[2] - r[1] * q, r[1] * q * (1 - q)) for r, q in zip(rows, p)]
            tree = self.split(stats, splits, 2)
            self.trees.append(tree)
            for i, r in enumerate(rows):
                score[i] += self.leaf(tree, r[0])

    def split(self, stats: list[tuple], splits: list[tuple[int, int]], depth: int) -> tuple:
        g, h = sum(s[1] for s in stats), sum(s[2] for s in stats)
        best, at = 1e-6, None
        for j, v in splits if depth else ():
            gl = sum(s[1] for s in stats if s[0][j] < v)
            hl = sum(s[2] for s in stats if s[0][j] < v)
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best + 1e-12:
                best, at = gain, (j, v)
        if at is None:
            return (round(RATE * g / (h + 1), 9),)
        j, v = at
        return (j, v, self.split([s for s in stats if s[0][j] < v], splits, depth - 1), self.split([s for s in stats if s[0][j] >= v], splits, depth - 1))

    def leaf(self, tree: tuple, vector: tuple[int, ...]) -> float:
        while len(tree) > 1:
            tree = tree[2] if vector[tree[0]] < tree[1] else tree[3]
        return tree[0]

    def score(self, vector: tuple[int, ...]) -> float:
        return self.start + sum(self.leaf(t, vector) for t in self.trees)

    def column(self, f: str) -> Column:
        names = list(FEATURES)

        def expr(tree: tuple) -> str:
            if len(tree) == 1:
                return f"{tree[0]!r}D"
            return f"if({f}.{names[tree[0]]} < {tree[1]}, {expr(tree[2])}, {expr(tree[3])})"

        return F.expr(" + ".join([f"{self.start!r}D", *map(expr, self.trees)]))


def model(found: DataFrame) -> tuple[Trees, dict[int, float]]:
    """Trees and each generator's threshold, from all free candidates counted by vector, half of the documents for each."""
    half = F.pmod(F.xxhash64("k1", "k2"), F.lit(2)).alias("half")
    counts = found.where("free").groupBy(half, "f").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("good"))
    rows = [(r.half, r.f.gen, tuple(r.f), r.n, r.good) for r in counts.orderBy("half", "f").limit(VECTORS * 2 * len(KINDS)).collect()]
    trees = Trees([(r[2], r[3], r[4]) for r in rows if r[0] == 0])
    thresholds = {}
    for gen in range(len(GENERATORS)):
        ranked = sorted(((trees.score(r[2]), r[3], r[4]) for r in rows if r[0] == 1 and r[1] == gen), reverse=True)
        n = good = 0
        for i, (score, a, b) in enumerate(ranked):
            n, good = n + a, good + b
            if (i + 1 == len(ranked) or ranked[i + 1][0] < score) and n >= LEAST and good >= PRECISION * n:
                thresholds[gen] = score - 1e-9
    return trees, thresholds


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Keys (k1, k2) with their spans, an array of (k, start, end, base) in the order of kinds and starts; and docs as
    (doc_id, k1, k2, text)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *common.row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text")).withColumnsRenamed({"__k1": "k1", "__k2": "k2"})
    found = common.written(candidates(source.where("text is not null").select("k1", "k2", "text")), "op6-candidates")
    trees, thresholds = model(found)
    least = F.lit(None).cast("double")
    for gen, value in thresholds.items():
        least = F.when(F.col("f.gen") == gen, F.lit(value)).otherwise(least)
    scored = found.withColumn("score", F.when(F.col("base"), F.lit(math.inf)).otherwise(trees.column("f"))).where(F.col("base") | F.col("free") & (F.col("score") >= least))
    # added spans that overlap form an island, of which the best scored one stays; none overlaps a base span
    order = Window.partitionBy("k1", "k2", "base").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(Window.partitionBy("k1", "k2", "base", "island").orderBy(F.col("score").desc(), (F.col("start") - F.col("end")), "start", "kind"))
    kept = scored.withColumn("island", island).withColumn("rank", rank).where(F.col("base") | (F.col("rank") == 1))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return kept.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), "start", "end", "base"))).alias("spans")), source


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters of a text in blocks of BLOCK from start to end; only the blocks that they lie in are touched."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    text = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(text, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, in whose texts each span is replaced by its kind in brackets.

    A text with spans is cut to blocks once, and each piece between spans taken from the blocks that it lies in, so the
    work grows with the text and not with text times spans.
    """
    found, _ = spans(docs, id_col=id_col, text_col=text_col)
    k1, k2, name = common.free(docs.columns, "__k1", "__k2", "__spans")
    # base spans of different kinds may overlap: the later one then starts where the earlier one ends
    flat = found.select("k1", "k2", F.inline("spans"))
    order = Window.partitionBy("k1", "k2").orderBy("start", "end", "k")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = flat.withColumn("upto", before).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2))
    placed = placed.agg(F.array_sort(F.collect_list(F.struct("start", "end", "k", "upto"))).alias("list"), F.max("end").alias("last")).select(k1, k2, F.struct("list", "last").alias(name))
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(common.row_keys(F.col(id_col), F.col(text_col)), (k1, k2))))
    joined = keyed.join(placed.hint("shuffle_merge"), [k1, k2], "left")
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    tag = lambda k: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), k)), F.lit("]"))

    def cut(b: Column) -> Column:
        piece = lambda s: F.concat(between(b, s["upto"], s["start"]), F.when(s["end"] > s["upto"], tag(s["k"])).otherwise(""))
        end = F.col(f"{name}.last")
        return F.concat(F.array_join(F.transform(F.col(f"{name}.list"), piece), ""), between(b, end, F.char_length(text_col)))

    # a one-element transform names the blocks, which are else made anew for each piece
    done = F.element_at(F.transform(F.array(blocks), cut), 1)
    return joined.withColumn(text_col, F.when(F.col(name).isNotNull(), done).otherwise(F.col(text_col))).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, docs = spans(common.table(spark, sf_dir, "documents"))
    joined = docs.drop("text").join(found.hint("shuffle_merge"), ["k1", "k2"], "left")
    everything = F.coalesce("spans", F.expr("array()"))
    base = F.filter(everything, lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["k"] == k + 1)).cast("long")
    return joined.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(named(base), 256).alias("base_sha256"), named(everything).alias("spans"))
