"""Statements to DataFrames; Catalyst does the rest."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .lexer import GqlError
from .parser import Expr, Select

AGGREGATES = {"count", "sum", "avg", "min", "max", "stddev", "variance", "approx_count_distinct", "count_if", "bool_and", "bool_or", "first", "last", "median"}
SCALARS = {
    *"abs ceil floor round sqrt pow exp ln log10 sign sin cos tan asin acos atan atan2 degrees radians mod greatest least".split(),
    *"length lower upper trim ltrim rtrim substring concat concat_ws replace reverse repeat lpad rpad instr split".split(),
    *"regexp_extract regexp_replace regexp_like coalesce nullif ifnull if year month day hour minute second date_trunc date_add date_diff".split(),
    *"get_json_object size array_contains element_at sort_array array_distinct map_keys map_values xxhash64 crc32 md5 sha1 sha2".split(),
}
OPS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
}
TYPES = {"int": "int", "bigint": "bigint", "float": "double", "text": "string", "bool": "boolean", "vec2": "struct<x:float,y:float>", "vec3": "struct<x:float,y:float,z:float>", "timestamp": "timestamp", "uuid": "string"}
POSITION = (("x", "y", "z"), ("pos.x", "pos.y", "pos.z"), ("x", "y"))


def boolean(e: Expr) -> bool:
    return e.kind in ("in", "between", "like", "null") or e.kind == "op" and e.args[0] in ("=", "<>", "<", ">", "<=", ">=", "and", "or", "not")


def column(e: Expr) -> Column:
    if e.kind == "value":
        return F.lit(e.args[0])
    if e.kind == "name":
        return F.col(e.args[0])
    if e.kind == "list":
        return F.array(*map(column, e.args))
    if e.kind == "op":
        name, *args = e.args
        if name == "not":
            return ~truth(args[0])
        if name == "neg":
            return -column(args[0])
        if name in ("and", "or"):
            a, b = map(truth, args)
            return a & b if name == "and" else a | b
        # a chained comparison compares the truth of its left side as 0 or 1
        a, b = (column(x).cast("int") if boolean(x) else column(x) for x in args)
        return OPS[name](a, b)
    if e.kind == "in":
        test = column(e.args[0]).isin(*(x.args[0] if x.kind == "value" else column(x) for x in e.args[1]))
        return ~test if e.args[2] else test
    if e.kind == "between":
        test = column(e.args[0]).between(column(e.args[1]), column(e.args[2]))
        return ~test if e.args[3] else test
    if e.kind == "like":
        test = column(e.args[0]).like(e.args[1])
        return ~test if e.args[2] else test
    if e.kind == "null":
        return column(e.args[0]).isNotNull() if e.args[1] else column(e.args[0]).isNull()
    if e.kind == "case":
        out = None
        for test, value in e.args[0]:
            out = F.when(truth(test), column(value)) if out is None else out.when(truth(test), column(value))
        return out if e.args[1] is None else out.otherwise(column(e.args[1]))
    if e.kind == "call":
        return call(*e.args)
    raise GqlError(f"{e.kind} isn't a value")


def truth(e: Expr) -> Column:
    return column(e) if boolean(e) or e.kind == "value" and isinstance(e.args[0], bool) else column(e).cast("boolean")


def call(name: str, args: tuple[Expr, ...], distinct: bool) -> Column:
    if name == "count" and args and args[0].kind == "star":
        return F.count("*")
    if name == "distance":
        if len(args) != 2:
            raise GqlError("distance wants a position and a point")
        a, b = (vector(x) for x in args)
        return g.distance(a, b)
    values = [column(a) for a in args]
    if name in AGGREGATES:
        if distinct:
            if name != "count":
                return F.call_function(name, F.array_distinct(F.collect_set(values[0]))) if name not in ("sum", "avg") else (F.sum_distinct(values[0]) if name == "sum" else F.expr(f"avg(distinct {args[0].args[0]})"))
            return F.count_distinct(*values)
        return F.call_function(name, *values)
    if name in SCALARS:
        return F.call_function(name, *values)
    raise GqlError(f"unknown function {name}")


def vector(e: Expr) -> list[Column]:
    """A list's values, or the coordinates of a position column."""
    if e.kind == "list":
        return [column(x) for x in e.args]
    if e.kind == "name":
        return [F.col(f"{e.args[0]}.{n}") for n in "xyz"]
    raise GqlError("a position is a column or a list")


def aggregates(e: Expr) -> bool:
    if e.kind == "call" and e.args[0] in AGGREGATES:
        return True
    return any(aggregates(x) for x in flat(e.args) if isinstance(x, Expr))


def flat(args) -> list:
    out = []
    for a in args:
        out += flat(a) if isinstance(a, tuple) else [a]
    return out


def text(e: Expr) -> str:
    """The name of an unnamed item."""
    if e.kind == "name":
        return e.args[0].rsplit(".", 1)[-1]
    if e.kind == "call":
        return f"{e.args[0]}({', '.join('*' if a.kind == 'star' else text(a) for a in e.args[1])})"
    if e.kind == "value":
        return str(e.args[0])
    return "expr"


def position(df: DataFrame) -> tuple[str, ...]:
    flat_names = {c.lower() for c in df.columns}
    for names in POSITION:
        if all(n.split(".")[0] in flat_names for n in names):
            return names
    raise GqlError("the table has no position: columns x, y[, z] or pos")


def select(s: Select, source) -> DataFrame:
    """source(table, tick, since, listen) gives a table's DataFrame."""
    df = source(s.table, s.tick, s.since, s.listen).alias(s.alias or s.table)
    for j in s.joins:
        df = df.join(source(j.table, s.tick, None, s.listen).alias(j.alias or j.table), truth(j.on), j.how)
    if s.where:
        df = df.where(truth(s.where))
    grouped = bool(s.groups) or any(aggregates(e) for e, _ in s.items) or s.having is not None
    named = [(e, n or text(e)) for e, n in s.items]
    plain = all(e.kind == "star" for e, _ in s.items)
    order = [(e, down) for e, down in s.order]
    if grouped:
        if any(e.kind == "star" for e, _ in s.items):
            raise GqlError("* can't be grouped")
        keys = [column(k).alias(f"__k{i}") for i, k in enumerate(s.groups)]
        place = {k: F.col(f"__k{i}") for i, k in enumerate(s.groups)}
        wanted = [(e, n) for e, n in named if e not in place]
        aggs = [column(e).alias(n) for e, n in wanted]
        if s.having is not None:
            aggs.append(truth(s.having).alias("__having"))
        df = df.groupBy(*keys).agg(*(aggs or [F.count("*").alias("__n")]))
        if s.having is not None:
            df = df.where("__having")
        df = df.select(*((place[e] if e in place else F.col(f"`{n}`")).alias(n) for e, n in named))
    elif not plain:
        # what the order needs but isn't selected is carried along and dropped
        chosen = {n for _, n in named}
        hidden = [] if s.distinct else [(e, f"__o{i}") for i, (e, _) in enumerate(order) if not (e.kind == "name" and e.args[0] in chosen)]
        parts = []
        for e, n in named:
            parts.append(F.col("*") if e.kind == "star" else column(e).alias(n))
        df = df.select(*parts, *(column(e).alias(n) for e, n in hidden))
        swap = {e: n for e, n in hidden}
        order = [(Expr("name", (swap[e],)) if e in swap else e, down) for e, down in order]
    if s.distinct:
        df = df.distinct()
    for kind, every, right in s.sets:
        other = select(right, source)
        name = {("union", True): "unionAll", ("intersect", False): "intersect", ("intersect", True): "intersectAll", ("except", True): "exceptAll"}.get((kind, every))
        df = getattr(df, name)(other) if name else df.unionAll(other).distinct() if kind == "union" else df.subtract(other)
    if order:
        aliased = {e: n for e, n in named if e.kind != "star"}
        keys = [F.col(f"`{aliased[e]}`") if grouped and e in aliased else column(e) for e, _ in order]
        df = df.orderBy(*(k.desc() if down else k.asc() for k, (_, down) in zip(keys, order)))
    if s.offset:
        df = df.offset(s.offset)
    if s.limit:
        df = df.limit(s.limit)
    return df.drop(*(c for c in df.columns if c.startswith("__o")))


