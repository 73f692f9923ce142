"""Recursive descent from tokens to statements. A statement must end where the text does; nothing is passed over.

Comparisons chain to the left and NOT and minus bind to the next primary, as the language has it. JOIN, GROUP BY, HAVING,
set operations, OFFSET, IN, BETWEEN, LIKE, IS, CASE and aliases are extensions with their usual meaning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import GqlError, Token, tokens


@dataclass(frozen=True)
class Expr:
    """kind: value, name, star, list, call, op, in, between, like, null, case; args as the kind needs."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Join:
    how: str
    table: str
    on: Expr | None
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr, str | None], ...]
    table: str
    alias: str | None = None
    distinct: bool = False
    tick: int | None = None
    since: int | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    groups: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
    sets: tuple[tuple[str, bool, object], ...] = ()
    listen: bool = False


@dataclass(frozen=True)
class Find:
    table: str
    near: tuple[float, ...] | None = None
    within: float = 0.0
    where: Expr | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Write:
    """kind: insert, update, delete, create, drop, spawn, despawn, snapshot, restore."""

    kind: str
    name: str
    columns: tuple = ()
    values: tuple = ()
    where: Expr | None = None


@dataclass(frozen=True)
class Explain:
    statement: object


@dataclass
class Parser:
    text: str
    list: list[Token] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        self.list = tokens(self.text)

    # --- tokens ---

    @property
    def now(self) -> Token:
        return self.list[self.at]

    def take(self, text: str, kind: str | None = None) -> bool:
        t = self.now
        if t.text == text and t.kind in ((kind,) if kind else ("key", "sign")):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise GqlError(f"expected {text!r} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind != "name" and t.text not in ("tick", "ticks", "component", "prefab", "at"):
            raise GqlError(f"expected a name at {t.at}, found {t.text or 'the end'!r}")
        self.at += 1
        return t.text

    def number(self) -> float:
        sign = -1 if self.take("-") else 1
        t = self.now
        if t.kind != "number":
            raise GqlError(f"expected a number at {t.at}, found {t.text or 'the end'!r}")
        self.at += 1
        return sign * (float(t.text) if "." in t.text else int(t.text))

    def string(self) -> str:
        t = self.now
        if t.kind not in ("string", "name"):
            raise GqlError(f"expected a string at {t.at}")
        self.at += 1
        return t.text

    def many(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    # --- statements ---

    def parse(self):
        if self.take("explain"):
            return Explain(self.parse())
        listen = self.take("listen")
        kind = self.now.text if self.now.kind == "key" else ""
        self.at += 1
        if listen and kind != "select":
            raise GqlError("LISTEN wants a SELECT")
        if not hasattr(self, "on_" + kind):
            raise GqlError(f"unknown statement at {self.list[self.at - 1].at}")
        out = self.on_select(listen) if kind == "select" else getattr(self, "on_" + kind)()
        self.take(";")
        if self.now.kind != "end":
            raise GqlError(f"unexpected {self.now.text!r} at {self.now.at}")
        return out

    def on_select(self, listen: bool = False) -> Select:
        distinct = self.take("distinct")
        items = self.many(self.item)
        self.need("from")
        table, alias = self.name(), self.alias()
        tick = since = None
        if self.take("at"):
            self.take("tick")
            tick = int(self.number())
        if self.take("since"):
            since = int(self.number())
            _ = self.take("ticks") or self.take("tick")
        joins = []
        while join := self.join():
            joins.append(join)
        where = self.expr() if self.take("where") else None
        groups, having, order = (), None, ()
        if self.take("group"):
            self.need("by")
            groups = self.many(self.expr)
        if self.take("having"):
            having = self.expr()
        sets = []
        while self.now.kind == "key" and self.now.text in ("union", "intersect", "except"):
            kind = self.now.text
            self.at += 1
            every = self.take("all")
            self.need("select")
            # a right side takes no order or limit of its own
            right = self.on_select()
            sets.append((kind, every, Select(**{**right.__dict__, "order": (), "limit": None, "offset": None, "sets": ()})))
            order, limit, offset = right.order, right.limit, right.offset
            sets += right.sets
            return Select(items, table, alias, distinct, tick, since, tuple(joins), where, groups, having, order, limit, offset, tuple(sets), listen)
        if self.take("order"):
            self.need("by")
            order = self.many(self.sort)
        limit = self.limit()
        offset = int(self.number()) if self.take("offset") else None
        return Select(items, table, alias, distinct, tick, since, tuple(joins), where, groups, having, order, limit, offset, (), listen)

    def item(self) -> tuple[Expr, str | None]:
        if self.take("*"):
            return Expr("star", ()), None
        e = self.expr()
        return e, self.name() if self.take("as") else None

    def alias(self) -> str | None:
        if self.take("as"):
            return self.name()
        return self.name() if self.now.kind == "name" else None

    def join(self) -> Join | None:
        how = "inner"
        if self.take("cross"):
            raise GqlError("CROSS JOIN is not offered")
        for word in ("left", "right", "full"):
            if self.take(word):
                how = word
                self.take("outer")
                break
        else:
            if not self.take("inner") and self.now.text != "join":
                return None
        self.need("join")
        table, alias = self.name(), self.alias()
        self.need("on")
        return Join(how, table, self.expr(), alias)

    def sort(self) -> tuple[Expr, bool]:
        e = self.expr()
        if self.take("desc"):
            return e, True
        self.take("asc")
        return e, False

    def limit(self) -> int | None:
        """A limit of 0 means none."""
        return (int(self.number()) or None) if self.take("limit") else None

    def on_find(self) -> Find:
        table, near, within = self.name(), None, 0.0
        if self.take("near"):
            self.need("(")
            near = self.many(self.number)
            self.need(")")
            if len(near) not in (2, 3):
                raise GqlError("NEAR wants two or three coordinates")
            self.need("within")
            within = float(self.number())
        where = self.expr() if self.take("where") else None
        return Find(table, near, within, where, self.limit())

    def on_insert(self) -> Write:
        self.need("into")
        table, columns = self.name(), ()
        if self.take("("):
            columns = self.many(self.name)
            self.need(")")
        self.need("values")
        rows = self.many(self.row)
        if any(len(r) != len(columns or rows[0]) for r in rows):
            raise GqlError("as many values as columns are wanted")
        return Write("insert", table, columns, rows)

    def row(self) -> tuple[Expr, ...]:
        self.need("(")
        out = self.many(self.expr)
        self.need(")")
        return out

    def assignment(self) -> tuple[str, Expr]:
        column = self.name()
        self.need("=")
        return column, self.sum()

    def on_update(self) -> Write:
        table = self.name()
        self.need("set")
        pairs = self.many(self.assignment)
        return Write("update", table, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs), self.expr() if self.take("where") else None)

    def on_delete(self) -> Write:
        self.need("from")
        return Write("delete", self.name(), where=self.expr() if self.take("where") else None)

    def on_create(self) -> Write:
        self.need("table")
        table = self.name()
        self.need("(")
        columns = self.many(lambda: (self.name(), self.name()))
        self.need(")")
        return Write("create", table, columns)

    def on_drop(self) -> Write:
        self.need("table")
        return Write("drop", self.name())

    def on_spawn(self) -> Write:
        self.take("prefab")
        name, pairs = self.string(), ()
        if self.take("with"):
            pairs = self.many(self.assignment)
        return Write("spawn", name, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))

    def on_despawn(self) -> Write:
        return Write("despawn", str(int(self.number())))

    def on_snapshot(self) -> Write:
        self.need("to")
        return Write("snapshot", self.string())

    def on_restore(self) -> Write:
        self.need("from")
        return Write("restore", self.string())

    # --- expressions ---

    def expr(self) -> Expr:
        left = self.conjunction()
        while self.take("or"):
            left = Expr("op", ("or", left, self.conjunction()))
        return left

    def conjunction(self) -> Expr:
        left = self.comparison()
        while self.take("and"):
            left = Expr("op", ("and", left, self.comparison()))
        return left

    def comparison(self) -> Expr:
        left = self.sum()
        while True:
            t = self.now
            if t.kind == "sign" and t.text in ("=", "<>", "<", ">", "<=", ">="):
                self.at += 1
                left = Expr("op", (t.text, left, self.sum()))
                continue
            negate = t.text == "not" and self.list[self.at + 1].text in ("in", "between", "like")
            self.at += negate
            if self.take("in"):
                left = Expr("in", (left, self.row(), negate))
            elif self.take("between"):
                low = self.sum()
                self.need("and")
                left = Expr("between", (left, low, self.sum(), negate))
            elif self.take("like"):
                left = Expr("like", (left, self.string(), negate))
            elif self.take("is"):
                negate = self.take("not")
                self.need("null")
                left = Expr("null", (left, negate))
            elif self.take("has"):
                self.take("component")
                left = Expr("null", (Expr("name", (self.name(),)), True))
            else:
                return left

    def sum(self) -> Expr:
        left = self.product()
        while self.now.kind == "sign" and self.now.text in "+-":
            op = self.now.text
            self.at += 1
            left = Expr("op", (op, left, self.product()))
        return left

    def product(self) -> Expr:
        left = self.unary()
        while self.now.kind == "sign" and self.now.text in "*/%":
            op = self.now.text
            self.at += 1
            left = Expr("op", (op, left, self.unary()))
        return left

    def unary(self) -> Expr:
        if self.take("not"):
            return Expr("op", ("not", self.primary()))
        if self.take("-"):
            return Expr("op", ("neg", self.primary()))
        return self.primary()

    def primary(self) -> Expr:
        t = self.now
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            values = self.many(self.expr)
            self.need("]")
            return Expr("list", values)
        if t.kind == "key" and t.text in ("null", "true", "false"):
            self.at += 1
            return Expr("value", ({"null": None, "true": True, "false": False}[t.text],))
        if self.take("has"):
            self.take("component")
            return Expr("null", (Expr("name", (self.name(),)), True))
        if self.take("case"):
            arms = []
            while self.take("when"):
                test = self.expr()
                self.need("then")
                arms.append((test, self.expr()))
            other = self.expr() if self.take("else") else None
            self.need("end")
            return Expr("case", (tuple(arms), other))
        if t.kind == "number":
            return Expr("value", (self.number(),))
        if t.kind == "string":
            self.at += 1
            return Expr("value", (t.text,))
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        if self.take("("):
            distinct, args = self.take("distinct"), ()
            if self.take("*"):
                args = (Expr("star", ()),)
            elif self.now.text != ")":
                args = self.many(self.expr)
            self.need(")")
            return Expr("call", (name.lower(), args, distinct))
        return Expr("name", (name,))


def parse(text: str):
    return Parser(text).parse()
