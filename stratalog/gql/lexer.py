"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset(
    """select distinct from at tick ticks where order by asc desc limit offset insert into values update set delete create
    drop table find near within spawn despawn prefab with snapshot restore to listen and or not null true false in between
    like is as join inner left right full outer cross on group having union intersect except all since explain case when
    then else end has component""".split()
)
TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>\d+\.\d*|\.\d+|\d+)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>`[^`]*`|"[^"]*"|\[\s*[A-Za-z_][^\]\d,]*[^\],]*\])
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<sign><>|!=|<=|>=|\|\||&&|[-+*/%=<>(),.;\[\]])""",
    re.VERBOSE | re.DOTALL,
)


class GqlError(ValueError):
    """A statement that can't be read or names what isn't there."""


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, key, sign, end
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise GqlError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "word":
            low = value.lower()
            out.append(Token("key", low, at) if low in KEYWORDS else Token("name", value, at))
        elif kind == "quoted":
            out.append(Token("name", value[1:-1].strip(), at))
        elif kind == "string":
            out.append(Token("string", value[1:-1].replace("''", "'"), at))
        elif kind != "skip":
            out.append(Token(kind, {"!=": "<>", "||": "or", "&&": "and"}.get(value, value), at))
        at = m.end()
    return [*out, Token("end", "", at)]
