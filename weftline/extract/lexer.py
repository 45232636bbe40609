"""Tokens and statements of SQL text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, quoted, string, number, op
    text: str  # as written, without identifier quotes
    low: str  # in lower case; of a string the text itself
    pos: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|//(?=[^\n]*)[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\$\$.*?(?:\$\$|\Z)|\$(?P<tag>[A-Za-z_]\w*)\$.*?(?:\$(?P=tag)\$|\Z)|'(?:[^']|'')*(?:'|\Z))
    |(?P<quoted>"(?:[^"]|"")+"|`[^`]+`|\[[A-Za-z_][^\]\n]*\])
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
    |(?P<word>[@$\#:]?[^\W\d][\w$]*)
    |(?P<op><=>|<>|<=|>=|!=|\|\||::|:=|=>|->>|->|.)""",
    re.X | re.S,
)


def tokenize(sql: str) -> list[Token]:
    """All tokens but white space and comments. Never fails: what is no token of
    its own is an op of one character, and open strings run to the end."""
    out = []
    for m in _TOKEN.finditer(sql):
        k = m.lastgroup
        if k == "tag":
            k = "string"
        if k == "skip":
            continue
        t = m[0]
        if k == "quoted":
            inner = t[1:-1].replace('""', '"')
            out.append(Token("quoted", inner, inner.lower(), m.start()))
        elif k == "string":
            out.append(Token("string", t, t, m.start()))
        else:
            out.append(Token(k, t, t.lower(), m.start()))
    return out


def normalise(sql: str) -> str:
    """Text forms that only some dialects have, taken out or made common; line
    ends stay, so line numbers hold: TEMP ... IF NOT EXISTS, UNPIVOT (...),
    WITH TAG (...), ALTER ... SET TAG ...;"""

    def blank(m: re.Match) -> str:
        return "\n" * m[0].count("\n") or " "

    sql = re.sub(r"(?i)\b(create\s+(?:or\s+replace\s+)?)(?:local\s+|global\s+)?temp(?:orary)?(\s+table\s+)if\s+not\s+exists\s+", r"\1temporary\2", sql)
    sql = re.sub(r"(?is)\bunpivot\s*(?:include\s+nulls\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)", blank, sql)
    sql = re.sub(r"(?is)\bwith\s+tag\s*\([^)]*\)", blank, sql)
    return re.sub(r"(?is)\balter\s+[^;]*?\bset\s+tag\b[^;]*", blank, sql)


class Statement(NamedTuple):
    text: str
    tokens: list[Token]
    line: int


_BLOCK_HEADS = ("create", "declare", "begin", "do")


def statements(sql: str) -> list[Statement]:
    """Statements between semicolons outside parentheses and BEGIN ... END
    blocks, with the 1-based line of their first token. Empty ones are left
    out."""
    toks = tokenize(sql)
    out: list[Statement] = []
    cur: list[Token] = []
    depth = block = 0
    starts = [0] + [m.end() for m in re.finditer("\n", sql)]
    import bisect

    def flush(end: int) -> None:
        if cur:
            out.append(Statement(sql[cur[0].pos : end].rstrip(), list(cur), bisect.bisect_right(starts, cur[0].pos)))
            cur.clear()

    for i, t in enumerate(toks):
        if t.kind == "op":
            if t.text == "(":
                depth += 1
            elif t.text == ")":
                depth = max(0, depth - 1)
            elif t.text == ";" and not block:
                depth = 0
                flush(t.pos)
                continue
        elif t.kind == "word" and not depth:
            nxt = toks[i + 1].low if i + 1 < len(toks) else ";"
            if t.low == "begin" and nxt not in (";", "transaction", "tran", "work") and (not cur or cur[0].low in _BLOCK_HEADS or block):
                block += 1
            elif block and t.low == "case":
                block += 1
            elif block and t.low in ("if", "loop", "for", "while") and (not cur or cur[-1].low in (";", "begin", "then", "else", "do", "loop")):
                block += t.low != "loop" or cur[-1].low != "do" if cur else 1
            elif block and t.low == "end":
                block -= 1
                if nxt in ("if", "loop", "for", "while", "case"):
                    pass
        cur.append(t)
    flush(len(sql))
    return out
