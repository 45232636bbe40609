"""A tolerant parser for what lineage needs: which tables and columns a
statement reads and writes. Works on token lists; what it does not know it skips
over, so one odd clause does not lose the statement."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Token

#: Words that never are a column or an alias.
RESERVED = frozenset(
    """select from where group by having order qualify limit offset fetch union intersect minus except all distinct on using join left right full inner outer cross
    natural lateral and or not in is null like ilike rlike between exists case when then else end cast into values set as with over partition asc desc nulls window
    insert update delete merge create table view true false top interval default escape any some for""".split()
)
_CLAUSES = frozenset("from where group having order qualify limit offset fetch window union intersect minus except connect start".split())
AGGREGATES = frozenset(
    """count sum avg min max median mode stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp listagg array_agg string_agg group_concat any_value
    bool_and bool_or every bit_and bit_or approx_count_distinct approx_percentile percentile_cont percentile_disc first last collect_list collect_set countif sumif
    object_agg json_agg max_by min_by kurtosis skew hll count_if""".split()
)
_TYPED = frozenset("date time timestamp interval datetime".split())


@dataclass
class Ref:
    """A table reference as written: parts in lower case."""

    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.parts)


@dataclass
class Source:
    alias: str
    ref: Ref | None = None
    query: "Query | None" = None
    columns: tuple[str, ...] = ()


@dataclass
class Item:
    alias: str | None
    columns: list[tuple[str | None, str]] = field(default_factory=list)  # (qualifier, column)
    star: str | None = None  # '' for *, else the qualifier
    plain: bool = False  # nothing but one column
    aggregate: bool = False
    queries: list["Query"] = field(default_factory=list)


@dataclass
class Select:
    items: list[Item]
    sources: list[Source]
    inner: list["Query"] = field(default_factory=list)  # subqueries outside FROM


@dataclass
class Query:
    ctes: list[tuple[str, tuple[str, ...], "Query"]]
    branches: list["Select | Query"]


@dataclass
class Parsed:
    kind: str
    target: Ref | None = None
    columns: list[str] | None = None  # INSERT column list, or DDL columns
    query: Query | None = None
    temp: bool = False
    role: str = "table"
    donor: Ref | None = None  # CLONE or LIKE
    inner: list[Query] = field(default_factory=list)
    tables: list[Ref] = field(default_factory=list)  # read without a query
    schema: str | None = None  # USE SCHEMA
    body: list[Token] = field(default_factory=list)  # of a scripting block
    ddl: bool = False


def _close(t: list[Token], i: int) -> int:
    """Index of the parenthesis that closes the one at i, or the end."""
    depth = 0
    for j in range(i, len(t)):
        if t[j].kind == "op":
            if t[j].text == "(":
                depth += 1
            elif t[j].text == ")":
                depth -= 1
                if not depth:
                    return j
    return len(t)


def _split(t: list[Token], seps: frozenset[str]) -> list[list[Token]]:
    out, cur, depth = [], [], 0
    for x in t:
        if x.kind == "op":
            if x.text in "([":
                depth += 1
            elif x.text in ")]":
                depth -= 1
        if not depth and x.low in seps and x.kind in ("op", "word"):
            out.append(cur)
            cur = []
        else:
            cur.append(x)
    out.append(cur)
    return out


def _name(t: list[Token], i: int) -> tuple[tuple[str, ...], int]:
    """A dotted name at i: its parts and what follows; () if there is none."""
    parts: list[str] = []
    while i < len(t) and (t[i].kind == "quoted" or t[i].kind == "word" and (parts or t[i].low not in RESERVED)):
        # a quoted name of some dialects holds the dots itself
        parts += t[i].low.split(".") if t[i].kind == "quoted" and not parts else [t[i].low]
        if i + 1 < len(t) and t[i + 1].text == "." and i + 2 < len(t) and t[i + 2].kind in ("word", "quoted"):
            i += 2
            continue
        i += 1
        break
    return tuple(parts), i


def _is(t: list[Token], i: int, *words: str) -> bool:
    return i + len(words) <= len(t) and all(t[i + k].kind == "word" and t[i + k].low == w for k, w in enumerate(words))


def _starts_query(t: list[Token], i: int) -> bool:
    while i < len(t) and t[i].text == "(":
        i += 1
    return _is(t, i, "select") or _is(t, i, "with")


def parse_query(t: list[Token]) -> Query | None:
    """A query of all tokens t, or None if it is none."""
    ctes: list[tuple[str, tuple[str, ...], Query]] = []
    i = 0
    if _is(t, i, "with"):
        i += 1 + _is(t, 1, "recursive")
        while i < len(t):
            parts, i = _name(t, i)
            cols: tuple[str, ...] = ()
            if i < len(t) and t[i].text == "(":
                j = _close(t, i)
                cols = tuple(x.low for x in t[i + 1 : j] if x.kind in ("word", "quoted"))
                i = j + 1
            if not parts or not _is(t, i, "as"):
                break
            i += 1
            while i < len(t) and t[i].low in ("not", "materialized"):
                i += 1
            if i >= len(t) or t[i].text != "(":
                break
            j = _close(t, i)
            q = parse_query(t[i + 1 : j])
            if q:
                ctes.append((parts[-1], cols, q))
            i = j + 1
            if i < len(t) and t[i].text == ",":
                i += 1
                continue
            break
    branches: list[Select | Query] = []
    for part in _split(t[i:], frozenset(("union", "intersect", "minus", "except"))):
        while part and part[0].low in ("all", "distinct"):
            part = part[1:]
        if not part:
            continue
        if part[0].text == "(" and _starts_query(part, 0):
            q = parse_query(part[1 : _close(part, 0)])
            if q:
                branches.append(q)
        elif _is(part, 0, "select"):
            branches.append(_select(part))
    return Query(ctes, branches) if branches else None


def _star_except(t: list[Token]) -> list[Token]:
    """EXCEPT and EXCLUDE after a star are no set operation."""
    out, i = [], 0
    while i < len(t):
        if t[i].low in ("except", "exclude") and t[i].kind == "word" and out and out[-1].text == "*":
            i += 1
            i = _close(t, i) + 1 if i < len(t) and t[i].text == "(" else i + 1
            continue
        out.append(t[i])
        i += 1
    return out


def _inner_queries(t: list[Token]) -> list[Query]:
    out, i = [], 0
    while i < len(t):
        if t[i].text == "(" and _starts_query(t, i + 1):
            j = _close(t, i)
            q = parse_query(t[i + 1 : j])
            if q:
                out.append(q)
            i = j
        i += 1
    return out


def _select(t: list[Token]) -> Select:
    i = 1
    while i < len(t) and t[i].kind == "word" and t[i].low in ("distinct", "all"):
        i += 1
        if _is(t, i, "on") and i + 1 < len(t) and t[i + 1].text == "(":
            i = _close(t, i + 1) + 1
    if _is(t, i, "top"):
        i += 1
        i = _close(t, i) + 1 if i < len(t) and t[i].text == "(" else i + 1
    depth, j = 0, i
    while j < len(t):
        x = t[j]
        if x.kind == "op" and x.text in "([":
            depth += 1
        elif x.kind == "op" and x.text in ")]":
            depth -= 1
        elif not depth and x.kind == "word" and (x.low in _CLAUSES or x.low == "into") and not (j and t[j - 1].text == "."):
            break
        j += 1
    items = [_item(p) for p in _split(t[i:j], frozenset(",")) if p]
    clauses: dict[str, list[Token]] = {}
    cur = None
    depth = 0
    for x in t[j:]:
        if x.kind == "op" and x.text in "([":
            depth += 1
        elif x.kind == "op" and x.text in ")]":
            depth -= 1
        if not depth and x.kind == "word" and x.low in _CLAUSES and not (x.low == "from" and cur == "from"):
            cur = x.low
            clauses.setdefault(cur, [])
            continue
        if cur:
            clauses[cur].append(x)
    sources, inner = _from(clauses.get("from", []))
    for k, c in clauses.items():
        if k != "from":
            inner += _inner_queries(c)
    return Select(items, sources, inner)


def _from(t: list[Token]) -> tuple[list[Source], list[Query]]:
    sources: list[Source] = []
    inner: list[Query] = []
    for part in _split(t, frozenset((",", "join"))):
        while part and part[-1].kind == "word" and part[-1].low in ("left", "right", "full", "inner", "outer", "cross", "natural", "asof", "semi", "anti"):
            part = part[:-1]
        cut = next((k for k, x in enumerate(part) if x.kind == "word" and x.low in ("on", "using") and not _depth(part, k)), len(part))
        inner += _inner_queries(part[cut:])
        part = part[:cut]
        i = 0
        while _is(part, i, "lateral"):
            i += 1
        if i >= len(part):
            continue
        if part[i].text == "(":
            j = _close(part, i)
            body = part[i + 1 : j]
            if _starts_query(body, 0):
                q = parse_query(body)
                alias, cols = _alias(part, j + 1)
                if q:
                    sources.append(Source(alias, None, q, cols))
            else:
                s, n = _from(body)
                sources += s
                inner += n
            continue
        parts, j = _name(part, i)
        if not parts:
            continue
        if j < len(part) and part[j].text == "(":
            inner += _inner_queries(part[j:])  # a table function brings no table
            continue
        alias, cols = _alias(part, j)
        sources.append(Source(alias or parts[-1], Ref(parts), None, cols))
    return sources, inner


def _depth(t: list[Token], k: int) -> int:
    return sum((x.text == "(") - (x.text == ")") for x in t[:k] if x.kind == "op")


def _alias(t: list[Token], i: int) -> tuple[str, tuple[str, ...]]:
    if _is(t, i, "as"):
        i += 1
    if i < len(t) and (t[i].kind == "quoted" or t[i].kind == "word" and t[i].low not in RESERVED):
        alias, cols = t[i].low, ()
        if i + 1 < len(t) and t[i + 1].text == "(":
            cols = tuple(x.low for x in t[i + 2 : _close(t, i + 1)] if x.kind in ("word", "quoted"))
        return alias, cols
    return "", ()


def _item(t: list[Token]) -> Item:
    alias = None
    body = t
    if len(t) >= 2 and t[-1].kind in ("word", "quoted", "string"):
        prev = t[-2]
        if prev.kind == "word" and prev.low == "as":
            alias, body = t[-1].low.strip("'"), t[:-2]
        elif t[-1].kind != "string" and (prev.kind in ("word", "quoted", "number", "string") and prev.low not in RESERVED or prev.low in ("end", "null", "true", "false") or prev.text in ")]") and (t[-1].kind == "quoted" or t[-1].low not in RESERVED) and not (prev.kind == "word" and prev.low in _TYPED and len(t) == 2 and t[-1].kind == "string"):
            alias, body = t[-1].low, t[:-1]
    if body and body[0].text == "*" and len(body) >= 1:
        return Item(None, star="")
    if len(body) >= 3 and body[-1].text == "*" and body[-2].text == ".":
        return Item(None, star=".".join(x.low for x in body[:-2] if x.text != "."))
    it = Item(alias)
    i = 0
    while i < len(body):
        x = body[i]
        if x.text == "(" and _starts_query(body, i + 1):
            j = _close(body, i)
            q = parse_query(body[i + 1 : j])
            if q:
                it.queries.append(q)
            i = j + 1
            continue
        if x.kind == "word" and x.low == "as" and i + 1 < len(body):  # a type
            i += 2
            continue
        if x.text == "::" and i + 1 < len(body):
            i += 2
            continue
        if x.text == ":" and i + 1 < len(body):  # a path into a value
            i += 2
            while i + 1 < len(body) and body[i].text == ".":
                i += 2
            continue
        if x.kind == "quoted" or x.kind == "word" and x.low not in RESERVED:
            parts, j = _name(body, i)
            if j < len(body) and body[j].text == "(":
                if parts and parts[-1] in AGGREGATES:
                    it.aggregate = True
                i = j
                continue
            nxt = body[j] if j < len(body) else None
            if x.kind == "word" and nxt is not None and (nxt.kind == "string" or nxt.text == "=>"):
                i = j
                continue
            if parts and not x.text.startswith(("@", "$", ":")):
                it.columns.append((".".join(parts[:-1]) or None, parts[-1]))
            i = max(j, i + 1)
            continue
        i += 1
    it.plain = len(it.columns) == 1 and len(_name(body, 0)[0]) > 0 and _name(body, 0)[1] == len(body)
    return it


_KINDS = {"select": "SELECT", "with": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "merge": "MERGE"}


def parse_statement(t: list[Token]) -> Parsed:
    """One statement. Never raises on odd input: the kind is then OTHER."""
    t = _star_except(t)
    if not t:
        return Parsed("OTHER")
    head = t[0].low
    while t and t[0].text == "(" and _starts_query(t, 0):
        q = parse_query(t)
        return Parsed("SELECT", query=q)
    if head == "with":
        # WITH may also go before INSERT, UPDATE, DELETE
        i, depth = 1, 0
        while i < len(t):
            depth += (t[i].text == "(") - (t[i].text == ")") if t[i].kind == "op" else 0
            if not depth and t[i].low in ("insert", "update", "delete", "merge") and t[i].kind == "word":
                p = parse_statement(t[i:])
                wrapped = parse_query([*t[:i], *_tail(t[i:])]) if p.query else None
                if wrapped is not None:
                    p.query = wrapped
                return p
            if not depth and t[i].low == "select":
                break
            i += 1
        return Parsed("SELECT", query=parse_query(t))
    if head == "select":
        return Parsed("SELECT", query=parse_query(t), inner=[])
    if head == "insert":
        return _insert(t)
    if head == "create":
        return _create(t)
    if head == "update":
        parts, j = _name(t, 1)
        frm = next((k for k in range(j, len(t)) if _is(t, k, "from") and not _depth(t, k)), None)
        p = Parsed("UPDATE", inner=_inner_queries(t))
        if frm is not None:
            src, inner = _from(_until(t[frm + 1 :], ("where",)))
            p.tables += [s.ref for s in src if s.ref]
        p.tables.insert(0, Ref(parts))
        return p
    if head == "delete":
        i = 1 + _is(t, 1, "from")
        parts, j = _name(t, i)
        return Parsed("DELETE", inner=_inner_queries(t), tables=[Ref(parts)] if parts else [])
    if head == "merge":
        i = 1 + _is(t, 1, "into")
        parts, j = _name(t, i)
        p = Parsed("MERGE", inner=_inner_queries(t))
        u = next((k for k in range(j, len(t)) if _is(t, k, "using")), None)
        if u is not None:
            n, _ = _name(t, u + 1)
            if n:
                p.tables.append(Ref(n))
        return p
    if head == "use":
        i = 1
        one = True
        if _is(t, i, "schema"):
            i, one = 2, False
        elif i < len(t) and t[i].low in ("database", "warehouse", "role", "catalog", "secondary"):
            return Parsed("OTHER")
        parts, _ = _name(t, i)
        if parts and (not one or len(parts) > 1):
            return Parsed("OTHER", schema=parts[-1])
        return Parsed("OTHER")
    if head in ("begin", "declare", "do"):
        b = next((k for k, x in enumerate(t) if x.kind == "word" and x.low == "begin"), None)
        if b is not None:
            return Parsed("OTHER", body=t[b + 1 :])
    return Parsed("OTHER", ddl=head in ("alter", "drop", "comment", "grant", "truncate"))


def _until(t: list[Token], words: tuple[str, ...]) -> list[Token]:
    for k, x in enumerate(t):
        if x.kind == "word" and x.low in words and not _depth(t, k):
            return t[:k]
    return t


def _tail(t: list[Token]) -> list[Token]:
    """The query part of an INSERT ... SELECT."""
    depth = 0
    for k, x in enumerate(t):
        if x.kind == "op":
            depth += (x.text == "(") - (x.text == ")")
        if not depth and x.low == "select" and x.kind == "word":
            return t[k:]
    return []


def _insert(t: list[Token]) -> Parsed:
    i = 1
    while i < len(t) and t[i].kind == "word" and t[i].low in ("into", "overwrite", "table", "ignore", "all", "first"):
        i += 1
    parts, j = _name(t, i)
    cols = None
    if j < len(t) and t[j].text == "(" and not _starts_query(t, j + 1):
        k = _close(t, j)
        cols = [x.low for x in t[j + 1 : k] if x.kind in ("word", "quoted")]
        j = k + 1
    rest = t[j:]
    q = parse_query(rest) if rest and (_starts_query(rest, 0)) else None
    if q is None and rest and rest[0].text == "(" and _starts_query(rest, 1):
        q = parse_query(rest[1 : _close(rest, 0)])
    return Parsed("INSERT", Ref(parts) if parts else None, cols, q, inner=[] if q else _inner_queries(rest))


def _create(t: list[Token]) -> Parsed:
    i = 1
    temp = False
    if _is(t, i, "or", "replace"):
        i += 2
    while i < len(t) and t[i].kind == "word" and t[i].low in ("temporary", "temp", "transient", "external", "materialized", "secure", "recursive", "local", "global", "volatile", "force", "dynamic", "hybrid", "iceberg"):
        temp = temp or t[i].low in ("temporary", "temp", "volatile")
        i += 1
    what = t[i].low if i < len(t) else ""
    if what in ("procedure", "function", "proc"):
        b = next((k for k, x in enumerate(t) if x.kind == "word" and x.low == "begin"), None)
        return Parsed("CREATE_PROC", body=t[b + 1 :] if b is not None else [])
    if what not in ("table", "view"):
        return Parsed("OTHER", ddl=True)
    i += 1
    if _is(t, i, "if", "not", "exists"):
        i += 3
    parts, j = _name(t, i)
    p = Parsed("CREATE_VIEW" if what == "view" else "CREATE_TABLE", Ref(parts) if parts else None, temp=temp and what == "table", role="view" if what == "view" else "table")
    if j < len(t) and t[j].low in ("clone", "like") and t[j].kind == "word":
        n, _ = _name(t, j + 1)
        p.donor = Ref(n) if n else None
        p.ddl = True
        return p
    if j < len(t) and t[j].text == "(" and not _starts_query(t, j + 1):
        k = _close(t, j)
        cols = []
        for d in _split(t[j + 1 : k], frozenset(",")):
            if d and (d[0].kind == "quoted" or d[0].kind == "word" and d[0].low not in ("constraint", "primary", "foreign", "unique", "check", "like", "index", "key")):
                cols.append(d[0].low)
        p.columns = cols
        j = k + 1
    a = next((k for k in range(j, len(t)) if _is(t, k, "as") and not _depth(t, k)), None)
    if a is not None and _starts_query(t, a + 1):
        body = t[a + 1 :]
        p.query = parse_query(body) if body[0].text != "(" else parse_query(body[1 : _close(body, 0)]) or parse_query(body)
    elif j < len(t) and t[j].text == "(" and _starts_query(t, j + 1):
        p.query = parse_query(t[j + 1 : _close(t, j)])
    p.ddl = p.query is None
    return p
