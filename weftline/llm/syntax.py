"""Source files that do not parse: minimum-cost repair by error-correcting chart
parsing over token classes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

DIALECTS = ("ansi", "snowflake", "bigquery", "postgres", "tsql")

# ---------------------------------------------------------------- token classes
# One character per token. Small letters: n name, l literal, e other scalar
# expression, p predicate, q equality whose left side is a name, a item with an
# alias, b name with an alias, j joins with their conditions, r subquery in
# parentheses, m conflict marker line, u comment that never ends, ? what no token of the dialect can be.
# Keywords have characters of the private-use area.
_KEYWORDS = """select from where group by having order qualify limit offset fetch first next rows only union
intersect minus except all distinct top as on using join left right full inner outer cross natural lateral and or not in is
null like ilike rlike regexp escape between exists case when then else end cast insert into values overwrite update set
delete merge matched create replace temporary temp transient external materialized recursive table view schema database
function procedure index unique primary key foreign references constraint check default if drop alter add column rename to
truncate use declare do begin commit rollback with over partition asc desc nulls last clone comment grant revoke call
execute immediate copy explain returning for percent interval exclude return returns language cascade restrict sequence row
window any some within ties transaction ignore respect""".split()
K = {w: chr(0xE000 + i) for i, w in enumerate(_KEYWORDS)}
_ANY_KW = f"[{chr(0xE000)}-{chr(0xE000 + len(_KEYWORDS))}]"

#: Words that are keywords only after (or before) certain tokens; elsewhere they
#: are names. Values: what must come before, what must follow ('' for anything).
_CONTEXT: dict[str, tuple[str, str]] = {
    "top": ("select distinct", ""),
    "first": ("fetch nulls", ""),
    "next": ("fetch", ""),
    "last": ("nulls", ""),
    "clone": ("n", "n"),
    "schema": ("use create drop alter", ""),
    "database": ("use create drop alter", ""),
    "view": ("create replace temporary temp materialized drop alter recursive", ""),
    "index": ("create drop unique", ""),
    "sequence": ("create drop", ""),
    "procedure": ("create replace drop", ""),
    "function": ("create replace drop temporary temp", ""),
    "temporary": ("create replace", ""),
    "temp": ("create replace", ""),
    "transient": ("create replace", ""),
    "external": ("create replace", ""),
    "materialized": ("create replace", ""),
    "recursive": ("with", ""),
    "overwrite": ("insert", ""),
    "matched": ("when not", ""),
    "key": ("primary foreign", ""),
    "column": ("add drop alter rename comment", ""),
    "percent": ("l )", ""),
    "only": ("rows row", ""),
    "ties": ("with", ""),
    "immediate": ("execute", ""),
    "window": ("n e p q l )", "n"),
    "transaction": ("begin commit rollback", ""),
    "nulls": ("asc desc n e l ) ignore respect", "first last n"),
    "exclude": ("*", ""),
    "replace": ("or *", ""),
    "ignore": (")", ""),
    "respect": (")", ""),
    "rows": ("l first next ( n e asc desc ) ,", "only between n l"),
    "row": ("l first next for each", "only"),
    "if": ("table view schema exists database index function procedure column sequence ;", ""),
    "language": (") n l", "n"),
    "returns": (")", ""),
    "within": ("e )", "group"),
    "copy": ("", "into"),
    "comment": ("", "on"),
    "add": ("n ,", ""),
    "rename": ("n", "to column"),
    "call": ("", "n"),
    "offset": ("n e l ) p q", "l n ("),
    "cascade": ("n", ""),
    "restrict": ("n", ""),
    "interval": ("", "l"),
    "lateral": (", join from", ""),
    "fetch": ("", "first next"),
}

#: Constructs and the dialects that have them.
_ONLY: dict[str, tuple[str, ...]] = {
    "qualify": ("snowflake", "bigquery"),
    "top": ("tsql", "snowflake"),
    "limit": ("snowflake", "bigquery", "postgres"),
    "clone": ("snowflake", "bigquery"),
    "ilike": ("snowflake", "postgres"),
    "exclude": ("snowflake",),
    "do": ("postgres",),
    "minus": ("snowflake",),
    "returning": ("postgres", "snowflake"),
    "overwrite": ("snowflake",),
}

_STRING = {
    "ansi": r"'(?:[^']|'')*'",
    "tsql": r"'(?:[^']|'')*'",
    "postgres": r"[eE]'(?:[^'\\]|\\.|'')*'|'(?:[^']|'')*'|\$(?P<tag>(?:[A-Za-z_]\w*)?)\$.*?\$(?P=tag)\$",
    "snowflake": r"'(?:[^'\\]|\\.|'')*'|\$\$.*?\$\$",
    "bigquery": r"'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"",
}
_QUOTED = {"ansi": r'"(?:[^"]|"")+"', "postgres": r'"(?:[^"]|"")+"', "snowflake": r'"(?:[^"]|"")+"', "bigquery": r"`[^`\n]+`", "tsql": r'"(?:[^"]|"")+"|\[(?:[^\]]|\]\])+\]'}
_COMMENT = {
    "ansi": r"--[^\n]*|/\*.*?\*/",
    "tsql": r"--[^\n]*|/\*.*?\*/",
    "postgres": r"--[^\n]*|/\*.*?\*/",
    "snowflake": r"--[^\n]*|//[^\n]*|/\*.*?\*/",
    "bigquery": r"--[^\n]*|\#[^\n]*|/\*.*?\*/",
}
_MARK = r"^[ \t]*(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^[ \t]*={7}[ \t]*\r?$"
_FIRST = {d: re.compile(rf"(?P<s>{_STRING[d]})|(?P<q>{_QUOTED[d]})|(?P<c>{_COMMENT[d]})|(?P<m>{_MARK})|(?P<u>/\*)", re.S | re.M) for d in DIALECTS}
# \x01 literal, \x02 quoted name, \x03 marker line, \x04 comment never closed
_SHORT = {"s": " \x01 ", "q": " \x02 ", "c": " ", "m": " \x03 ", "u": " \x04 "}
_REST = re.compile(r"[^\W\d][\w$#]*|\d+(?:\.\d*)?(?:e[+-]?\d+)?\w*|[@#$:][\w$@]+|<=>|<>|<=|>=|!=|\|\||::|->>|->|=>|:=|\S")


class _Classes(dict):
    """Token -> class character of one dialect; unknown words are names."""

    def __init__(self, dialect: str) -> None:
        super().__init__()
        d = dialect
        self.update({w: c for w, c in K.items() if d in _ONLY.get(w, DIALECTS)})
        self.update({"\x01": "l", "\x02": "n", "\x03": "m", "\x04": "u", "true": "l", "false": "l", "current_date": "l", "current_timestamp": "l"})
        self.update({w: K["cast"] for w in ("try_cast", "safe_cast")})
        self.update({c: c for c in "(),.;*+-/%=[]"})
        self.update({o: "<" for o in ("<", ">", "<=", ">=", "<>", "!=", "<=>")})
        self.update({"||": "|", "=>": "g", ":=": "w"})
        self["::"] = "c" if d in ("snowflake", "postgres") else "?"
        self[":"] = ":" if d in ("snowflake",) else "?"
        self.update({"->": "|", "->>": "|", "~": "<", "^": "+", "&": "+"} if d == "postgres" else {})
        if d == "tsql":
            self.update({"^": "+", "&": "+"})
        self.dialect = d

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c.isdigit():
            return "l" if re.fullmatch(r"\d+(\.\d*)?(e[+-]?\d+)?", t) else "?"
        if c.isalpha() or c == "_":
            kind = "n"
        elif c == "@" and len(t) > 1:
            kind = "n" if self.dialect in ("tsql", "snowflake") else "?"
        elif c == "#" and len(t) > 1:
            kind = "n" if self.dialect == "tsql" else "?"
        elif c == "$" and len(t) > 1:
            kind = "n" if self.dialect in ("snowflake", "postgres") else "?"
        elif c == ":" and len(t) > 1:  # a path step, or a bound variable
            return ":n" if self.dialect == "snowflake" else "?"
        else:
            kind = "?"
        if len(self) < 200_000:
            self[t] = kind
        return kind


_CLASS = {d: _Classes(d) for d in DIALECTS}


def _pat(spec: str) -> str:
    """A pattern over classes: {word} is a keyword's character."""
    return re.sub(r"\{(\w+)\}", lambda m: K[m[1]], spec)


def _context_rules() -> list[tuple[str, re.Pattern]]:
    out = []
    for w, (before, after) in _CONTEXT.items():
        cls = lambda s: "".join(K.get(x, re.escape(x)) for x in s.split())
        bad = []
        if before:
            bad.append(f"(?<![{cls(before)}]){K[w]}")
        if after:
            bad.append(f"{K[w]}(?![{cls(after)}])")
        out.append((K[w], re.compile("|".join(bad))))
    return out


_CONTEXT_RULES = _context_rules()

_NEXT = r"(?![(.:c\[+\-*/%|]|{over}|{within})"  # what would carry an operand on
_PREV = r"(?<![.:+\-*/%|<=c])"
_V, _B, _L = "[nle]", "[pq]", "[nlepqab]"


def _rule(spec: str, to) -> tuple[re.Pattern, object]:
    return re.compile(_pat(spec)), to


def _list(m: re.Match) -> str:
    kinds = set(m[0]) - {","}
    if len(kinds) == 1:
        k = kinds.pop()
    elif "a" in kinds:
        k = "a"
    elif "b" in kinds:
        k = "b" if kinds <= {"n", "b"} else "a"
    else:
        k = "e"
    return f"{k},{k}"


# Every replacement below stands for a phrase of the grammar further down that
# is complete where it stands, so a text is valid after it if and only if it was
# before. They make equal the many spellings of one statement shape, so the
# chart parser sees each shape once.
_ONCE = [
    _rule(rf"\.{_ANY_KW}", ".n"),
    _rule(r"n(?:\.n)+", "n"),
    _rule(r"n\.\*", "*"),
    _rule(r"(?<!{is})(?<!{is}{not})(?<!{not}){null}", "l"),
    _rule(r"{group}{by}", K["group"]),
    _rule(r"{order}{by}", K["order"]),
    _rule(r"{partition}{by}", K["partition"]),
    _rule(r"(?:{inner}|(?:{left}|{right}|{full}){outer}?){join}", K["join"]),
    _rule(r"{interval}l", "l"),
]
_COLON = _rule(r"[ne](?::n(?:\.n)*)+(?:\[l\])*", "e")
_LOOP = [
    _rule(rf"(?<=c)n\(l(?:,l)?\)", "n"),
    _rule(rf"{_V}cn(?!\()", "e"),
    _rule(rf"{{cast}}\([nlepq]{{as}}n(?:\(l(?:,l)?\))?\)", "e"),
    _rule(r"\[(?:[nle](?:,[nle])*)?\]", "e"),
    _rule(rf"(?<![{{into}}{{table}}{{view}}{{exists}}{{as}}{{with}}{{update}}{{references}}n{{overwrite}}{{function}}{{procedure}}])n\((?:\*|{{distinct}}?[nlepqr](?:,[nlepqr])*)?\)(?!{{as}}[(r])", "e"),
    _rule(rf"e{{over}}\((?:{{partition}}{_L}(?:,{_L})?)?(?:{{order}}[nlepq](?:{{asc}}|{{desc}})?(?:,[nlepq](?:{{asc}}|{{desc}})?)*)?\)", "e"),
    _rule(rf"(?<=[+\-*/%|<=({{select}}{{when}}{{then}}{{else}}{{and}}{{or}}{{not}}{{where}}{{between}}{{having}}])\([nle]\)", "e"),
    _rule(rf"{_V}(?:[+\-*/%|]{_V})+{_NEXT}", "e"),
    _rule(rf"{{case}}(?:{{when}}{_B}{{then}}[nlepq])+(?:{{else}}[nlepq])?{{end}}", "e"),
    _rule(rf"{{case}}{_V}(?:{{when}}{_V}{{then}}[nlepq])+(?:{{else}}[nlepq])?{{end}}", "e"),
    _rule(rf"{_PREV}{_V}{{not}}?{{between}}{_V}{{and}}{_V}{_NEXT}(?![<=])", "p"),
    _rule(rf"{_PREV}{_V}{{not}}?{{in}}\([nle](?:,[nle])*\)", "p"),
    _rule(rf"{_PREV}{_V}{{not}}?{{in}}r", "p"),
    _rule(rf"{{exists}}r", "p"),
    _rule(rf"{_PREV}{_V}{{is}}{{not}}?{{null}}", "p"),
    _rule(rf"{_PREV}{_V}{{not}}?(?:{{like}}|{{ilike}}|{{rlike}}){_V}{_NEXT}(?!{{escape}})", "p"),
    _rule(rf"{_PREV}n={_V}{_NEXT}(?![<={{between}}{{in}}{{is}}{{like}}{{not}}])", "q"),
    _rule(rf"{_PREV}{_V}[<=]{_V}{_NEXT}(?![<={{between}}{{in}}{{is}}{{like}}{{not}}])", "p"),
    _rule(rf"(?<=[{{and}}{{or}}{{where}}{{on}}{{having}}{{not}}({{when}}{{qualify}}])\({_B}\)", "p"),
    _rule(rf"{{not}}{_B}", "p"),
    _rule(rf"{_B}(?:(?:{{and}}|{{or}}){_B})+", "p"),
    _rule(rf"[lepq]{{as}}n(?!\()", "a"),
    _rule(rf"n{{as}}n(?!\()", "b"),
    (re.compile(_pat(rf"(?<![+\-*/%|<=.:cnlepqabr){{between}}{{as}}])[nlepqab](?:,[nlepqab])+{_NEXT}(?![<=nlepqabr{{between}}{{in}}{{is}}{{like}}{{not}}{{as}}{{and}}{{or}}])")), _list),
    _rule(rf"(?<={{values}})\([nle](?:,[nle])*\)(?:,\([nle](?:,[nle])*\))*", "(e)"),
    _rule(rf"{{join}}(?:nn|n|b|rn|r{{as}}n){{on}}{_B}(?!{{and}}|{{or}})", "j"),
    _rule(r"jj+", "j"),
    _rule(rf"\({{select}}{{distinct}}?(?:\*|{_L}(?:,{_L})?){{from}}(?:nn|n|b)j?(?:{{where}}{_B})?(?:{{group}}[nlepq](?:,[nlepq])?)?\)", "r"),
]


def _needs(pattern: str) -> str:
    """A keyword without which the pattern of a rule cannot match, if it begins
    with one after an operand; such a rule is skipped in texts without it."""
    for w in ("case", "cast", "between", "exists", "is", "in", "like", "as", "join"):
        for head in (K[w], f"e{K[w]}", f"n{K[w]}", f"[lepq]{K[w]}", f"{_PREV}{_V}{K[w]}", f"{_PREV}{_V}{K['not']}?{K[w]}", f"{_PREV}{_V}{K['is']}"):
            if pattern.startswith(head) and K[w] in head:
                return K[w]
    return ""


_GUARDED = [(_needs(p.pattern), p, to) for p, to in _LOOP]


def classes(text: str, dialect: str) -> str:
    """The text as one class character per token."""
    first = _FIRST[dialect].sub(lambda m: _SHORT[m.lastgroup or "s"], text.lower() if dialect != "postgres" else text)
    return "".join(map(_CLASS[dialect].__getitem__, _REST.findall(first.lower())))


def _in_context(cls: str) -> str:
    """Keywords that stand where they are none become names."""
    for w, p in _CONTEXT_RULES:
        if w in cls:
            cls = p.sub("n", cls)
    return cls


def shapes(cls: str, dialect: str) -> str:
    """Class strings with complete phrases replaced by their class. Statements
    are set apart by semicolons and texts by line ends, which no rule crosses,
    so a whole batch goes through each rule at once."""
    cls = _in_context(cls)
    for p, to in _ONCE:
        cls = p.sub(to, cls)
    if dialect == "snowflake" and ":" in cls:
        cls = _COLON[0].sub(_COLON[1], cls)
    before = ""
    while before != cls:
        before = cls
        for need, p, to in _GUARDED:
            if not need or need in cls:
                cls = p.sub(to, cls)
    return cls


# --------------------------------------------------------------------- grammar
# Symbols: words in capitals are keywords or the classes NAME LIT EXPR PRED EQ
# AEXPR ANAME JOINS SUBQ, quoted signs are themselves. ? * + and ( ) as usual.
_GRAMMAR = """
batch: stmt | stmt batch
stmt: query | insert | update | delete | merge | create | drop | alter | other
query: with? body (ORDER oitem (',' oitem)*)? limit?
with: WITH RECURSIVE? cte (',' cte)*
cte: NAME ('(' names ')')? AS '(' query ')' | NAME ('(' names ')')? AS SUBQ
body: sel | body setop body | '(' query ')' | SUBQ | VALUES row (',' row)*
setop: (UNION | INTERSECT | EXCEPT | MINUS) (ALL | DISTINCT)?
sel: SELECT quant? items (INTO NAME)? from? where? group? having? qual?
quant: DISTINCT | ALL | DISTINCT ON '(' list ')' | TOP LIT PERCENT? | TOP '(' x ')' PERCENT? | DISTINCT TOP LIT
items: item (',' item)*
item: any | any AS? NAME | any AS LIT | AEXPR | ANAME | '*' | '*' (EXCEPT | EXCLUDE) ('(' names ')' | EXPR | NAME) | '*' REPLACE '(' items ')'
from: FROM tab (',' tab)*
tab: prim join*
prim: NAME | NAME NAME | ANAME | NAME AS NAME | (SUBQ | '(' query ')') (AS? NAME ('(' names ')')?)? | LATERAL? EXPR (AS? NAME)? | LATERAL EXPR | NAME '(' args? ')' (AS? NAME)? | '(' tab ')' | LATERAL '(' query ')' AS? NAME | AEXPR
join: JOINS | JOIN prim ON pred | JOIN prim USING '(' names ')' | JOIN prim USING EXPR | CROSS JOIN prim | NATURAL JOIN prim
where: WHERE pred
group: GROUP (list | ALL)
having: HAVING pred
qual: QUALIFY pred
limit: LIMIT x (OFFSET x)? | OFFSET x (ROWS fetch?)? | fetch | LIMIT x ',' x
fetch: FETCH (FIRST | NEXT) LIT? (ROWS | ROW) ONLY
oitem: any (ASC | DESC)? (NULLS (FIRST | LAST))?
list: listitem (',' listitem)*
listitem: any | '(' list? ')'
names: NAME (',' NAME)*
row: '(' list ')'
any: x | pred
x: NAME | LIT | EXPR | SUBQ | x op x | '-' x | '+' x | '(' any ')' | '(' query ')' | NAME '(' args? ')' over? | EXPR over | CASE whens (ELSE any)? END | CASE x xwhens (ELSE any)? END | CAST '(' any AS type ')' | x 'c' type | x ':' NAME | '[' list? ']' | x '[' x ']' | NAME LIT | INTERVAL x NAME
op: '+' | '-' | '*' | '/' | '%' | '|'
whens: WHEN pred THEN any | whens whens
xwhens: WHEN x THEN any | xwhens xwhens
args: '*' | DISTINCT? arg (',' arg)* (ORDER oitem (',' oitem)*)? | query
arg: any | NAME 'g' any | any AS NAME | AEXPR | ANAME
over: OVER '(' (PARTITION list)? (ORDER oitem (',' oitem)*)? frame? ')' | OVER NAME | WITHIN GROUP '(' ORDER oitem ')'
frame: ROWS (BETWEEN bound AND bound | bound)
bound: NAME NAME | LIT NAME
pred: PRED | EQ | x cmp x | x NOT? IN '(' list ')' | x NOT? IN SUBQ | x NOT? IN '(' query ')' | x NOT? IN EXPR | x NOT? IN NAME '(' args? ')' | x NOT? BETWEEN x AND x | x IS NOT? (NULL | LIT) | NOT pred | pred AND pred | pred OR pred | '(' pred ')' | EXISTS '(' query ')' | EXISTS SUBQ | x NOT? (LIKE | ILIKE | RLIKE | REGEXP) x (ESCAPE LIT)? | x cmp (ANY | ALL | SOME) (SUBQ | '(' query ')') | x IS NOT? DISTINCT FROM x
cmp: '=' | '<'
type: NAME ('(' LIT (',' LIT)? ')')? | EXPR | NAME NAME
insert: with? INSERT (INTO | OVERWRITE INTO? | OVERWRITE? INTO) TABLE? NAME ('(' names ')')? (query | SUBQ) ret? | with? INSERT INTO NAME ('(' names ')')? DEFAULT VALUES
ret: RETURNING items
update: with? UPDATE NAME (AS? NAME)? SET sets from? where? ret? | UPDATE ANAME SET sets from? where?
sets: set (',' set)*
set: EQ | NAME '=' any | NAME '=' DEFAULT | '(' names ')' '=' '(' query ')'
delete: with? DELETE FROM (NAME (AS? NAME)? | ANAME) (USING tab)? where? ret? | DELETE NAME FROM tab where? | DELETE NAME where?
merge: MERGE INTO? (NAME (AS? NAME)? | ANAME) USING prim ON pred mwhen+
mwhen: WHEN NOT? MATCHED (AND pred)? (NAME NAME)? THEN (UPDATE SET sets | DELETE | INSERT ('(' names ')')? VALUES row)
create: CREATE (OR REPLACE)? mods? TABLE ine? NAME cbody opts? | CREATE (OR REPLACE)? mods? VIEW ine? NAME ('(' names ')')? AS query (WITH NAME NAME)? | CREATE SCHEMA ine? NAME | CREATE DATABASE ine? NAME | CREATE (OR REPLACE)? (FUNCTION | PROCEDURE) NAME '(' params? ')' fopts | CREATE UNIQUE? INDEX ine? NAME? ON NAME '(' list ')' | CREATE UNIQUE? INDEX ine? NAME ON EXPR | CREATE SEQUENCE ine? NAME | CREATE (OR REPLACE)? mods? VIEW ine? NAME AS SUBQ
mods: TEMPORARY | TEMP | TRANSIENT | EXTERNAL | MATERIALIZED | RECURSIVE
ine: IF NOT EXISTS
cbody: AS query | AS SUBQ | '(' cols ')' (AS query)? | CLONE NAME | LIKE NAME | '(' names ')' AS query | EXPR
opts: NAME '=' x opts? | EQ opts? | PARTITION list opts? | NAME BY '(' list ')' opts? | COMMENT '=' LIT
cols: coldef (',' coldef)*
coldef: NAME type colopt* | CONSTRAINT NAME tcons | tcons
colopt: NOT? NULL | NOT LIT | LIT | PRIMARY KEY | UNIQUE | DEFAULT x | REFERENCES NAME ('(' names ')')? | CHECK '(' pred ')' | COMMENT LIT | CHECK PRED
tcons: PRIMARY KEY '(' names ')' | UNIQUE '(' names ')' | FOREIGN KEY '(' names ')' REFERENCES NAME ('(' names ')')? | CHECK '(' pred ')'
params: NAME type (',' NAME type)*
fopts: RETURNS type? (TABLE '(' cols ')')? fopts? | LANGUAGE NAME fopts? | AS LIT | NAME fopts? | AS BEGIN
drop: DROP (TABLE | VIEW | SCHEMA | DATABASE | FUNCTION | PROCEDURE | INDEX | SEQUENCE) (IF EXISTS)? NAME (CASCADE | RESTRICT)?
alter: ALTER (TABLE | VIEW | SCHEMA) (IF EXISTS)? NAME (ADD COLUMN? ine? coldef | ADD CONSTRAINT NAME tcons | DROP COLUMN? (IF EXISTS)? NAME | RENAME TO NAME | RENAME COLUMN NAME TO NAME | ALTER COLUMN NAME type | SET opts | ALTER COLUMN NAME SET colopt)
other: USE (SCHEMA | DATABASE)? NAME | TRUNCATE TABLE? NAME | DECLARE NAME type ('=' x | DEFAULT x)? | DECLARE NAME type | DECLARE EQ | DECLARE NAME EQ | DECLARE NAME NAME 'w' x | SET NAME '=' x | SET EQ | DO LIT | CALL EXPR | CALL NAME '(' args? ')' | BEGIN TRANSACTION? | COMMIT | ROLLBACK | EXPLAIN stmt | GRANT items ON TABLE? NAME TO NAME | COMMENT ON (TABLE | COLUMN | VIEW) NAME IS LIT | EXECUTE IMMEDIATE (LIT | NAME | EXPR) | EXECUTE NAME | COPY INTO NAME FROM (NAME | LIT) opts? | NAME 'w' x
"""
#: Symbols of single tokens, where phrases are not replaced by their class.
_TOKENS = """
jn: (INNER | (LEFT | RIGHT | FULL) OUTER?)? JOIN
nm: NAME | nm '.' NAME
lit: LIT | NULL | INTERVAL LIT
star: '*' | nm '.' '*'
"""
_PLAIN = {"GROUP": "GROUP BY", "ORDER": "ORDER BY", "PARTITION": "PARTITION BY", "JOIN": "jn", "NAME": "nm", "LIT": "lit"}


def _token_grammar() -> str:
    """The grammar over single tokens: dotted names, two-word keywords and kinds
    of join are phrases of several tokens in it."""
    out = []
    for line in _GRAMMAR.strip().splitlines():
        head, _, body = line.partition(": ")
        if head in ("item", "args"):
            body = body.replace("'*'", "star")
        for word, to in _PLAIN.items():
            body = re.sub(rf"\b{word}\b(?=[?*+])", f"({to})", body)
            body = re.sub(rf"\b{word}\b(?![ ]BY\b|\)[?*+])", to, body)
        out.append(f"{head}: {body}")
    return "\n".join(out) + _TOKENS


_CLASSES = {"NAME": "n", "LIT": "l", "EXPR": "e", "PRED": "p", "EQ": "q", "AEXPR": "a", "ANAME": "b", "JOINS": "j", "SUBQ": "r"}
BIG = 9_999


class Spans:
    """The costs of all spans of one length, by start and symbol. Symbols that
    cost more than the bound in all of them are not kept."""

    def __init__(self, costs: np.ndarray, big: int) -> None:
        """costs: rows are symbols; big is what stands for more than the bound."""
        kept = np.flatnonzero((costs < big).any(axis=1))
        self.at = np.full(len(costs), -1)
        self.at[kept] = np.arange(len(kept))
        # the row of all others is the last one
        self.costs = np.concatenate([costs[kept], np.full((1, costs.shape[1]), big, dtype=costs.dtype)])

    def __getitem__(self, key):
        """[i, a], or [i] for the costs of all symbols."""
        if isinstance(key, tuple):
            return int(self.costs[self.at[key[1]], key[0]])
        return self.costs[self.at, key].astype(np.promote_types(self.costs.dtype, np.int16))


class Grammar:
    """The grammar in binary rules with the cost of inserting each symbol."""

    def __init__(self, text: str, phrases: bool = True) -> None:
        """phrases: whether classes of whole phrases are tokens that an edit may
        bring in."""
        self.index: dict[object, int] = {}
        self.terminal: dict[str, int] = {}
        rules: set[tuple[int, int, int]] = set()
        unary: set[tuple[int, int]] = set()
        empty: set[int] = set()
        count = 0

        def sym(k: object) -> int:
            return self.index.setdefault(k, len(self.index))

        def term(c: str) -> int:
            i = sym(("t", c))
            self.terminal[c] = i
            return i

        def chain(head: int, seq: list[int]) -> None:
            if not seq:
                empty.add(head)
            elif len(seq) == 1:
                unary.add((head, seq[0]))
            else:
                rest = seq[1] if len(seq) == 2 else sym(("seq", *seq[1:]))
                rules.add((head, seq[0], rest))
                if len(seq) > 2:
                    key = ("made", rest)
                    if key not in made:
                        made.add(key)
                        chain(rest, seq[1:])

        made: set[object] = set()
        for line in text.strip().splitlines():
            head, _, body = line.partition(": ")
            toks = re.findall(r"'[^']+'|\w+|[()|?*+]", body)
            pos = 0

            def alts() -> list[list[int]]:
                nonlocal pos
                out, seq = [], []
                while pos < len(toks) and toks[pos] != ")":
                    t = toks[pos]
                    pos += 1
                    if t == "|":
                        out.append(seq)
                        seq = []
                        continue
                    if t == "(":
                        inner = alts()
                        pos += 1
                        key = ("group", repr(inner))
                        s = sym(key)
                        if key not in made:
                            made.add(key)
                            for a in inner:
                                chain(s, a)
                    elif t[0] == "'":
                        s = term(t[1:-1])
                    elif t in _CLASSES:
                        s = term(_CLASSES[t])
                    elif t.isupper():
                        s = term(K[t.lower()])
                    else:
                        s = sym(t)
                    if pos < len(toks) and toks[pos] in "?*+":
                        q = toks[pos]
                        pos += 1
                        key = (q, s)
                        r = sym(key)
                        if key not in made:
                            made.add(key)
                            if q in "?*":
                                empty.add(r)
                            unary.add((r, s))
                            if q in "*+":
                                rules.add((r, r, s))
                        s = r
                    seq.append(s)
                out.append(seq)
                return out

            for a in alts():
                chain(sym(head), a)
        n = self.n = len(self.index)
        self.starts = {d: self.index["batch" if d == "tsql" else "stmt"] for d in DIALECTS}
        # least number of tokens in a phrase of each symbol: what inserting it costs
        null = np.full(n, BIG)
        null[list(empty)] = 0
        # a phrase is no single token, and nothing stands for a sign no token is
        self.edits = {c: i for c, i in self.terminal.items() if phrases or c not in "epqabjr"}
        null[list(self.edits.values())] = 1
        while True:
            old = null.copy()
            for a, b in unary:
                null[a] = min(null[a], null[b])
            for a, b, c in rules:
                null[a] = min(null[a], null[b] + null[c])
            if (old == null).all():
                break
        self.null = null
        close = np.full((n, n), BIG)
        np.fill_diagonal(close, 0)
        for a, b in unary:
            close[a, b] = 0
        for a, b, c in rules:
            close[a, b] = min(close[a, b], null[c])
            close[a, c] = min(close[a, c], null[b])
        self.close = _closure(close)
        # chains of free steps count as one step
        direct = close.copy()
        direct[self.close == 0] = 0
        self.step_to, self.step_cost, heads, begin = _steps(direct)
        self.step_head = np.repeat(heads, np.diff(np.append(begin, len(self.step_to))))
        start, end = close.copy(), close.copy()
        for a, b, c in rules:
            start[a, c] = 0
            end[a, b] = 0
        self.steps_start, self.steps_end = _steps(start), _steps(end)
        # of a rule with a token on one side only one split matters; tokens that
        # are removed beside it are taken from the other symbol's edges
        order = sorted(rules)
        tok = set(self.terminal.values())
        self.on_left = _rules([(a, b, c) for a, b, c in order if b in tok])
        self.on_right = _rules([(a, c, b) for a, b, c in order if c in tok and b not in tok])
        self.whole = _rules([(a, b, c) for a, b, c in order if b not in tok and c not in tok])
        self.left = np.array([b for _, b, _ in order])
        self.right = np.array([c for _, _, c in order])
        self.rule_heads = np.array([a for a, _, _ in order])
        self.ids = np.array(sorted(self.edits.values()))
        self.by_head: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for a, b, c in order:
            self.by_head[a].append((b, c))
        self.unary_of: list[list[int]] = [[] for _ in range(n)]
        for a, b in sorted(unary):
            self.unary_of[a].append(b)
        self.by_left: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for a, b, c in order:
            self.by_left[b].append((a, c))
        self.above = [[int(x) for x in np.flatnonzero(self.close[:, b] == 0)] for b in range(n)]

    def table(self, s: str, most: int = BIG - 1) -> list[Spans]:
        """cost[len][i, A]: the least number of edits (a token inserted, removed
        or replaced) that make s[i:i+len] a phrase of A. Costs of more than most
        are told as more than most; symbols and rules that have only such are
        passed over, which is what makes small bounds cheap."""
        n, big = len(s), most + 1
        kind = np.uint8 if big < 128 else np.int16 if big < 16_384 else np.int32  # sums of two fit in
        base = np.full((self.n, n), big, dtype=kind)
        base[self.ids] = 1
        for i, c in enumerate(s):
            if c in self.terminal:
                base[self.terminal[c], i] = 0
        null = np.where(self.null < BIG, np.minimum(self.null, big), big).astype(kind)
        steps = np.minimum(self.step_cost, big).astype(kind)[:, None]
        # a token may also go away
        now = self._closed(np.minimum(base, np.minimum(null + 1, big).astype(kind)[:, None]), steps, big)
        cost = [Spans(np.tile(null[:, None], (1, n + 1)), big), Spans(now, big)]
        (lh, la, lt, lr), (rh, ra, rt, rl), (wh, wa, wl, wr) = self.on_left, self.on_right, self.whole
        first, last = base[lt], base[rt]
        # rules whose left (right) symbol is within the bound, by length, also as
        # bits of a number
        lefts, rights = [None], [None]

        def note(x: Spans) -> None:
            for side, syms in ((lefts, wl), (rights, wr)):
                on = x.at[syms] >= 0
                side.append((on, int.from_bytes(np.packbits(on).tobytes(), "big")))

        note(cost[1])
        for size in range(2, n + 1):
            m = n - size + 1
            here = np.minimum(np.minimum(now[:, :m], now[:, 1 : m + 1]) + kind(1), big)
            for heads, at, x in ((lh, la, first[:, :m] + now[lr, 1 : m + 1]), (rh, ra, last[:, size - 1 :] + now[rl, :m])):
                here[heads] = np.minimum(here[heads], np.minimum.reduceat(x, at, axis=0))
            best = np.full((len(wl), m), big, dtype=kind)
            for k in range(1, size):
                (on, bits), (on2, bits2) = lefts[k], rights[size - k]
                if bits & bits2:
                    r = np.flatnonzero(on & on2)
                    x, y = cost[k], cost[size - k]
                    best[r] = np.minimum(best[r], x.costs[x.at[wl[r]], :m] + y.costs[y.at[wr[r]], k : k + m])
            here[wh] = np.minimum(here[wh], np.minimum.reduceat(best, wa, axis=0))
            now = self._closed(np.minimum(here, kind(big)), steps, big)
            cost.append(Spans(now, big))
            note(cost[-1])
        return cost

    def script(self, t: list[Spans], s: str, start: int) -> list[tuple[str, int]]:
        """The edits of one cheapest repair, in the order of the text: ('+',
        place) for a token missing before the token at that place, ('-', place)
        for one too many, ('~', place) for a wrong one. Of equally cheap repairs
        the one that keeps the earliest tokens is told."""
        out: list[tuple[str, int]] = []
        todo = [(start, 0, len(s), frozenset())]
        while todo:
            a, i, size, past = todo.pop()
            c = int(t[size][i, a])
            if not size:
                out += [("+", i)] * c
                continue
            if not c:  # no edit is in it
                continue
            nxt = self._how(t, s, a, i, size, c, past | {a})
            out += nxt[0]
            todo += nxt[1]
        return sorted(out, key=lambda e: (e[1], e[0]))

    def _how(self, t: list[Spans], s: str, a: int, i: int, size: int, c: int, past: frozenset) -> tuple[list, list]:
        """One way in which cost c of phrase a over s[i:i+size] comes about: its
        edits, and the phrases it leads to."""
        if size == 1 and a in self.ids and c == 1:
            return [("~", i)], []
        for b, d in self.by_head[a]:
            for k in range(size, -1, -1):
                left, right = t[k][i, b], t[size - k][i + k, d]
                if left + right == c and not (k == size and b in past) and not (k == 0 and d in past):
                    return [], [(b, i, k, past if k == size else frozenset()), (d, i + k, size - k, past if k == 0 else frozenset())]
        for b in self.unary_of[a]:
            if t[size][i, b] == c and b not in past:
                return [], [(b, i, size, past)]
        if t[size - 1][i, a] + 1 == c:
            return [("-", i + size - 1)], [(a, i, size - 1, frozenset())]
        if t[size - 1][i + 1, a] + 1 == c:
            return [("-", i)], [(a, i + 1, size - 1, frozenset())]
        raise AssertionError("no way to a cost of the table")

    def _closed(self, t: np.ndarray, steps: np.ndarray, big: int) -> np.ndarray:
        """t, whose rows are symbols, after all unary steps, over the direct ones
        until nothing falls; spans that no longer change are left alone, and so
        are steps to symbols beyond the bound."""
        part = t[:, t.min(axis=0) < big]
        at = np.flatnonzero(t.min(axis=0) < big)
        while len(at):
            on = np.flatnonzero((part < big).any(axis=1)[self.step_to])
            if not len(on):
                break
            heads, begin = np.unique(self.step_head[on], return_index=True)
            low = np.minimum.reduceat(part[self.step_to[on]] + steps[on], begin, axis=0)
            old = part[heads]
            low = np.minimum(low, old)
            fell = np.flatnonzero((low < old).any(axis=0))
            if not len(fell):
                break
            part = part[:, fell]
            part[heads] = low[:, fell]
            at = at[fell]
            t[:, at] = part
        return t

    def recognise(self, s: str, start: int) -> bool:
        """Whether s is a phrase of start without any edit: the zero-cost items of the
        chart, right to left, each with the places where it may end."""
        ends: list[dict[int, int]] = [{} for _ in range(len(s) + 1)]
        by_left, above = self.by_left, self.above
        for i in range(len(s) - 1, -1, -1):
            t = self.terminal.get(s[i])
            if t is None:
                return False
            got = ends[i]
            todo = [(t, 1 << (i + 1))]
            while todo:
                b, m = todo.pop()
                for a in above[b]:
                    have = got.get(a, 0)
                    new = m & ~have
                    if not new:
                        continue
                    got[a] = have | new
                    for head, c in by_left[a]:
                        r, left = 0, new
                        while left:
                            low = left & -left
                            r |= ends[low.bit_length() - 1].get(c, 0)
                            left ^= low
                        if r:
                            todo.append((head, r))
        return bool(ends[0].get(start, 0) >> len(s) & 1)


def _rules(rules: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules by head: heads, where each begins, and both symbols."""
    heads, at = np.unique(np.array([a for a, _, _ in rules]), return_index=True)
    return heads, at, np.array([b for _, b, _ in rules]), np.array([c for _, _, c in rules])


def _steps(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unary steps by head: targets, costs, heads, and where each head begins."""
    c = close.copy()
    np.fill_diagonal(c, BIG)
    here, there = np.nonzero(c < BIG)
    heads, at = np.unique(here, return_index=True)
    return there, c[here, there].astype(np.int16), heads, at


def _closure(edges: np.ndarray) -> np.ndarray:
    """Least cost of reaching each symbol from each other over unary steps."""
    c = edges.copy()
    for k in range(len(c)):
        c = np.minimum(c, c[:, k, None] + c[None, k, :])
    return np.minimum(c, BIG).astype(np.int16)


@lru_cache(maxsize=2)
def grammar(phrases: bool = True) -> Grammar:
    """The grammar over shapes, or over single tokens."""
    return Grammar(_GRAMMAR) if phrases else Grammar(_token_grammar(), False)


@lru_cache(maxsize=100_000)
def _valid(s: str, start: int) -> bool:
    return grammar().recognise(s, start)


def valid(s: str, dialect: str) -> bool:
    """Whether the cheapest repair of a shape costs nothing. Items of the chart
    are made in the order of their cost; when those of cost zero are exhausted
    and the goal is not among them, the cost is not zero."""
    return not s or _valid(s, grammar().starts[dialect])


#: By how much the bound on the cost of a repair grows until the least cost is
#: within it, and the greatest one whose sums fit into a byte.
GROWTH, BYTE = 4, 126
#: Copies of a repeated list element that are kept at first; they double until
#: the cost shows that they are enough.
COPIES = 32
#: Elements, one after the other, that may repeat together.
TOGETHER = 8
#: What begins a list that has no brackets of its own.
_LIST_HEADS = frozenset(K[w] for w in "with select from group order partition values set returning grant limit".split())


def _least(g: Grammar, s: str, start: int, most: int) -> tuple[list[Spans], int]:
    """The chart of s and its least cost, with a bound of most at first. Bounds
    change nothing but the work."""
    most = max(1, most, sum(c not in g.terminal for c in s))  # each of them is an edit
    while True:
        most = BYTE if BYTE // GROWTH < most < BYTE else most
        t = g.table(s, most)
        least = t[len(s)][0, start]
        if least <= most:
            return t, least
        most *= GROWTH


def _guess(shape: str, dialect: str, size: int) -> int:
    """About what a repair of so many tokens with this shape costs."""
    if 2 * len(shape) > size:
        return len(shape) // 8
    g = grammar()
    return _least(g, _fold(shape, COPIES, g.terminal)[0], g.starts[dialect], 1)[1]


def _elements(s: str) -> list[list[tuple[int, int]]]:
    """Places of the elements of each list of s with the comma after them, for
    every depth of brackets; the last element of a list, without a comma, is
    left out, and so is what no list can be told from."""
    out: list[list[tuple[int, int]]] = []
    stack: list[tuple[int, list[tuple[int, int]]]] = []
    begin, seen = 0, []
    for i, c in enumerate(s):
        if c in "([":
            stack.append((begin, seen))
            begin, seen = i + 1, []
        elif c in ")]":
            out.append(seen)
            # of a bracket that nothing opens, what is before it is told apart
            begin, seen = stack.pop() if stack else (i + 1, [])
        elif c == ",":
            seen.append((begin, i + 1))
            begin = i + 1
        elif c in _LIST_HEADS:
            out.append(seen)
            begin, seen = i + 1, []
    return [x for x in [*out, *(f[1] for f in stack), seen] if len(x) > COPIES]


def _balanced(s: str) -> bool:
    open_: list[str] = []
    for c in s:
        if c in "([":
            open_.append(c)
        elif c in ")]" and (not open_ or open_.pop() + c not in ("()", "[]")):
            return False
    return not open_


def _repeats(s: str, signs: dict[str, int]) -> list[tuple[int, int, int, bool]]:
    """(start, length, copies, odd) of what stands in s many times over: elements
    of a list, or (odd) signs that no token of the dialect can be."""
    out = [(m.start(), 1, len(m[0]), True) for m in re.finditer(r"([?mu])\1+", s)]
    for seen in _elements(s):
        text = [s[a:b] for a, b in seen]
        i = 0
        while i < len(text):
            for p in range(1, TOGETHER + 1):
                j = i
                while j + p < len(text) and text[j] == text[j + p]:
                    j += 1
                copies = (j - i) // p + 1
                unit = "".join(text[i : i + p]) if copies > COPIES else ""
                if unit and _balanced(unit) and all(c in signs for c in unit):
                    out.append((seen[i][0], len(unit), copies, False))
                    i += copies * p - 1
                    break
            i += 1
    return out


#: What a round of folding took out: (start in the shorter text, length, copies
#: taken, odd).
Taken = list[tuple[int, int, int, bool]]


def _fold(s: str, copies: int, signs: dict[str, int]) -> tuple[str, list[Taken]]:
    """s with at most so many copies of what repeats, and what each round
    took out. Inner lists come first."""
    rounds = []
    while True:
        parts: list[str] = []
        taken: Taken = []
        at = gone = 0
        for a, size, have, odd in sorted(_repeats(s, signs), key=lambda x: (x[0] + x[1] * x[2], -x[0])):
            if have > copies and a >= at:
                parts.append(s[at : a + size * copies])
                at = a + size * have
                taken.append((a - gone, size, have - copies, odd))
                gone += size * (have - copies)
        if not taken:
            return s, rounds
        s = "".join(parts) + s[at:]
        rounds.append(taken)


def _unfold(edits: tuple[tuple[str, int], ...], rounds: list[Taken], copies: int) -> tuple[tuple[str, int], ...]:
    """Edits of the folded text as those of the whole one: list elements go back
    in after two copies that no edit touches; odd signs go."""
    for taken in reversed(rounds):
        places = {p for _, p in edits}
        moves: list[tuple[int, int]] = []  # places from which edits move, and by how much
        more: list[tuple[str, int]] = []
        gone = 0
        for a, size, less, odd in taken:
            if odd:
                free = copies
                more += [("-", a + copies + gone + x) for x in range(less)]
            else:  # from the comma before a copy to its own
                free = next(c for c in range(2, copies + 1) if places.isdisjoint(range(a + size * (c - 1) - 1, a + size * c)))
            moves.append((a + size * free, size * less))
            gone += size * less
        edits = tuple(sorted([(k, p + sum(by for x, by in moves if p >= x)) for k, p in edits] + more, key=lambda e: (e[1], e[0])))
    return edits


@lru_cache(maxsize=100_000)
def _repair(s: str, dialect: str, phrases: bool, guess: int = 1) -> tuple[int, int, int, tuple[tuple[str, int], ...], bool]:
    """Least cost, shares, edits, and whether the chart was made of s as it is.

    What stands in s many times over is charted with fewer copies. This leaves
    the least cost as it is:

    * Commas at one depth of brackets with no keyword between them that begins a
      list are of one list, as no list begins otherwise. So `, w ,` in a valid
      text, w without other commas at its depth, has a whole element between the
      commas, and the text stays valid with one w more or less there. Each edit
      touches at most two pairs of neighbouring copies; of 2 * cost + 2 copies
      some pair is left as it is, so one copy more or less costs the same.
    * A sign that no token can be costs one edit at least. Where a repair of
      fewer of them costs just that, so does one of all that removes the rest."""
    g = grammar(phrases)
    signs, start, copies = g.terminal, g.starts[dialect], COPIES
    while True:
        short, rounds = _fold(s, copies, signs)
        t, least = _least(g, short, start, guess)
        taken = [x for t in rounds for x in t]
        lists, odd = any(not x[3] for x in taken), any(x[3] for x in taken)
        if (not lists or copies >= 2 * least + 2) and (not odd or least == sum(c not in signs for c in short)):
            before, after = (least - _open_cost(g, t, short, start, least, x) for x in (True, False))
            edits = _unfold(tuple(g.script(t, short, start)), rounds, copies)
            return least + sum(x[2] for x in taken if x[3]), before, after, edits, not rounds
        copies = max(2 * copies, 2 * least + 2 if lists else 0)


def repair(shape: str, dialect: str, tokens: str | None = None) -> tuple[int, int, int, tuple[tuple[str, int], ...], bool]:
    """(cost, share at the start, share at the end, edits, exact) of one
    statement, given its shape and its single tokens: the least number of tokens
    to insert, remove or replace that makes it a statement, by how much that
    falls when tokens missing before the first (after the last) are free, and
    the edits of one cheapest repair with their places. This is so at every
    length.

    exact is false where copies of a repeated list element were left out of the
    chart (see _repair()): the cost is the least there too, but of equally cheap
    repairs another may be told than by a chart of all tokens. Without single
    tokens the shape is repaired, and exact is false."""
    if valid(shape, dialect):
        return 0, 0, 0, (), True
    if not tokens:
        least, before, after, edits, _ = _repair(shape, dialect, True)
        return max(1, least), before, after, edits, False
    least, before, after, edits, whole = _repair(tokens, dialect, False, _guess(shape, dialect, len(tokens)))
    return max(1, least), before, after, edits, whole


def _open_cost(g: Grammar, t: list[Spans], s: str, start: int, most: int, at_start: bool) -> int:
    """Least cost when the tokens that s lacks at its start (or end) are free:
    the spans that touch that side again, with free insertion there. It is at
    most the least cost of s, so what costs more is left out."""
    n = len(s)
    to, cost, heads, at = g.steps_start if at_start else g.steps_end
    near, far = (g.left, g.right) if at_start else (g.right, g.left)
    # by length at that side: costs of the rules' symbols there, and which of
    # them are cheap enough
    kind = t[n][0].dtype
    side = np.empty((n, len(near)), dtype=kind)
    lengths, rules = [], []
    pairs = 0
    edge = np.zeros(g.n, dtype=kind)
    for size in range(1, n + 1):
        cur = t[size][0 if at_start else n - size]
        if size > 1:
            side[size - 2] = edge[near]
            on = np.flatnonzero(side[size - 2] <= most)
            lengths.append(np.full(len(on), size - 2))
            rules.append(on)
            pairs += len(on)
            rest = np.stack([t[size - x][x if at_start else n - size] for x in range(1, size)])
            if pairs * 8 < (size - 1) * len(near):
                k, r = np.concatenate(lengths), np.concatenate(rules)
                np.minimum.at(cur, g.rule_heads[r], side[k, r] + rest[k, far[r]])
            else:
                c = (side[: size - 1] + rest[:, far]).min(axis=0)
                np.minimum.at(cur, g.rule_heads, c)
            cur = np.minimum(cur, edge + 1)
        while True:
            low = np.minimum(np.minimum.reduceat(cur[to] + cost, at), cur[heads])
            if (low == cur[heads]).all():
                break
            cur[heads] = low
        edge = cur
    return int(edge[start])


def _statements(got: str) -> list[list[str]]:
    return [[x for x in f.split(";") if x] for f in got.split("\n")]


def _file_shapes(texts: list[str], dialect: str) -> list[list[str]]:
    """The shapes of each text's statements."""
    return _statements(shapes("\n".join(classes(t, dialect) for t in texts), dialect))


def _file_tokens(text: str, dialect: str) -> list[str]:
    """The single tokens of a text's statements, in step with their shapes."""
    return _statements(_ONCE[0][0].sub(_ONCE[0][1], _in_context(classes(text, dialect))))[0]


#: Of a file in another language at least this part of the tokens is edited, or
#: none of them is a keyword.
LANGUAGE_PART = 0.2
_KEYWORD_SIGNS = frozenset(K.values())


def _verdict(sh: list[str], dialect: str, tokens: list[str] | None = None) -> tuple[int, int, str, str, bool]:
    """(cost, failing statements, kind, edits, exact) of one file. edits has
    `statement:kind place` for each edit of one cheapest repair; exact tells
    whether all costs are (see repair())."""
    total, bad, kind, exact, edits = 0, 0, "", True, []
    if tokens is None or len(tokens) != len(sh):
        tokens = [""] * len(sh)
    for i, x in enumerate(sh):
        c, before, after, script, sure = repair(x, dialect, tokens[i])
        if not c:
            continue
        total += c
        bad += 1
        exact &= sure
        edits += [f"{i}:{k}{p}" for k, p in script]
        if "m" in x:
            kind = "conflict"
        elif not kind and "u" in x:  # a comment that never ends
            kind = "truncated"
        elif not kind and (i == 0 and before or i == len(sh) - 1 and after):
            kind = "truncated"
    if not bad:
        return 0, 0, "", "", True
    size = sum(len(t or x) for t, x in zip(tokens, sh))
    worded = any(c in _KEYWORD_SIGNS for t in sh for c in t)
    if kind not in ("conflict", "language") and bad == len(sh) and (total >= LANGUAGE_PART * size or not worded and "u" not in "".join(sh)):
        kind = "language"
    return total, bad, kind or "syntax", " ".join(edits), exact


def parse_batches(full: bool, keep: bool = False):
    """A function for mapInPandas over (path, repo_path, dialect, content, ...):
    adds cost, n_statements, n_bad, kind and parsed_as, and with full edits and
    exact (see _verdict()). Without full the chart stops when its zero-cost
    items are exhausted: cost is 0 or 1, for at least 1, and kind is null.
    With keep the content of failing files stays, otherwise it goes.

    Null contents give no row; empty ones, and ones of only comments, are valid.
    Without a known dialect the one with the cheapest repair counts. Repeated
    rows stay repeated, other columns stay as they are."""

    def run(batches):
        import pandas as pd

        for b in batches:
            b = b[b["content"].notna()]
            texts, said = b["content"].tolist(), b["dialect"].tolist()
            out: list[tuple | None] = [None] * len(texts)
            todo: dict[str, list[int]] = {}
            for i, d in enumerate(said):
                for x in (d,) if d in DIALECTS else DIALECTS:
                    todo.setdefault(x, []).append(i)
            failing: list[tuple[int, str, list[str]]] = []
            for d, at in todo.items():
                for i, sh in zip(at, _file_shapes([texts[i] for i in at], d)):
                    bad = sum(not valid(x, d) for x in sh)
                    if bad:
                        failing.append((i, d, sh))
                    if out[i] is None or (bad > 0) < out[i][0]:
                        out[i] = (int(bad > 0), len(sh), bad, None, d, "", True)
            if full:  # what is valid in some dialect needs no repair
                best: dict[int, tuple] = {}
                for i, d, sh in failing:
                    if out[i][0]:
                        least, bad, kind, edits, exact = _verdict(sh, d, _file_tokens(texts[i], d))
                        if i not in best or least < best[i][0]:
                            best[i] = (least, len(sh), bad, kind, d, edits, exact)
                for i, x in best.items():
                    out[i] = x
            names = ("cost", "n_statements", "n_bad", "kind", "parsed_as", "edits", "exact")
            cols = list(zip(*out)) if out else [[]] * 7
            got = b.drop(columns=["content"]).assign(**{k: list(v) for k, v in zip(names[: 7 if full else 5], cols)})
            if keep:
                got["content"] = [t if x[0] else None for t, x in zip(texts, out)]
            yield got

    return run
