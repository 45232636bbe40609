"""Duplicates hidden by formatting: one canonical text per SQL statement."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, lookup_join
from ..session import cut, ship

if TYPE_CHECKING:
    import pandas as pd

# One token each: text in single quotes (kept as it is), a quoted identifier, a
# comment (dropped), a number, a word, an operator of several characters, any
# other sign. A quote that is never closed runs to the end.
_TOKEN = re.compile(
    r"""('(?:[^']|'')*'?)"""
    r"""|"((?:[^"]|"")*)"?|`([^`]*)`?|\[([^\]\['"]*)\]?"""
    r"""|(--[^\n]*|/\*.*?(?:\*/|\Z))"""
    r"""|((?:\d[\w.]*|\w[\w$\#]*|<=>|<>|<=|>=|!=|\|\||::|->>|->|=>|:=|\S))""",
    re.S,
)
_OPEN, _CLOSE = "([", ")]"
#: Words that end a select list when they come outside parentheses.
_ENDS = frozenset("from where group having order limit qualify window union intersect except fetch into offset for bulk".split())
_SETS = frozenset(("union", "intersect", "except", "minus"))


def tokens(sql: str) -> list[str]:
    """Tokens with letter case folded outside single quotes and identifier
    quoting removed. Strings keep their quotes, so a string never equals a word."""
    out = []
    for string, dq, bt, br, comment, other in _TOKEN.findall(sql):
        if other:
            out.append(other.lower())
        elif string:
            out.append(string)
        elif comment:
            continue
        else:
            out.append((dq.replace('""', '"') or bt or br).lower())
    while out and out[-1] == ";":
        out.pop()
    return out


def _items(toks: list[str], i: int, ends: frozenset[str]) -> tuple[list[tuple[str, ...]], int]:
    """Items between top-level commas from i on, and where the list ends."""
    items, item, depth = [], [], 0
    n = len(toks)
    case = 0
    while i < n:
        t = toks[i]
        if t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            if not depth:
                break
            depth -= 1
        elif not depth:
            if t == "case":
                case += 1
            elif t == "end" and case:
                case -= 1
            elif t in ends or t == ";":
                break
            elif t == ",":
                items.append(tuple(item))
                item = []
                i += 1
                continue
        item.append(t)
        i += 1
    items.append(tuple(item))
    return items, i


def _own_select(toks: list[str]) -> int:
    """Index of the statement's own SELECT: the first outside parentheses, or -1.
    With a set operation there are several lists and none is moved."""
    depth, at = 0, -1
    for i, t in enumerate(toks):
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth <= 0:
            if t == "select" and at < 0:
                at = i
            elif at >= 0 and t in _SETS:
                return -1
    return at


def canonical(sql: str | None) -> str | None:
    """The canonical text of a statement: equal texts mean equal statements.

    Whitespace, comments, letter case outside single quotes, identifier quoting
    and semicolons at the end go; the items of the statement's own select list
    are sorted, and with INSERT its column list moves along. Null stays null; an
    empty text, or one of only semicolons, gives ''. A text that is cut off is
    handled as far as it goes."""
    if sql is None:
        return None
    toks = tokens(sql)
    s = _own_select(toks)
    if s >= 0:
        i = s + 1
        n = len(toks)
        while i < n and toks[i] in ("distinct", "all"):
            i += 1
            if i < n and toks[i - 1] == "distinct" and toks[i] == "on" and i + 1 < n and toks[i + 1] == "(":
                depth = 0
                while i < n:
                    depth += (toks[i] == "(") - (toks[i] == ")")
                    i += 1
                    if not depth and toks[i - 1] == ")":
                        break
        if i < n and toks[i] == "top":
            i += 1
            if i < n and toks[i] == "(":
                while i < n and toks[i] != ")":
                    i += 1
            i += 1
        items, end = _items(toks, i, _ENDS)
        head, tail = toks[:i], toks[end:]
        cols = None
        if toks[0] == "insert" and s and toks[s - 1] == ")":
            # the column list right before SELECT, if that is what it is
            b = s - 1
            while b and toks[b] != "(":
                b -= 1
            names, stop = _items(toks, b + 1, frozenset())
            if stop == s - 1 and b > 1 and toks[b - 1] not in ("as", "values"):
                cols, head = names, toks[: b + 1]
        if cols is not None:
            if len(cols) < len(items):
                cols = cols + [()] * (len(items) - len(cols))
            elif len(items) < len(cols):  # cut off
                items = items + [()] * (len(cols) - len(items))
            pairs = sorted(zip(items, cols))
            toks = head + [t for _, c in pairs for t in (*c, ",")] + [")", *toks[s:i]] + [t for it, _ in pairs for t in (*it, ",")] + tail
        else:
            toks = head + [t for it in sorted(items) for t in (*it, ",")] + tail
    return "\x1f".join(toks)


def _digest(texts) -> list[bytes | None]:
    return [None if t is None else hashlib.blake2b(canonical(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]


def _keyed_texts(r: DataFrame) -> DataFrame:
    """(h, key, n): each distinct raw text's hash, statement key and row count.
    Byte-identical texts collapse first, before any text is tokenised."""
    ship(r.sparkSession)
    raw = r.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", "n", F.md5(F.col("text").cast("binary")).alias("h"))

    def canon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"h": b["h"], "key": _digest(b["text"]), "n": b["n"]})

    return raw.mapInPandas(canon, "h string, key binary, n long")


def _rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())


def _keyed(r: DataFrame) -> DataFrame:
    return cut(_keyed_texts(r), "statements")


def statement_keys(rows: DataFrame, id_col: str, text_col: str, keyed: DataFrame | None = None) -> DataFrame:
    """(id, key): one row per distinct id with the key of its statement. An id
    with several texts counts with the one of the smallest hash. Rows without id
    or text have no statement and are left out. The texts are read twice: once to
    be keyed, once to be hashed beside their ids."""
    r = _rows(rows, id_col, text_col)
    keyed = (keyed if keyed is not None else _keyed(r)).select("h", "key")
    ids = cut(r.groupBy("id").agg(F.min(F.md5(F.col("text").cast("binary"))).alias("_h")), "ids")
    # one text may be held by very many ids: that side of the join is the hot one
    return lookup_join(ids, keyed, "_h", "h", hot_keys(ids, "_h"), "inner").select("id", "key")


def statement_counts(rows: DataFrame, id_col: str, text_col: str, keyed: DataFrame | None = None) -> DataFrame:
    """(key, n_rows, n_texts): per statement the rows and the different layouts
    that hold it. Counts of byte-identical texts are summed, so a statement that
    holds a third of all rows arrives as few rows."""
    k = keyed if keyed is not None else _keyed_texts(_rows(rows, id_col, text_col))
    return k.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))


def statements(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, n_ids, n_rows, n_texts): one record per statement."""
    keyed = _keyed(_rows(rows, id_col, text_col))
    ids = statement_keys(rows, id_col, text_col, keyed).groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_ids"))
    counts = statement_counts(rows, id_col, text_col, keyed).withColumnRenamed("key", "_k")
    return ids.join(counts, F.col("key") == F.col("_k")).select("keep_id", "n_ids", "n_rows", "n_texts")


def duplicate_ids(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, copy_id): for each statement held by several ids, one row per
    id other than the smallest. Hot statements are joined without a shuffle."""
    k = cut(statement_keys(rows, id_col, text_col), "keys")
    g = k.groupBy(F.col("key").alias("_k")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    j = lookup_join(k, g, "key", "_k", hot_keys(k, "key"), "inner")
    return j.where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))
