import numpy as np
import pytest

from weftline.llm import syntax as S

from ..conftest import rows

VALID = {
    "ansi": [
        "SELECT a, b AS c, COUNT(*) FROM s.t x LEFT JOIN u ON x.i = u.i WHERE a BETWEEN 1 AND 2 AND (b IS NOT NULL OR c IN (1, 2)) GROUP BY a, b HAVING COUNT(*) > 1 ORDER BY a DESC FETCH FIRST 5 ROWS ONLY",
        "WITH q AS (SELECT 1 AS x), r (y) AS (SELECT x FROM q) SELECT * FROM r UNION ALL SELECT x FROM q",
        "INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')",
        "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN UPDATE SET b = s.b WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b)",
        "CREATE TABLE t (id INT PRIMARY KEY, n DECIMAL(10, 2) NOT NULL, c VARCHAR(20) DEFAULT 'x', UNIQUE (n))",
        "CREATE OR REPLACE VIEW v AS SELECT CASE WHEN a > 1 THEN 'x' WHEN a = 0 THEN NULL ELSE 'z' END AS k, CASE b WHEN 1 THEN 2 END FROM t",
        "UPDATE t SET a = 1, b = c + 2 WHERE d IN (SELECT e FROM f)",
        "DELETE FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = t.a)",
        "ALTER TABLE t ADD COLUMN x INT; DROP TABLE IF EXISTS t; TRUNCATE TABLE t",
        "SELECT SUM(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t",
        "SELECT (a + b) * -c, f(g(x, 1), h()), CAST(a AS DECIMAL(10, 2)) FROM (SELECT 1 AS a FROM t) q CROSS JOIN u",
        "", "-- only a comment", "/* a\n<<<<<<< b */ ;;",
    ],
    "snowflake": ["SELECT payload:a.b::STRING AS v FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY b DESC) = 1", "CREATE TABLE a.b CLONE a.c", "USE SCHEMA stg", "SELECT a FROM t LIMIT 5"],
    "bigquery": ["SELECT * EXCEPT (a) FROM `p.d.t` WHERE x IN UNNEST([1, 2])", 'SELECT "text" FROM t'],
    "postgres": ["SELECT DISTINCT ON (a) a, b FROM t", "DO $$ BEGIN PERFORM 1; END $$", "SELECT $x$it's (open$x$ AS n", "SELECT a::NUMERIC FROM t"],
    "tsql": ["SELECT TOP 10 [a b], [c] FROM [d].[e]", "DECLARE @n INT = 5", "UPDATE t SET a = 1 DELETE FROM u WHERE b = 2"],
}
INVALID = {
    "ansi": [
        "SELECT a, FROM t", "SELECT a FROM t WHERE", "SELECT a FROM t GROUP", "INSERT INTO t (a, b", "SELECT (a FROM t", "SELECT a FROM t WHERE a = 'open", "CASE WHEN a THEN b", ", b FROM t", "SELECT a FROM t /* never closed",
        "SELECT a\n<<<<<<< HEAD\n, b\n=======\n, c\n>>>>>>> x\nFROM t", "import os\nprint(os.name)", '{"a": [1, 2]}', "<html><body>x</body></html>", "version: 2\nmodels:\n  - name: a", "SELECT `a` FROM t", "SELECT a::INT FROM t", "SELECT a FROM t LIMIT 5",
    ],
    "snowflake": ["SELECT [a] b FROM FROM t", "SELECT TOP FROM t"],
    "postgres": ["SELECT a FROM t QUALIFY x = 1"],
}


def verdict(text, dialect):
    return S._verdict(S._file_shapes([text], dialect)[0], dialect, S._file_tokens(text, dialect))


@pytest.mark.parametrize("dialect,text", [(d, t) for d, ts in VALID.items() for t in ts])
def test_valid(dialect, text):
    assert verdict(text, dialect)[0] == 0


@pytest.mark.parametrize("dialect,text", [(d, t) for d, ts in INVALID.items() for t in ts])
def test_invalid(dialect, text):
    cost, bad, kind, edits, exact = verdict(text, dialect)
    assert cost > 0 and bad > 0 and kind and exact and len(edits.split()) == cost


def test_kinds():
    ok = "SELECT a FROM t;\n" * 3
    assert verdict(ok + "SELECT a, b FROM", "ansi")[2] == "truncated"
    assert verdict("= 5 GROUP BY a;\n" + ok, "ansi")[2] == "truncated"
    assert verdict(ok + "<<<<<<< HEAD\nSELECT 1 FROM t\n=======\nSELECT 2 FROM t\n>>>>>>> b\n;", "ansi")[2] == "conflict"
    assert verdict("def f(x):\n    return {x: [1]}\n", "ansi")[2] == "language"
    assert verdict("a,b,c\n1,2,x\n3,4,y\n", "ansi")[2] == "language"


def near(g, s):
    """All texts one edit away."""
    signs = sorted(g.edits)
    return {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + c + s[j:] for i in range(len(s) + 1) for j in (i, i + 1) for c in signs if j <= len(s)}


def test_least_cost_against_search():
    """The chart's cost is the least number of token edits: tried out over all
    single edits of short texts, real ones and random ones of every dialect."""
    import random

    r = random.Random(2)
    g = S.grammar(False)
    assert not set("epqabjr") & set(g.edits)
    texts = [(t, "ansi") for t in ("SELECT a FROM", "SELECT FROM t", "a FROM t", "SELECT a b c FROM t", "DELETE t WHERE", "SELECT a.b FROM t")]
    some = ["SELECT", "a", "FROM", "t.u", ",", "1", "WHERE", "=", "(", ")", "AND", "GROUP", "BY", "JOIN", "ON", "LIMIT"]
    texts += [(" ".join(r.choice(some) for _ in range(r.randrange(1, 6))), d) for d in S.DIALECTS for _ in range(4)]
    costs = set()
    for text, d in texts:
        start = g.starts[d]
        for shape, s in zip(S._file_shapes([text], d)[0], S._file_tokens(text, d)):
            cost, _, _, edits, exact = S.repair(shape, d, s)
            assert exact and len(edits) == cost and all(0 <= p <= len(s) for _, p in edits), text
            assert (cost == 0) == g.recognise(s, start), text
            if cost:
                assert (cost == 1) == any(g.recognise(x, start) for x in near(g, s) if x), text
                # one edit changes the cost by one at most
                other = r.choice(sorted(x for x in near(g, s) if x))
                assert abs(int(g.table(other)[len(other)][0, start]) - cost) <= 1
            costs.add(cost)
    assert {0, 1, 2} <= costs


def test_tokens_and_shapes_agree():
    """Single tokens and shapes are valid together."""
    g = S.grammar(False)
    for d, ts in {**VALID, **INVALID}.items():
        for t in ts:
            shapes, tokens = S._file_shapes([t], d)[0], S._file_tokens(t, d)
            assert len(shapes) == len(tokens)
            for x, s in zip(shapes, tokens):
                assert S.valid(x, d) == g.recognise(s, g.starts[d]), t


def test_edit_places():
    assert verdict("a, b FROM t", "ansi")[3] == "0:+0"
    assert verdict("SELECT a FROM t; SELECT (a FROM t", "ansi")[3].startswith("1:") and verdict("SELECT a FROM t; SELECT (a FROM t", "ansi")[0] == 1


def test_very_long_statements_have_a_cost():
    long = "SELECT " + ", ".join(f"c{i}" for i in range(20_000)) + ","
    assert verdict(long, "ansi")[::2][:2] == (1, "truncated") and not verdict(long, "ansi")[4]
    odd = "} { : ? " * 400  # nothing of it is a phrase
    cost, _, kind, edits, exact = verdict(odd, "ansi")
    assert kind == "language" and not exact and cost >= 800


def test_table_and_recogniser_agree():
    g = S.grammar()
    for d, ts in {**VALID, **INVALID}.items():
        for x in {x for t in ts for x in S._file_shapes([t], d)[0]}:
            if len(x) <= 40:
                assert S.valid(x, d) == (int(g.table(x)[len(x)][0, g.starts[d]]) == 0), x


def test_shapes_change_nothing():
    """Replacing complete phrases leaves validity as it was, read by the chart
    on the plain tokens."""
    for d in ("ansi", "snowflake"):
        for t in VALID[d] + INVALID.get(d, []):
            for plain in S.classes(t, d).split(";"):
                if 0 < len(plain) <= 60 and not any(S.K[w] in plain for w in ("group", "order", "partition", "left", "interval", "as")):
                    one = plain
                    for w, p in S._CONTEXT_RULES:
                        one = p.sub("n", one)
                    for p, to in S._ONCE:
                        one = p.sub(to, one)
                    assert S.valid(one, d) == S.valid(S.shapes(plain, d), d), t


def test_batches(spark):
    long = "SELECT " + ", ".join(f"c{i}" for i in range(20_000)) + " FROM t;"
    data = [("ok", "ansi", long), ("cut", "ansi", long[:-3]), ("none", None, "SELECT `a` FROM t"), ("odd", "klingon", "SELECT a::INT FROM t"), ("bad", None, "SELECT (("), ("empty", "tsql", ""), ("null", "ansi", None)]
    df = spark.createDataFrame(data, "path string, dialect string, content string")
    plain = "path string, dialect string, cost int, n_statements int, n_bad int, kind string, parsed_as string"
    for full in (False, True):
        schema = plain + (", edits string, exact boolean" if full else "")
        got = {r["path"]: r for r in df.mapInPandas(S.parse_batches(full), schema).collect()}
        assert {p for p, r in got.items() if r["cost"] > 0} == {"cut", "bad"} and "null" not in got
        assert got["none"]["parsed_as"] == "bigquery"
    assert df.limit(0).mapInPandas(S.parse_batches(True), schema).collect() == []
    assert rows(df.where("path = 'cut'").mapInPandas(S.parse_batches(True), schema), "kind") == [("truncated",)]


def test_long_cut_off_statements_are_truncated():
    part = "SELECT a FROM t WHERE a IN ("
    sh = S._file_shapes([part * 12], "ansi")[0]
    assert [len(x) > 64 for x in sh] == [True]
    cost = [verdict(part * n, "ansi")[0] for n in (6, 12)]  # each more open bracket costs one
    assert cost[1] - cost[0] == 6
    assert verdict(part * 12, "ansi")[2] == "truncated"
    assert verdict("SELECT a FROM t;\n" * 3 + part * 12, "ansi")[:3] == (cost[1], 1, "truncated")


def test_long_statements_are_repaired_as_short_ones():
    """More elements of the same kind change neither the cost nor what is edited:
    places are those of tokens and costs those of tokens at every length."""
    for items, tail in (("f(c, 1) AS x", " b c d e FROM t WHERE ( g(a, ( b, 2)"), ("a", ", FROM t GROUP a b"), ("t.a + 1", " FROM u WHERE a IN (SELECT b, c FROM")):
        unit = len(S._file_tokens(items + ",", "ansi")[0])
        got = {}
        for n in (14, 160, 700):
            s = S._file_tokens("SELECT " + ", ".join([items] * n) + tail, "ansi")[0]
            shape = S._file_shapes(["SELECT " + ", ".join([items] * n) + tail], "ansi")[0][0]
            cost, before, after, edits, _ = S.repair(shape, "ansi", s)
            assert cost == len(edits)
            got[n] = (cost, before, after, [(k, p - unit * n) for k, p in edits])
        assert len(s) > 1200 and got[14] == got[160] == got[700], items


def test_folding_keeps_the_least_cost(monkeypatch):
    """Texts with repeated elements, damaged at random: with few copies in the
    chart the cost and shares are those of the chart of all tokens, and edits are
    in order and as many as the cost."""
    import random

    r = random.Random(7)
    g = S.grammar(False)
    start = g.starts["ansi"]
    units = ["a", "1", "f(a, 1)", "a b", "(1, 2)", "a = 1", "a, 1", "(a, a, a, a, a, a, a)"]
    heads = ["SELECT ", "INSERT INTO t VALUES ", "SELECT a FROM ", "UPDATE t SET ", "CREATE TABLE t (", "SELECT f(", "SELECT a FROM t LIMIT "]
    some = ["(", ")", ",", "SELECT", "FROM t", "a", "1", "}", "} } } } } } } } }", "GROUP BY", "CASE"]
    monkeypatch.setattr(S, "COPIES", 4)
    folded = 0
    for _ in range(30):
        words = (r.choice(heads) + ", ".join([r.choice(units)] * r.randrange(9, 14)) + r.choice([" FROM t", ")", "", " FROM t WHERE a = 1"])).split()
        for _ in range(r.choice((1, 1, 2))):
            words.insert(r.randrange(len(words) + 1), r.choice(some))
        s = S._file_tokens(" ".join(words), "ansi")[0]
        t, least = S._least(g, s, start, 1)
        cost, before, after, edits, whole = S._repair(s, "ansi", False)
        assert cost == least == len(edits), words
        assert (before, after) == tuple(least - S._open_cost(g, t, s, start, least, x) for x in (True, False)), words
        assert list(edits) == sorted(edits, key=lambda e: (e[1], e[0])) and all(0 <= p <= len(s) for _, p in edits)
        if cost == 1:  # an edit at the place told does it
            (k, p), signs = edits[0], sorted(g.edits)
            new = [s[:p] + s[p + 1 :]] if k == "-" else [s[:p] + c + s[p + (k == "~") :] for c in signs]
            assert any(g.recognise(x, start) for x in new), words
        folded += not whole
    assert folded >= 10


def test_bounds_change_nothing():
    """The chart within a bound tells the same as without one."""
    g = S.grammar(False)
    for text in ("SELECT a b c FROM t", "SELECT (a FROM t WHERE", "a , b } FROM ( (", "SELECT a FROM t WHERE a IN (SELECT a FROM t WHERE a IN ("):
        s, start = S._file_tokens(text, "ansi")[0], g.starts["ansi"]
        full = g.table(s)
        least = full[len(s)][0, start]
        for most in range(1, least + 2):
            t = g.table(s, most)
            assert all((np.minimum(full[k][i], most + 1) == t[k][i]).all() for k in range(len(s) + 1) for i in range(len(s) - k + 1))
        assert g.script(t, s, start) == g.script(full, s, start)
