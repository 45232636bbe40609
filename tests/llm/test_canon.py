import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import canon as C

from ..conftest import rows

BASE = "INSERT INTO core.t (a, b, c) SELECT x.p, SUM(y.q) AS s, CASE WHEN x.r > 1 THEN 'It''s A' ELSE 'b,c' END FROM raw.x x JOIN raw.y y ON x.id = y.id WHERE x.z <> 'Q' GROUP BY x.p, x.r"


def same(a, b):
    return C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize(
    "other",
    [
        BASE.replace("INSERT INTO", "insert\n\tinto").replace("SELECT", "Select\r\n") + " ;;",
        BASE.replace("core.t", '"CORE"."T"').replace("x.p", "[X].[P]", 1).replace("raw.y", "`raw`.`y`"),
        "insert into core.t (c, a, b) select case when x.r>1 then 'It''s A' else 'b,c' end,x.p,sum(y.q) as s from raw.x x join raw.y y on x.id=y.id where x.z<>'Q' group by x.p,x.r",
    ],
)
def test_same_statement(other):
    assert same(BASE, other)


@pytest.mark.parametrize(
    "other",
    [
        BASE.replace("'Q'", "'q'"),  # text in quotes counts
        BASE.replace("(a, b, c)", "(b, a, c)"),  # columns move only with their items
        BASE.replace("GROUP BY x.p, x.r", "GROUP BY x.r, x.p"),
        BASE.replace("<>", "!="),
        BASE.replace("> 1", "> 1.0"),
        BASE.replace("x.z <> 'Q'", "x.z <> 'Q '"),
        BASE.replace("ON x.id = y.id", "ON y.id = x.id"),
    ],
)
def test_other_statement(other):
    assert not same(BASE, other)


def test_own_list_only():
    assert same("select a, b from t where x in (select c, d from u)", "SELECT b,a FROM t WHERE x IN (SELECT c,d FROM u)")
    assert not same("select a, b from t where x in (select c, d from u)", "select a, b from t where x in (select d, c from u)")
    assert same("with q as (select 1, 2) select a, b from q", "with q as (select 1, 2) select b, a from q")
    assert not same("with q as (select 1, 2) select a, b from q", "with q as (select 2, 1) select a, b from q")
    assert not same("select a, b from t union select c, d from u", "select b, a from t union select c, d from u")
    assert not same("select distinct a, b from t", "select a, b from t")
    assert same("select top 5 a, b from t", "SELECT TOP 5 b, a FROM t")
    assert same("create view v as select f(a, b), c from t", "create view v as select c, f(a, b) from t")
    assert not same("select f(a, b) from t", "select f(b, a) from t")


def test_cut_off_and_odd_texts():
    assert same("insert into t (a, b, c) select x, y", "INSERT INTO t (b, a, c) SELECT y, x")
    assert C.canonical(None) is None and C.canonical("") == "" and C.canonical(" ;; ; ") == ""
    for s in ("select", "select ,", "insert into t (a select b", "'open", '"open', "((((", "select 'a", "\ud800 x", "]", "insert select", ") select a, b", "select (a, b"):
        C.canonical(s)
    assert not same("select 'abc", "select abc")
    long = "select " + ", ".join(f"c{i}" for i in range(50_000)) + " from t"
    assert same(long, "SELECT " + ",".join(f"C{i}" for i in reversed(range(50_000))) + "\nFROM T;")


names = st.lists(st.sampled_from(["a", "b_1", "col", "sum(x)", "cast(y as date)", "coalesce(z, 'Q r')", "1 + 2"]), min_size=1, max_size=5)


@settings(max_examples=60, deadline=None)
@given(names, st.randoms(use_true_random=False))
def test_layout_never_counts(items, r):
    def write(xs, r):
        out = []
        for t in C.tokens("select " + ", ".join(xs) + " from s.t where u = 'V w'"):
            if not t.startswith("'"):
                t = r.choice([t, t.upper(), t.title()])
                if t.isidentifier() and t.lower() in ("b_1", "col", "a", "t", "s", "u"):
                    t = r.choice([t, f'"{t}"', f"`{t}`", f"[{t}]"])
            out.append(t)
        return r.choice([" ", "\n", " \t "]).join(out) + r.choice(["", ";", " ;"])

    moved = items[:]
    r.shuffle(moved)
    assert C.canonical(write(items, r)) == C.canonical(write(moved, r))


SCHEMA = "id string, sql string, key int, h string"  # key and h: clashing names


def test_groups_against_brute_force(spark):
    r = random.Random(3)
    kinds = ["select a, b from t", "SELECT b,a FROM t;", "select a from t", "Select [a] From t", "delete from t where x = 'Y'", "delete from t where x = 'y'", "", " ; ", None]
    data = [(f"q{i:03}", kinds[i % len(kinds)], i, "z") for i in range(90)]
    data += data[:10] + [(None, "select a from t", 1, None)]
    df = spark.createDataFrame(data, SCHEMA)
    groups = {}
    for i, s, *_ in data:
        if i is not None and s is not None:
            groups.setdefault(C.canonical(s), set()).add(i)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert rows(C.duplicate_ids(df, "id", "sql")) == want
    counts = {r["key"]: (r["n_rows"], r["n_texts"]) for r in C.statement_counts(df, "id", "sql").collect()}
    assert len(counts) == len(groups) and sum(n for n, _ in counts.values()) == sum(1 for d in data if d[0] and d[1] is not None)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.duplicate_ids(df, "id", "sql").collect() == [] and C.statement_counts(df, "id", "sql").collect() == []


def test_hot_statement(spark):
    df = spark.createDataFrame([(f"q{i:06}", "select a, b from t" if i % 3 else "SELECT b,\ta FROM t") for i in range(12_000)], "id string, sql string")
    got = C.duplicate_ids(df, "id", "sql")
    assert got.count() == 11_999 and got.select("keep_id").distinct().collect()[0][0] == "q000000"
