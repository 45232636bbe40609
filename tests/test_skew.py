from collections import Counter

from weftline.operators import skew as S

from .conftest import rows


def test_profile_against_brute_force(spark):
    data = [("h", f"v{i % 7}", i) for i in range(500)] + [("a", "x", 3), ("a", "y", 9), ("a", None, 12), (None, "x", 1), ("e", None, None), ("", "q", 4)]
    df = spark.createDataFrame(data, "k string, v string, t int").withColumnRenamed("t", "weight")
    got = {r[0]: tuple(r)[1:] for r in S.key_profile(df, "k", "v", "weight").collect()}
    for k in {d[0] for d in data}:
        vs = [d for d in data if d[0] == k]
        c = Counter(v for _, v, _ in vs if v is not None)
        top = min(c, key=lambda x: (-c[x], x)) if c else None
        last = max((t for _, _, t in vs if t is not None), default=None)
        assert got[k] == (len(vs), len(c), top, c.get(top), last)
    assert len(got) == 5


def test_profile_of_nothing(spark):
    assert S.key_profile(spark.createDataFrame([], "k string, v string"), "k", "v").collect() == []


def test_percentiles_against_sorting(spark):
    data = [("h", float(i % 97) ** 3) for i in range(1000)] + [("one", 5.0), ("none", None), ("nan", float("nan")), ("two", 1.0), ("two", 2.0), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    import math

    for at_once in (S.SORTED_AT_ONCE, 3):  # sorted at once, and narrowed
        got = {(r[0], r[1]): r[2] for r in S.weighted_percentiles(df, "k", "v", [0.0, 0.5, 0.9, 1.0], bins=4, at_once=at_once).collect()}
        for k in ("h", "one", "two"):
            vs = sorted(v for a, v in data if a == k)
            for p in (0.0, 0.5, 0.9, 1.0):
                assert got[k, p] == vs[max(1, math.ceil(p * len(vs))) - 1]
        assert {k for k, _ in got} == {"h", "one", "two"}


def test_percentiles_of_infinities_and_wide_ranges(spark):
    inf = float("inf")
    vs = [-inf, inf, -1.7e308, 1.7e308, 5e-324, -0.0] + [float(i) for i in range(50)]
    df = spark.createDataFrame([("k", v) for v in vs] + [("inf", inf), ("inf", -inf), ("inf", inf)], "k string, v double")
    points = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {(r[0], r[1]): r[2] for r in S.weighted_percentiles(df, "k", "v", points, at_once=10).collect()}
    import math

    for k, x in (("k", sorted(vs)), ("inf", [-inf, inf, inf])):
        assert [got[k, p] for p in points] == [x[max(1, math.ceil(p * len(x))) - 1] for p in points]


def test_lookup_join_of_two_columns(spark):
    left = spark.createDataFrame([("h", 1)] * 50 + [("h", 2), ("c", 1), (None, 1), ("h", None)], "a string, b int")
    right = spark.createDataFrame([("h", 1, 7), ("c", 1, 8)], "x string, y int, n int")
    hot = [r[0] for r in left.where("a = 'h' and b = 1").select(S.key_hash(["a", "b"])).distinct().collect()]
    for h in (hot, [], None):
        got = S.lookup_join(left, right, ["a", "b"], ["x", "y"], h)
        assert rows(got.where("n is not null"), "a", "n") == [("c", 8)] + [("h", 7)] * 50 and got.count() == 54
        assert S.lookup_join(left, right, ["a", "b"], ["x", "y"], h, "left_anti").count() == 3


def test_lookup_join_with_hot_key(spark):
    left = spark.createDataFrame([("hot",)] * 50 + [("cold",), (None,), ("gone",)], "a string")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "b string, n int")
    want = [("cold", 2)] + [("hot", 1)] * 50 + [("gone", None), (None, None)]
    assert rows(S.lookup_join(left, right, "a", "b", ["hot"]), "a", "n") == sorted(want, key=repr)
    assert S.lookup_join(left, right, "a", "b", ["hot"], "inner").count() == 51


def test_hot_keys_are_few_and_hot(spark):
    df = spark.createDataFrame([("h",)] * 30_000 + [(f"k{i}",) for i in range(20_000)] + [(None,)] * 20_000, "k string")
    assert S.hot_keys(df, "k") == ["h"]
    assert S.hot_keys(spark.createDataFrame([], "k string"), "k") == []


def test_tables_of_a_job_are_dropped(spark):
    from pathlib import Path

    from weftline.session import cut, drop_all, job_dir, rows_where, rows_written

    t = cut(spark.range(10), "x", "id > 3")
    assert (rows_written(t), rows_where(t), t.count()) == (10, 6, 10)
    here = Path(job_dir(spark).removeprefix("file:"))
    assert any(p.name.startswith("x-") for p in here.iterdir())
    drop_all(spark)
    assert not here.exists()
