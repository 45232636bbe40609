from datetime import datetime as D
from itertools import product

import pytest

from weftline.operators import references as R

from .conftest import rows

T1, T2, T3 = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)


def test_states(spark):
    t = spark.createDataFrame([("a", T1, None), ("a", T2, T3), ("b", T1, T2), ("late", T3, None), (None, T1, None), ("b", T1, T2)], "id string, seen timestamp, gone timestamp")
    # first_seen and status are columns of the caller, too
    refs = spark.createDataFrame([(1, "a", T2, "x"), (2, "b", T2, None), (3, "late", T2, "x"), (4, "no", T2, "x"), (5, None, T2, "x"), (6, "late", T3, "x"), (7, "late", None, "x")], "n int, k string, at timestamp, first_seen string")
    got = R.orphans(refs, ["k"], t, ["id"], "at", "seen", "gone")
    assert rows(got, "n", "status") == [(2, "deleted"), (3, "late"), (4, "missing")]
    assert got.columns == ["n", "k", "at", "first_seen", "status"]
    c = R.check(refs.drop("first_seen"), ["k"], t, ["id"], "seen", "gone")
    assert c.count() == 7 and rows(c.where("ref_state is null"), "n") == [(5,)]


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_composite_keys_by_null_mask(spark, match):
    vals = [None, "x", "y"]
    refs = [(i, a, b) for i, (a, b) in enumerate(product(vals, vals))]
    targets = [("x", "x"), ("y", "x"), (None, "y"), ("y", None)]

    def bad(a, b):
        if a is None and b is None:
            return False
        whole = [t for t in targets if None not in t]
        if None in (a, b):
            if match != "partial":
                return match == "full"
            # targets need only the columns that are compared
            return not any(t[0] == a for t in targets) if b is None else not any(t[1] == b for t in targets)
        return (a, b) not in whole

    got = R.orphans(spark.createDataFrame(refs, "n int, a string, b string"), ["a", "b"], spark.createDataFrame(targets, "a string, b string"), ["a", "b"], match=match)
    assert rows(got, "n") == [(n,) for n, a, b in refs if bad(a, b)]


def test_empty_sides_and_misuse(spark):
    refs, none = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([], "k string")
    assert rows(R.orphans(refs, ["k"], none, ["k"]), "k", "status") == [("a", "missing")]
    assert R.orphans(none, ["k"], refs, ["k"]).collect() == []
    with pytest.raises(ValueError):
        R.orphans(refs, ["k"], none, [])
    with pytest.raises(ValueError):
        R.orphans(refs, ["k"], none, ["k"], match="odd")
