from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from weftline.operators import incremental as I

from .conftest import rows

F_S = "path string, sha string, indexed_at timestamp, run_id long"  # run_id: a clashing name


@pytest.fixture
def new(spark, tmp_path):
    """Makes ledgers."""
    n = iter(range(99))
    return lambda: I.Ledger(spark, str(tmp_path / f"ledger{next(n)}"))


def files(spark, *r):
    return spark.createDataFrame([(*x, 7) for x in r], F_S)


def test_pending(spark, new):
    f = files(spark, ("a", "1", D(2025, 1, 1)), ("a", "2", D(2025, 1, 2)), ("a", None, D(2025, 1, 3)), ("b", "1", D(2025, 1, 1)), ("c", "9", D(2025, 1, 1)), ("d", "1", D(2025, 1, 1)), ("d", "1", D(2025, 1, 1)), (None, "x", D(2025, 1, 1)), ("n", "n", None))
    runs = spark.createDataFrame([(1, D(2025, 1, 1), "success"), (2, D(2025, 1, 5), "failed"), (3, None, "running"), (4, D(2025, 1, 4), "success")], "run_id long, finished_at timestamp, status string")
    done = spark.createDataFrame([(1, "a", "1", D(2025, 1, 1)), (2, "a", "2", D(2025, 1, 5)), (4, "b", "1", D(2025, 1, 4)), (4, "b", "1", D(2025, 1, 4)), (1, "b", "0", D(2025, 1, 1)), (3, "c", "9", D(2025, 1, 6)), (1, "d", None, D(2025, 1, 1)), (4, "gone", "1", None)], "run_id long, path string, sha string, done_at timestamp")
    got = rows(I.pending(new(), f, done, runs), "path", "sha", "reason")
    # a: the run that handled version 2 failed; c: its run never ended
    assert got == [("a", "2", "changed"), ("c", "9", "new"), ("d", "1", "changed")]
    # up to the first day: run 4 had not finished
    early = I.pending(new(), f, done, runs, D(2025, 1, 1))
    assert rows(early, "path", "sha") == [("b", "1"), ("c", "9"), ("d", "1")]


def test_pending_of_nothing(spark, new):
    f, runs = files(spark), spark.createDataFrame([], "run_id long, finished_at timestamp, status string")
    done = spark.createDataFrame([], "run_id long, path string, sha string, done_at timestamp")
    assert I.pending(new(), f, done, runs).collect() == []
    one = files(spark, ("a", "1", D(2025, 1, 1)))
    assert rows(I.pending(new(), one, done, runs), "path", "reason") == [("a", "new")]


def test_ledger_survives_failures(spark, new):
    src = lambda n: {"s": I.Source(spark.range(1, n + 1).select(F.col("id").alias("seq"), (F.col("id") * 10).alias("v")), "seq", ("v",))}
    led, copy = new(), lambda new, state: new["s"]
    assert led.watermarks() == {} and led.output() is None
    assert led.run(src(5), copy) and led.watermarks() == {"s": "5"}
    with pytest.raises(RuntimeError):
        led.run(src(9), copy, fail="before")
    assert led.watermarks() == {"s": "5"} and led.outputs().count() == 5  # nothing half done shows
    with pytest.raises(RuntimeError):  # dies after the commit: it holds
        led.run(src(9), copy, fail="after")
    assert not led.run(src(9), copy)
    assert rows(led.outputs(), "seq") == [(i,) for i in range(1, 10)]
    with pytest.raises(RuntimeError):  # a second writer of the same place
        led._commit("000000000001.json", {})
    assert led.watermarks() == {"s": "9"}


def test_ties_and_late_rows(spark, new):
    """Rows that arrive later at the watermark itself, or up to `late` below it,
    are read once; repeated and null keys are no trouble."""
    df = lambda *r: spark.createDataFrame(r, "seq long, k string, x int")
    a = [(1, "a", 1), (2, "b", 1), (2, None, 1), (None, "z", 1)]
    for late, extra, want in ((None, [], ["b2", "c"]), ("1", [(1, "late", 1)], ["b2", "c", "late"])):
        led, got = new(), lambda new, state: new["s"]
        one = lambda *r: {"s": I.Source(df(*r), "seq", ("k",), late)}  # noqa: B023, E731
        assert led.run(one(*a), got) and rows(led.output(), "k") == [("a",), ("b",), (None,)]
        b = a + [(2, "b2", 1), (3, "c", 1)] + extra
        assert led.run(one(*b), got) and rows(led.output(), "k") == [(k,) for k in want]
        assert not led.run(one(*b), got)
        # a tie with nothing above it
        assert led.run(one(*b, (3, "d", 1)), got) and rows(led.output(), "k") == [("d",)]
        assert not led.run(one(*b, (3, "d", 1)), got) and led.watermarks() == {"s": "3"}
    empty = new()
    assert not empty.run({"s": I.Source(df((None, "n", 1)), "seq", ("k",))}, got) and empty.output() is None


def test_versions_over_runs(spark, new):
    """Step by step as all at once: whatever the bounds, failures and order of
    calls, the last answer is the one of a single run over everything."""
    f = files(spark, *[(f"p{i % 7}", f"s{i % 4}", D(2025, 1, 1 + i % 9)) for i in range(40)])
    runs = spark.createDataFrame([(i, D(2025, 1, 1 + (i * 2) % 9), "success" if i % 3 else "failed") for i in range(9)], "run_id long, finished_at timestamp, status string")
    done = spark.createDataFrame([(i % 9, f"p{i % 5}", f"s{i % 4}", D(2025, 1, 1 + i % 9)) for i in range(50)], "run_id long, path string, sha string, done_at timestamp")
    want = rows(I.pending(new(), f, done, runs))
    led = new()
    for day in (2, 2, 5, 6):
        try:
            I.pending(led, f, done, runs, upto=D(2025, 1, day), fail="before" if day == 5 else None)
        except RuntimeError:
            pass
    assert rows(I.pending(led, f, done, runs)) == want != []
