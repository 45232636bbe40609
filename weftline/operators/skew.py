"""Joins and aggregations that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot when it holds more than 1/HOT_PARTS of the rows, so there are
#: fewer than HOT_PARTS hot keys at any size of the data.
HOT_PARTS = 200


#: Share of rows looked at to find hot keys. It decides how a join runs, never
#: what it returns.
LOOK = 0.02
#: A key of fewer rows is never hot.
LEAST_HOT = 10_000


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS, least: int = LEAST_HOT) -> list:
    """Values of key that hold more than about 1/parts of all rows and at least
    `least` rows; at most `parts` of them. They are estimated from a share of
    the rows, as they only choose the way of a join. Null is never hot (it joins
    nothing)."""
    seen = df.select(key).sample(LOOK, seed=7)
    counts = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.where(F.col("_n") >= max(2, least * LOOK)).orderBy(F.desc("_n")).limit(parts).collect()
    if not big:
        return []
    total = seen.count()
    return [r[0] for r in big if r[1] * parts > total]


def lookup_join(left: DataFrame, right: DataFrame, left_key: str | Sequence[str], right_key: str | Sequence[str], hot: Sequence | None = None, how: str = "left") -> DataFrame:
    """left joined (inner, left, left_semi or left_anti) to right, whose
    right_key is unique. Rows of the keys in `hot` are not shuffled: the right
    side's rows for them (at most one per hot key, fewer than HOT_PARTS) are
    broadcast. Without `hot` the hot keys of left are looked for. Of a key of
    several columns `hot` has the hashes (key_hash())."""
    lk, rk = ([left_key] if isinstance(left_key, str) else list(left_key)), ([right_key] if isinstance(right_key, str) else list(right_key))
    if set(lk) & set(rk):
        raise ValueError("give the keys different names")
    cond = F.lit(True)
    for x, y in zip(lk, rk):
        cond = cond & (F.col(x) == F.col(y))
    one = len(lk) == 1
    if hot is None:
        hot = hot_keys(left, lk[0]) if one else hot_keys(left.select(key_hash(lk).alias("_h")), "_h")
    if not hot:
        return left.join(right, cond, how)
    hot = list(hot)
    is_hot = F.coalesce(F.col(lk[0]).isin(hot), F.lit(False)) if one else key_hash(lk).isin(hot)
    cold = left.where(~is_hot).join(right, cond, how)
    warm = left.where(is_hot).join(F.broadcast(right.where((F.col(rk[0]) if one else key_hash(rk)).isin(hot))), cond, how)
    return cold.unionByName(warm)


def key_hash(cols: Sequence[str]) -> Column:
    """By which rows of a key of several columns are counted as hot."""
    return F.xxhash64(*cols)


def weighted_values(df: DataFrame, key: Sequence[str], value: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Value-frequency compression: one row per (key, value) with its weight.

    The shuffle key is (key, value), so rows of a hot key spread over all tasks
    by their values, and equal rows collapse before the shuffle. Nulls in key or
    value form their own groups."""
    return df.groupBy(*key, *value).agg(F.count(F.lit(1)).alias("weight"), *extra)


def key_profile(df: DataFrame, key: str, value: str, time: str | None = None) -> DataFrame:
    """Exact per-key results from weighted values: n_rows, n_distinct (non-null
    values), mode (most frequent non-null value, the smallest on ties; null if
    none), mode_rows and, with time, last_time.

    Null keys form one group; empty input gives no rows. Neither step sends the
    rows of a key to one task: the first spreads them by value, the second
    combines weights before its shuffle."""
    times = [F.max("_t").alias("_last")] if time else []
    # the names are fixed, so that no other column of df can clash with them
    w = weighted_values(df.select(F.col(key).alias("_k"), F.col(value).alias("_v"), *([F.col(time).alias("_t")] if time else [])), ["_k"], ["_v"], times)
    known = F.col("_v").isNotNull()
    # of two structs max() takes the one with the greater first field; the
    # smallest of equally frequent values is found by min() of (-weight, value)
    aggs = [
        F.sum("weight").alias("n_rows"),
        F.count(F.when(known, F.lit(1))).alias("n_distinct"),
        F.min(F.when(known, F.struct((-F.col("weight")).alias("nw"), F.col("_v").alias("v")))).alias("_m"),
    ]
    if time:
        aggs.append(F.max("_last").alias("last_time"))
    out = w.groupBy("_k").agg(*aggs)
    cols = [F.col("_k").alias(key), "n_rows", "n_distinct", F.col("_m.v").alias("mode"), (-F.col("_m.nw")).alias("mode_rows")]
    return out.select(*cols, *(["last_time"] if time else []))


#: Distinct values of one key that one task may sort.
SORTED_AT_ONCE = 20_000


def weighted_percentiles(df: DataFrame, key: str, value: str, points: Sequence[float], bins: int = 64, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """Exact discrete percentiles per key: for each point p the smallest value
    whose cumulative weight reaches p of the key's rows with a value. Rows: key,
    point, value. Nulls and NaN are no values; keys without any, and the null
    key, give no row.

    Values are compressed to (key, value, weight). For every (key, point) the
    interval that holds the answer is then narrowed: its values are summed in
    `bins` parts of about as many values each, cut at values found by rank (so
    infinities and wide ranges are values like others), and the part that
    reaches the point is kept, until it has at most `at_once` distinct values,
    which are sorted. So however many values a key has, none of its tasks gets
    more than that; as a rule the first interval is small enough already."""
    from pyspark.sql import Window as W

    k = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where(F.col("_k").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    w = cut(weighted_values(k, ["_k"], ["_v"]), "weights")
    hot = hot_keys(w, "_k")
    s = w.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    s = s.select("_k", "point", "lo", "hi", "n", F.lit(0).cast("long").alias("before"), F.greatest(F.lit(1), F.ceil(F.col("point") * F.col("total"))).alias("need"))

    def inside(state: DataFrame, *more: str) -> DataFrame:
        """Values of the intervals of state, with the interval's columns."""
        one = state.groupBy(F.col("_k").alias("_s")).agg(F.collect_list(F.struct("point", "lo", "hi", "before", "need", *more)).alias("i"))
        j = lookup_join(w, one, "_k", "_s", hot, "inner").select("_k", "_v", "weight", F.explode("i").alias("i"))
        return j.select("_k", "_v", "weight", "i.*").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))

    small: list[DataFrame] = []
    while True:
        s = cut(s, "intervals")
        small.append(s.where((F.col("n") <= at_once) | (F.col("lo") == F.col("hi"))))
        wide = s.where((F.col("n") > at_once) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        ranks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        cuts = inside(wide).groupBy("_k", "point").agg(F.percentile_approx("_v", ranks, 10_000).alias("cuts"))
        wide = cut(wide.join(cuts, ["_k", "point"]), "cuts")
        part = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
        b = inside(wide, "cuts").groupBy("_k", "point", "before", "need", part.alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("weight").alias("bw"), F.count(F.lit(1)).alias("n"))
        upto = F.col("before") + F.sum("bw").over(W.partitionBy("_k", "point").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        b = b.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("bw") < F.col("need")))
        s = b.select("_k", "point", "lo", "hi", "n", (F.col("upto") - F.col("bw")).alias("before"), "need")
    every = small[0]
    for x in small[1:]:
        every = every.unionByName(x)
    run = F.sum("weight").over(W.partitionBy("_k", "point").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    got = inside(every).withColumn("run", run + F.col("before")).where(F.col("run") >= F.col("need"))
    return got.groupBy(F.col("_k").alias(key), "point").agg(F.min("_v").alias("value"))
