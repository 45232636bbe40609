"""References to records that do not exist, with composite and partly null keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import lookup_join

#: Prefix of the columns that exist only inside; callers' columns keep theirs.
_OWN = "__weft_"


def target_states(target: DataFrame, keys: Sequence[str], seen_at: str | None = None, deleted_at: str | None = None) -> DataFrame:
    """One row per key: seen (smallest seen_at) and alive (some row has no
    deleted_at). Rows with a null in any key column are no targets."""
    t = target
    for k in keys:
        t = t.where(F.col(k).isNotNull())
    seen = F.min(seen_at) if seen_at else F.lit(None).cast("timestamp")
    alive = F.max(F.col(deleted_at).isNull()) if deleted_at else F.lit(True)
    return t.groupBy(*[F.col(k).alias(f"{_OWN}{i}") for i, k in enumerate(keys)]).agg(seen.alias(f"{_OWN}seen"), alive.alias(f"{_OWN}alive"))


def check(refs: DataFrame, ref_keys: Sequence[str], target: DataFrame, keys: Sequence[str], seen_at: str | None = None, deleted_at: str | None = None, match: str = "simple", names: tuple[str, str] = ("ref_state", "first_seen")) -> DataFrame:
    """Every row of refs with two more columns, named by `names` (columns of
    refs with these names are replaced): `ref_state` ('missing': no target row has the key;
    'deleted': all that have it are deleted; 'alive'; null: no reference) and
    `first_seen` of the target.

    References are grouped by null mask - which of ref_keys are null - and each
    mask is checked on its non-null columns only. match declares what a partly
    null key means, as in SQL: 'simple' takes it as no reference, 'full' as
    'missing', 'partial' as a reference to any target that agrees on the
    non-null columns. An all-null key is never a reference. Repeated rows of
    refs stay repeated; target rows collapse to one per key before the join, and
    rows of a hot key are not shuffled."""
    if match not in ("simple", "full", "partial"):
        raise ValueError("match is simple, full or partial")
    if len(ref_keys) != len(keys) or not keys:
        raise ValueError("both sides need the same number of key columns")
    full: DataFrame | None = None
    out: DataFrame | None = None
    for mask in product((True, False), repeat=len(keys)):
        used = [i for i, on in enumerate(mask) if on]
        part = refs
        for k, on in zip(ref_keys, mask):
            part = part.where(F.col(k).isNotNull() if on else F.col(k).isNull())
        if not used or len(used) < len(keys) and match != "partial":
            state = F.lit("missing" if used and match == "full" else None).cast("string")
            got = part.withColumns({names[0]: state, names[1]: F.lit(None).cast("timestamp")})
        else:
            if len(used) == len(keys):
                full = full if full is not None else target_states(target, keys, seen_at, deleted_at)
                states = full
            else:
                states = target_states(target, [keys[i] for i in used], seen_at, deleted_at)
            got = _join(part, [ref_keys[i] for i in used], states, names)
        out = got if out is None else out.unionByName(got)
    assert out is not None
    return out


def _join(part: DataFrame, cols: list[str], states: DataFrame, names: tuple[str, str]) -> DataFrame:
    j = lookup_join(part, states, cols, [f"{_OWN}{i}" for i in range(len(cols))])
    state = F.when(F.col(f"{_OWN}alive").isNull(), "missing").when(~F.col(f"{_OWN}alive"), "deleted").otherwise("alive")
    return j.withColumns({names[0]: state, names[1]: F.col(f"{_OWN}seen").cast("timestamp")}).drop(f"{_OWN}seen", f"{_OWN}alive", *[f"{_OWN}{i}" for i in range(len(cols))])


def orphans(refs: DataFrame, ref_keys: Sequence[str], target: DataFrame, keys: Sequence[str], at: str | None = None, seen_at: str | None = None, deleted_at: str | None = None, match: str = "simple") -> DataFrame:
    """Rows of refs whose reference has no valid target, with a `status` column:
    'missing', 'deleted' (see check), or 'late': the target is alive, but its
    first row was seen only after refs.at."""
    own = (f"{_OWN}state", f"{_OWN}first")
    c = check(refs, ref_keys, target, keys, seen_at, deleted_at, match, own)
    late = (F.col(own[1]) > F.col(at)) if at else F.lit(False)
    status = F.when(F.col(own[0]) != "alive", F.col(own[0])).when((F.col(own[0]) == "alive") & late, "late")
    return c.withColumn("status", status).where(F.col("status").isNotNull()).drop(*own)
