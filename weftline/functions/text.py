"""Names, references and labels as column expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Globs of backup tables, matched on the bare table name.
NOISE_GLOBS = ["*_bck", "*_bck_*", "*_bck_us", "*_bck_[0-9]*", "*_backup", "*_backup_[0-9]*"]
#: Reasons of inferred edges by transform and rounded confidence.
REASONS = {
    ("STAR_EXPANSION", 0.8): "star-expansion: columns inferred from source table schema",
    ("UNKNOWN", 0.5): "column not found in resolved schema",
    (None, 0.3): "scripting-block fallback: column lineage approximate",
    ("UNKNOWN", 0.0): "lineage extraction failed at index time",
}


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression of the JVM."""
    body = fnmatch.translate(glob)
    return "^" + re.sub(r"\\[Zz]$", "", body.replace("(?s:", "(?s:")) + "$"


def short_name(qualified: Column) -> Column:
    """The bare table name: what follows the last '::', else the last dot."""
    return F.when(F.contains(qualified, F.lit("::")), F.element_at(F.split(qualified, "::"), -1)).otherwise(F.element_at(F.split(qualified, r"\."), -1))


def is_noise(qualified: Column, globs: Sequence[str] = NOISE_GLOBS, exact: Sequence[str] = (), regexes: Sequence[str] = ()) -> Column:
    """Whether a table is noise: its name is listed, its bare name matches a
    glob, or a regular expression is found in its full name, letter case
    ignored. Expressions that are no valid regular expressions match nothing.
    Null is not noise."""
    out = F.lower(qualified).isin([x.lower() for x in exact]) if exact else F.lit(False)
    for g in globs:
        out = out | short_name(qualified).rlike(glob_regex(g))
    for r in regexes:
        try:
            re.compile(r)
        except re.error:
            continue
        out = out | qualified.rlike(f"(?i){r}")
    return F.coalesce(out, F.lit(False))


def risk_label(n: Column) -> Column:
    return F.when(n == 0, "safe").when(n <= 5, "low").when(n <= 20, "medium").otherwise("high")


def reason(transform: Column, confidence: Column) -> Column:
    """Why an edge is not certain; null for facts."""
    r = F.round(confidence, 1)
    out = F.concat(F.lit("inferred edge (confidence="), F.format_string("%.2f", confidence), F.lit(")"))
    for (t, c), text in REASONS.items():
        out = F.when(transform.eqNullSafe(F.lit(t)) & (r == c), text).otherwise(out)
    return F.when(confidence.isNull() | (confidence >= 1.0), None).otherwise(out)


def assertion(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence >= 1.0), "fact").otherwise("heuristic")


def ref_table(ref: Column) -> Column:
    """Table of a column reference, in lower case; null without a dot."""
    r = F.lower(ref)
    return F.when(F.instr(r, ".") > 0, F.regexp_replace(r, r"\.[^.]*$", ""))


def ref_column(ref: Column) -> Column:
    r = F.lower(ref)
    return F.when(F.instr(r, ".") > 0, F.element_at(F.split(r, r"\."), -1))


def bare_ref(ref: Column) -> Column:
    """The reference without its first part if it has three or more; keys inside
    a file's namespace stay as they are."""
    parts = F.split(ref, r"\.")
    return F.when(~F.contains(ref, F.lit("::")) & (F.size(parts) >= 3), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".")).otherwise(ref)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.0 when both are empty or one is null."""
    n = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), n.cast("double")), F.lit(0.0))


# ------------------------------------------------------------- error messages
#: Buckets from most to least severe, for ties.
BUCKETS = ["timeout", "worker_error", "E8", "E3", "E2", "E5", "E1", "qualify_failed", "func_fallback", "pure_ddl_skip"]
DEGRADING = ["E1", "E2", "E3", "E5", "E8", "timeout", "worker_error", "func_fallback", "qualify_failed"]


def error_bucket(msg: Column) -> Column:
    """The bucket of an extraction message."""
    col = F.regexp_extract(msg, "Cannot find column '([^']+)'", 1)
    lineage = (
        F.when(F.contains(msg, F.lit("Cannot find column 'NULL'")), "E1")
        .when(F.contains(msg, F.lit("Cannot find column")), F.when((col != "") & col.rlike("[()]"), "E2").when((col == "") & msg.rlike("Expecting|Invalid|Unexpected"), "E3").otherwise("E5"))
        .when(msg.rlike("Expecting|Invalid expression|Unexpected token"), "E3")
    )
    skip = F.when(F.contains(msg, F.lit("pure_ddl_file")), "pure_ddl_skip").when(F.contains(msg, F.lit("func_fallback:")), "func_fallback").when(F.contains(msg, F.lit("qualify_failed:")), "qualify_failed").when(F.contains(msg, F.lit("dynamic_source")), "E8")
    b = (
        F.when(msg.startswith("timeout:") | msg.startswith("skipped:poison"), "timeout")
        .when(msg.startswith("worker_error:"), "worker_error")
        .when(msg.startswith("col_lineage_skip:"), skip)
        .when(msg.startswith("col_lineage:"), lineage)
    )
    return F.coalesce(b, F.lit("other"))


def dominant_causes(errors):
    """(path, parse_cause, parse_failed) per file from (path, message): the most
    frequent bucket but 'other', ties by severity. Files with none of them get
    '' and false; a null message counts as 'other'."""
    b = errors.select("path", error_bucket(F.coalesce("message", F.lit(""))).alias("bucket"))
    n = b.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in BUCKETS]), F.col("bucket"))
    best = F.max(F.when(F.col("bucket") != "other", F.struct("n", (-rank).alias("r"), "bucket")))
    g = n.groupBy("path").agg(best.alias("_b"))
    cause = F.coalesce(F.col("_b.bucket"), F.lit(""))
    return g.select("path", cause.alias("parse_cause"), cause.isin(DEGRADING).alias("parse_failed"))


def skip_counts(errors):
    """(path, skip_counts): per file a JSON object of buckets and counts."""
    b = errors.select("path", error_bucket(F.coalesce("message", F.lit(""))).alias("bucket"))
    n = b.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most as many entries per file as there are buckets
    return n.groupBy("path").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n"))))).alias("skip_counts"))
