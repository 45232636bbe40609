"""Queries of the training-text problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, rows_where, table
from . import canon, leakage, mixture, residue, syntax

#: The vocabulary file by which documents are sized.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.duplicate_ids(table(spark, d, "sql_query"), "id", "sql")


def p1_statements(spark: SparkSession, d: str) -> DataFrame:
    """One record per statement: smallest id, ids, rows and layouts."""
    return canon.statements(table(spark, d, "sql_query"), "id", "sql")


def _current_texts(spark: SparkSession, d: str) -> DataFrame:
    """Current version of each path with its content."""
    f = table(spark, d, "src_file").where(F.col("path").isNotNull() & F.col("sha").isNotNull() & F.col("indexed_at").isNotNull())
    top = f.groupBy("path").agg(
        F.max(F.struct("indexed_at", "sha", "repo_path", "dialect", "parse_failed", "parse_cause")).alias("v"),
        # where the current row has no dialect, the last one known for the path
        F.max(F.when(F.col("dialect").isNotNull(), F.struct("indexed_at", "dialect"))).alias("k"),
    )
    cur = top.select(F.col("path").alias("_p"), F.col("v.sha").alias("_s"), F.col("v.repo_path").alias("repo_path"), F.coalesce("v.dialect", "k.dialect").alias("dialect"), F.col("v.parse_failed").alias("claimed"), F.col("v.parse_cause").alias("claimed_cause"))
    t = table(spark, d, "file_text").select("path", "sha", "content")
    j = t.join(cur, (F.col("path") == F.col("_p")) & (F.col("sha") == F.col("_s")))
    return j.select("path", "repo_path", "dialect", "claimed", "claimed_cause", "content")


_FILE = "path string, repo_path string, dialect string, claimed boolean, claimed_cause string"
_FOUND = "cost int, n_statements int, n_bad int, kind string, parsed_as string"
#: Failing files whose repairs one task works out.
REPAIRS = 8


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose cheapest repair has a cost; how much it is, is p5_repairs'."""
    t = _current_texts(spark, d).select("path", "dialect", "content")
    got = t.mapInPandas(syntax.parse_batches(False), f"path string, dialect string, {_FOUND}")
    return got.where("cost > 0").select("path").distinct()


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every current file with its repair. Most files need none; the others,
    whose charts are the work, are spread over tasks by their number."""
    first = _current_texts(spark, d).mapInPandas(syntax.parse_batches(False, keep=True), f"{_FILE}, {_FOUND}, content string")
    first = cut(first, "parsed", "cost > 0")
    own = ["path", "repo_path", "dialect", "claimed", "claimed_cause"]
    bad = first.where("cost > 0").select(*own, "content").repartition(rows_where(first) // REPAIRS + 1)
    bad = bad.mapInPandas(syntax.parse_batches(True), f"{_FILE}, {_FOUND}, edits string, exact boolean")
    return bad.unionByName(first.where("cost = 0").drop("content").withColumns({"edits": F.lit(""), "exact": F.lit(True)}))


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("cost > 0").select("path", "repo_path", "dialect", "parsed_as", "cost", "n_statements", "n_bad", "kind", "edits", "exact").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and dialect: files, flagged files by kind, their rate, and
    what parse_failed claims beside it."""
    got = cut(_parsed(spark, d), "repaired").dropDuplicates(["path"])
    bad = F.col("cost") > 0
    n = lambda c: F.count(F.when(c, F.lit(1)))
    return got.groupBy("repo_path", "dialect").agg(
        F.count(F.lit(1)).alias("n_files"), n(bad).alias("n_flagged"), (n(bad) / F.count(F.lit(1))).alias("rate"),
        *[n(F.col("kind") == k).alias(f"n_{k}") for k in ("truncated", "conflict", "language", "syntax")],
        n(F.col("claimed")).alias("n_claimed"), n(F.col("claimed") & bad).alias("n_claimed_and_flagged"), n(F.coalesce(F.col("claimed_cause"), F.lit("")) != "").alias("n_with_cause"),
    )


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    # what a document is about is the repository it belongs to
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("repo_path").alias("topic"), "text")
    return mixture.Mixture(cut(mixture.token_counts(docs, TOKENIZER), "sizes"), table(spark, d, "mix_target"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).sample()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def _leaks(spark: SparkSession, d: str, least: int = 12) -> DataFrame:
    return leakage.tile_matches(table(spark, d, "documents"), table(spark, d, "eval_item"), least=least)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of five words and more: reordered and patched copies as well. A
    test item counts as leaked into a document when half of it is covered."""
    share = F.col("covered") / F.col("item_words")
    return _leaks(spark, d, 5).select("doc_id", "item_id", "n_tiles", "longest", share.alias("coverage"), (share >= 0.5).alias("leaked"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents; how much of them is
    p7_coverage's."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    r = residue.residue_records(table(spark, d, "documents"))
    return r.where(F.col("kind").isNotNull()).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every record's scores, and whether the lists that the model learns from
    hold a passage of it."""
    return residue.residue_records(table(spark, d, "documents"), listed=True)


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue, as document ids with what describes them."""
    docs = table(spark, d, "documents")
    bad = residue.residue_records(docs).where(F.col("kind").isNotNull()).select(F.col("doc_id").alias("_d")).distinct()
    kept = docs.select("doc_id", "lang", "source", "n_chars", "repo_path")
    return kept.join(bad, F.col("doc_id") == F.col("_d"), "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_statements, p5_found, p5_repairs, p5_rates, p8_mixture, p8_shares, p7_found, p7_coverage, p7_items, p9_found, p9_scores, p9_clean)}

_WINDOWS = """
WITH w AS (SELECT doc_id AS k, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] AS v FROM documents),
 i AS (SELECT item_id AS k, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] AS v FROM eval_item),
 dw AS (SELECT DISTINCT k, array_to_string(v[p:p + 11], ' ') AS g FROM (SELECT k, v, unnest(range(1, len(v) - 10)) AS p FROM w)),
 iw AS (SELECT DISTINCT k, array_to_string(v[p:p + 11], ' ') AS g FROM (SELECT k, v, unnest(range(1, len(v) - 10)) AS p FROM i))
"""

ORACLE = {
    "p7_found": _WINDOWS + "SELECT DISTINCT dw.k AS doc_id, iw.k AS item_id FROM dw JOIN iw USING (g)",
    "p7_items": _WINDOWS + "SELECT iw.k AS item_id, CAST(count(DISTINCT dw.k) AS BIGINT) AS n_docs FROM dw JOIN iw USING (g) GROUP BY 1",
}
