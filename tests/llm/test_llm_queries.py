"""The subpackage's queries on the smallest tables: against their SQL where
there is one, else they run and keep their schema."""

import pytest

from compare import oracle_rows, spark_rows
from weftline.llm import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, name):
    got = spark_rows(plans.QUERIES[name](spark, data))
    if name in plans.ORACLE:
        assert got == oracle_rows(data, plans.ORACLE[name])


def test_found_columns(spark, data):
    want = {"p1_found": ["keep_id", "copy_id"], "p5_found": ["path"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}
    for k, cols in want.items():
        df = plans.QUERIES[k](spark, data)
        assert df.columns == cols and df.count() == df.distinct().count()


def test_nothing_outside_imports_it():
    from pathlib import Path

    root = Path(plans.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


TABLES = {
    "sql_query": "id string, sql string, key string, h string",
    "src_file": "path string, repo_path string, sha string, dialect string, parse_failed boolean, parse_cause string, indexed_at timestamp",
    "file_text": "path string, sha string, content string, dialect string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, repo_path string, n_tokens int, topic string",
    "eval_item": "item_id long, text string, task string",
    "mix_target": "source string, target_share double, max_repeats long",
}


def test_empty_tables(spark, tmp_path):
    for n, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{n}.parquet"))
    for name, f in plans.QUERIES.items():
        assert f(spark, str(tmp_path)).collect() == [], name


def test_rows_of_nulls(spark, tmp_path):
    for n, schema in TABLES.items():
        spark.createDataFrame([tuple([None] * (schema.count(",") + 1))] * 3, schema).write.parquet(str(tmp_path / f"{n}.parquet"))
    for name, f in plans.QUERIES.items():
        assert f(spark, str(tmp_path)).collect() == [] or name == "p9_clean", name
