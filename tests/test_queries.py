"""Every registered query with SQL against that SQL on the smallest tables; the
others must run and keep their schema."""

import pytest

import __spark_entry__ as entry
from compare import oracle_rows, spark_rows

CORE = {k: v for m in entry.MODULES for k, v in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}
SQL = {k: v for m in entry.MODULES for k, v in __import__(m, fromlist=["ORACLE"]).ORACLE.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, name):
    got = spark_rows(CORE[name](spark, data))
    if name in SQL:
        assert got == oracle_rows(data, SQL[name])


def test_entry_has_rows(spark, data, monkeypatch):
    df = entry.entry(spark)
    assert df.columns == ["node_key", "root_key", "depth"] and df.limit(1).count() == 1


def test_optional_package_may_be_absent(monkeypatch):
    monkeypatch.setattr(entry, "OPTIONAL", ["weftline.llm_absent_here"])
    monkeypatch.setattr(entry.importlib, "import_module", _importer(entry.importlib.import_module))
    assert "p3_found" in entry.queries()


def _importer(real):
    def run(name):
        if name == "weftline.llm_absent_here":
            raise ModuleNotFoundError("absent", name="weftline.llm")
        return real(name)

    return run
