"""Node and edge relations of the lineage graph."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


def _t(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in cols])


_EDGE = (("src_key", _S), ("dst_key", _S))

NODES: dict[str, T.StructType] = {
    "repo": _t(("path", _S), ("name", _S)),
    "file": _t(("path", _S), ("repo_path", _S), ("sha", _S), ("dialect", _S), ("parse_failed", _B), ("parse_cause", _S), ("skip_counts", _S)),
    "sql_table": _t(("qualified", _S), ("catalog", _S), ("db", _S), ("name", _S), ("kind", _S), ("defined_in_file", _S)),
    "sql_column": _t(("id", _S), ("catalog", _S), ("db", _S), ("table_name", _S), ("col_name", _S), ("table_qualified", _S)),
    "sql_query": _t(
        ("id", _S), ("file_path", _S), ("statement_index", _L), ("sql", _S), ("kind", _S), ("target_table", _S), ("parse_failed", _B), ("qualify_failed", _B), ("confidence", _D), ("parsing_mode", _S), ("start_line", _L)
    ),
    "schema_version": _t(("version", _S), ("indexed_sha", _S), ("tool_version", _S)),
    "external_consumer": _t(("name", _S), ("consumer_type", _S)),
}
EDGES: dict[str, T.StructType] = {
    "belongs_to": _t(*_EDGE),
    "defined_in": _t(*_EDGE),
    "query_defined_in": _t(*_EDGE),
    "has_column": _t(*_EDGE, ("source", _S)),
    "selects_from": _t(*_EDGE),
    "column_lineage": _t(*_EDGE, ("transform", _S), ("confidence", _D), ("query_id", _S), ("inferred_from_source_name", _B)),
    "star_source": _t(*_EDGE, ("qualifier", _S), ("target_table", _S), ("confidence", _D)),
    "join_col_resolve": _t(*_EDGE, ("bare_col", _S)),
    "consumed_by": _t(*_EDGE),
    "inserts_into": _t(*_EDGE),
    "deletes_from": _t(*_EDGE),
    "updates": _t(*_EDGE),
    "declares": _t(*_EDGE),
}
RELATIONS = {**NODES, **EDGES}

#: Key columns of each relation.
KEYS = {"repo": ["path"], "file": ["path"], "sql_table": ["qualified"], "sql_column": ["id"], "sql_query": ["id"], "schema_version": ["version"], "external_consumer": ["name"], **{e: ["src_key", "dst_key"] for e in EDGES}}

VERSION = "11"
WRITE_KINDS = ("INSERT", "MERGE", "CREATE_TABLE", "UPDATE")
SYNTHETIC = ("cte", "derived", "temp")

#: Precedence of what says that a table has a column.
SOURCE_RANK = {"ddl": 3, "information_schema": 2, "usage": 1}
