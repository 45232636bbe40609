"""A graph as immutable snapshots with an atomic pointer, and its pages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import empty_graph
from ..schema import RELATIONS, VERSION


class GraphStore:
    """Snapshots under a folder. A snapshot is written whole and becomes current
    by renaming one small pointer file into place; readers keep what they
    opened. Pointers are numbered, so a second writer that started from the
    same state fails instead of hiding the first one's work."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._P = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._P(f"{self.path}/pointers"))

    def _pointers(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._P(f"{self.path}/pointers"))]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def current(self) -> dict | None:
        p = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{p[-1]}", wholetext=True).first()[0]) if p else None

    def read(self) -> dict[str, DataFrame]:
        """Relations of the current snapshot; all empty before the first one."""
        c = self.current()
        if c is None:
            return empty_graph(self.spark)
        return {n: self.spark.read.parquet(f"{c['data']}/{n}") for n in c["relations"]}

    def write(self, graph: dict[str, DataFrame], sha: str | None = None, need_files: bool = True) -> str:
        """Write a snapshot and make it current. A full rebuild that found no
        files raises and changes nothing."""
        names = self._pointers()
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        for n, df in graph.items():
            df.write.parquet(f"{data}/{n}")
        if need_files and "file" in graph and self.spark.read.parquet(f"{data}/file").isEmpty():
            self._fs.delete(self._P(data), True)
            raise ValueError("no files: the current snapshot stays")
        what = {"data": data, "relations": sorted(graph), "version": VERSION, "indexed_sha": sha}
        tmp, to = self._P(f"{self.path}/pointers/.{uuid.uuid4().hex}"), self._P(f"{self.path}/pointers/{len(names):012d}.json")
        f = self._fs.create(tmp, True)
        f.write(bytearray(json.dumps(what).encode()))
        f.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise RuntimeError("another writer was faster")
        return data

    def clear(self) -> None:
        """Make an empty graph current."""
        self.write({n: self.spark.createDataFrame([], s) for n, s in RELATIONS.items()}, need_files=False)


def freshness(store: GraphStore, head_sha: str | None, commits_behind: int | None = None) -> dict:
    """Whether the current snapshot is of head_sha and of this version."""
    c = store.current() or {}
    return {"indexed_sha": c.get("indexed_sha"), "stale": head_sha is not None and c.get("indexed_sha") != head_sha, "commits_behind": commits_behind, "version_stale": bool(c) and c.get("version") != VERSION}


def html_page(nodes: DataFrame, links: DataFrame, most: int = 50_000) -> str:
    """One page with the graph baked in, for at most `most` tables and ten times
    as many links (more is an error): nodes (id, schema, kind, deg, cat), links
    (source, target, n), neighbours."""
    n = [json.loads(r[0]) for r in nodes.orderBy("id").limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(n) > most:
        raise ValueError(f"more than {most} tables: pick a part of the graph")
    ids = {x["id"] for x in n}
    e = [json.loads(r[0]) for r in links.orderBy("source", "target").limit(10 * most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(e) > 10 * most:
        raise ValueError(f"more than {10 * most} links: pick a part of the graph")
    adj: dict[str, set[str]] = {}
    for x in e:
        adj.setdefault(x["source"], set()).add(x["target"])
        adj.setdefault(x["target"], set()).add(x["source"])
    data = json.dumps({"nodes": n, "links": e, "adj": {k: sorted(v) for k, v in sorted(adj.items()) if k in ids}}).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>Lineage</title><style>body{{font:14px sans-serif;margin:1em}}li{{cursor:pointer}}</style>
<input id="q" placeholder="table"><ul id="l"></ul><pre id="d"></pre><script>
const G={data};const l=document.getElementById('l'),d=document.getElementById('d');
function show(){{const q=document.getElementById('q').value.toLowerCase();l.innerHTML='';
for(const n of G.nodes.filter(n=>n.id.includes(q)).slice(0,200)){{const li=document.createElement('li');li.textContent=`${{n.id}} (${{n.kind}}, ${{n.deg}})`;
li.onclick=()=>{{d.textContent=(G.adj[n.id]||[]).join('\\n')}};l.appendChild(li)}}}}
document.getElementById('q').oninput=show;show();</script>"""


def as_json(df: DataFrame, most: int = 10_000) -> list[str]:
    """Rows as JSON text, for reports of at most `most` rows; more is an error:
    write_json() has no bound."""
    got = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} rows: use write_json()")
    return got


def write_json(df: DataFrame, path: str) -> None:
    """All rows as files of JSON lines."""
    df.write.json(path)
