"""Processing only new or changed records, surviving failures."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_versions(files: DataFrame, upto=None) -> DataFrame:
    """(path, sha, seen_at): each path's row with the greatest indexed_at among
    those with a sha; on equal times the greatest sha. Rows without path, sha or
    time have no place in the order and are left out. upto (a timestamp) is the
    fixed upper bound of a run: later rows wait for the next one."""
    f = files.where(F.col("path").isNotNull() & F.col("sha").isNotNull() & F.col("indexed_at").isNotNull())
    if upto is not None:
        f = f.where(F.col("indexed_at") <= F.lit(upto))
    top = f.groupBy("path").agg(F.max(F.struct("indexed_at", "sha")).alias("_t"))
    return top.select("path", F.col("_t.sha").alias("sha"), F.col("_t.indexed_at").alias("seen_at"))


def done_versions(done: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, last): what the latest of successful runs (run_id, finished_at)
    that handled a path left behind; last has seq, run_id, done_at and sha. seq,
    the place of the run in the commit sequence, is its finished_at: it grows
    with every commit. On equal times run_id, done_at and sha decide."""
    ok = runs.groupBy(F.col("run_id").alias("_run")).agg(F.max("finished_at").alias("seq"))
    # repeated log rows collapse before the join; the log grows with each run,
    # the list of runs stays far smaller and its join strategy is left to Spark
    log = done.where(F.col("path").isNotNull()).groupBy("run_id", "path").agg(F.max(F.struct("done_at", "sha")).alias("_l"))
    j = log.join(ok, F.col("run_id") == F.col("_run"))
    return j.groupBy("path").agg(F.max(F.struct("seq", "run_id", F.col("_l.done_at").alias("done_at"), F.col("_l.sha").alias("sha"))).alias("last"))


def _merge(new: dict[str, DataFrame], done: DataFrame, state: DataFrame | None) -> DataFrame:
    """The state after a run: per path its current version and what the latest
    successful run left behind. One aggregation over the old state and what is
    new."""
    cur = latest_versions(new["files"]).select("path", F.struct("seen_at", "sha").alias("cur"))
    past = done_versions(done, new["runs"])
    rows = cur.withColumn("last", F.lit(None).cast(past.schema["last"].dataType)).unionByName(past.withColumn("cur", F.lit(None).cast(cur.schema["cur"].dataType)))
    rows = rows if state is None else rows.unionByName(state)
    return rows.groupBy("path").agg(F.max("cur").alias("cur"), F.max("last").alias("last"))


def _pending(state: DataFrame) -> DataFrame:
    """(path, sha, seen_at, reason) of a state: versions the next run has to
    process. reason is 'new' if no successful run handled the path, else
    'changed'."""
    reason = F.when(F.col("last").isNull(), "new").when(~F.col("cur.sha").eqNullSafe(F.col("last.sha")), "changed")
    s = state.where(F.col("cur").isNotNull()).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return s.select("path", F.col("cur.sha").alias("sha"), F.col("cur.seen_at").alias("seen_at"), "reason")


def pending(ledger: Ledger, files: DataFrame, done: DataFrame, runs: DataFrame, upto=None, late: str | None = None, fail: str | None = None) -> DataFrame:
    """One run of the ledger over file versions: what the next run has to
    process (path, sha, seen_at, reason).

    Of files and of successful, finished runs only what came since the last
    commit is read, up to bounds fixed when the run starts (upto, a time, lowers
    them); of done only the records of those runs. The state - per path the
    current version and the last one handled - is merged with it and committed
    together with the output and both watermarks. Null paths, shas and times
    have no place in the order and are left out."""
    f = files.where(F.col("path").isNotNull() & F.col("sha").isNotNull() & F.col("indexed_at").isNotNull()).select("path", "sha", "indexed_at")
    ok = runs.where((F.col("status") == "success") & F.col("finished_at").isNotNull()).select("run_id", "finished_at")
    sources = {"files": Source(f, "indexed_at", ("path", "sha"), late), "runs": Source(ok, "finished_at", ("run_id",), late)}
    ledger.run(sources, lambda new, state: _merge(new, done, state), _pending, upto, fail)
    out = ledger.output()
    return out if out is not None else files.sparkSession.createDataFrame([], "path string, sha string, seen_at timestamp, reason string")


@dataclass
class Source:
    """Rows with a sequence column that grows with their arrival, and the key
    columns that tell rows of one sequence value apart. Rows without a sequence
    value are never read. late (an SQL interval or number) is how far behind the
    greatest value seen a row may still arrive. The DataFrame must give the same
    rows whenever it is read in a run (files listed once, a table's version)."""

    df: DataFrame
    seq: str
    key: tuple[str, ...]
    late: str | None = None

    def since(self, value: Column) -> Column:
        """The least sequence value at which rows may still be new."""
        return value if self.late is None else value - F.expr(self.late)


class Ledger:
    """Runs over sources; output, state and watermarks committed together.

    A run reads (low, high]: low is the last commit's watermark, high the
    greatest sequence value there is when the run starts, fixed before anything
    is read. Rows at the watermark itself (and up to `late` below it) may still
    arrive: the keys of those that were read are kept with the commit, the range
    is read from there again and they are left out, so a tie is neither skipped
    nor repeated. A row later than that is not read: the sequence has to be the
    order of arrival up to `late`.

    Output and state go to a folder of the run; then one small commit file,
    which names them and the new watermarks, is renamed into place. The rename
    fails if the name is taken, and is atomic on HDFS and local file systems, so
    all is visible or nothing is. A run that dies leaves a folder no commit
    names; the next one starts again at the old watermark. Of two runs that
    start from one commit the later fails and changes nothing. (Object stores
    without atomic rename need a single writer.) Nothing new commits nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_pkg = spark._jvm.org.apache.hadoop.fs
        self._p = self._fs_pkg.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._p(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._p(f"{self.path}/commits"))

    def _commits(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/commits"))]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def _last(self) -> dict | None:
        c = self._commits()
        return json.loads(self.spark.read.text(f"{self.path}/commits/{c[-1]}", wholetext=True).first()[0]) if c else None

    def watermarks(self) -> dict[str, str | None]:
        """The last committed watermark of each source as text."""
        last = self._last()
        return {k: v["high"] for k, v in last["sources"].items()} if last else {}

    def run(self, sources: dict[str, Source], work: Callable, emit: Callable | None = None, upto=None, fail: str | None = None) -> bool:
        """Process what came since the last commit; tells whether it committed.

        work(new, state) gets a DataFrame of new rows per source and the last
        state (None at first). Without emit its result is the run's output;
        with emit it is the new state, and emit(state) the output. upto lowers
        all upper bounds. fail ('before' or 'after' the commit) is for tests."""
        names, last = self._commits(), self._last()
        lit = lambda x, s: F.lit(x).cast(s.df.schema[s.seq].dataType)
        new, marks, edges, any_new = {}, {}, {}, False
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        for k, s in sources.items():
            was = last["sources"].get(k) if last else None
            low = was["high"] if was else None
            rows = s.df.where(F.col(s.seq).isNotNull())
            if low is not None:
                rows = rows.where(F.col(s.seq) >= s.since(lit(low, s)))
            if upto is not None:
                rows = rows.where(F.col(s.seq) <= lit(upto, s))
            top = rows.agg(F.max(F.col(s.seq)).cast("string")).first()[0]
            # the watermark never falls back below the last one
            high = low if top is None else top if low is None else self.spark.range(1).select(F.greatest(lit(low, s), lit(top, s)).cast("string")).first()[0]
            marks[k] = {"high": high, "edge": was["edge"] if was else None}
            if high is None:
                new[k] = rows.where(F.lit(False))
                continue
            rows = rows.where(F.col(s.seq) <= lit(high, s))
            held = [s.seq, *s.key]
            seen = self.spark.read.parquet(was["edge"]) if was and was["edge"] else None
            if seen is not None:
                same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in held]
                rows = rows.join(seen.select(*[F.col(c).alias(f"_s_{c}") for c in held]), same, "left_anti")
            new[k] = rows
            if low is None or not rows.isEmpty():
                any_new = True
                edge = rows.select(*held) if seen is None else rows.select(*held).unionByName(seen)
                edges[k] = edge.where(F.col(s.seq) >= s.since(lit(high, s))).distinct()
        if not any_new:
            return False
        state = self.spark.read.parquet(last["state"]) if last and last["state"] else None
        got = work(new, state)
        if emit is not None:
            got.write.parquet(f"{at}/state")
            got = emit(self.spark.read.schema(got.schema).parquet(f"{at}/state"))
        got.write.parquet(f"{at}/output")
        for k, e in edges.items():
            e.write.parquet(f"{at}/edge-{k}")
            marks[k]["edge"] = f"{at}/edge-{k}"
        if fail == "before":
            raise RuntimeError("stopped before the commit")
        self._commit(f"{len(names):012d}.json", {"output": f"{at}/output", "state": f"{at}/state" if emit is not None else None, "sources": marks})
        if fail == "after":
            raise RuntimeError("stopped after the commit")
        return True

    def _commit(self, name: str, what: dict) -> None:
        tmp = self._p(f"{self.path}/commits/.{uuid.uuid4().hex}.tmp")
        f = self._fs.create(tmp, True)
        f.write(bytearray(json.dumps(what).encode()))
        f.close()
        to = self._fs.makeQualified(self._p(f"{self.path}/commits/{name}"))
        kind = getattr(self._fs_pkg, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE  # fails if the name is taken
        try:
            self._fs_pkg.FileContext.getFileContext(to.toUri(), self._conf).rename(self._fs.makeQualified(tmp), to, how)
        except Exception as e:
            self._fs.delete(tmp, False)
            raise RuntimeError(f"another run has committed {name}") from e

    def output(self) -> DataFrame | None:
        """The last commit's output (with a state, output speaks of all that was
        read), or None before the first commit."""
        last = self._last()
        return self.spark.read.parquet(last["output"]) if last else None

    def outputs(self) -> DataFrame | None:
        """The outputs of all commits together."""
        paths = [json.loads(self.spark.read.text(f"{self.path}/commits/{n}", wholetext=True).first()[0])["output"] for n in self._commits()]
        return self.spark.read.parquet(*paths) if paths else None
