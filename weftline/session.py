"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or cpus))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session. Only
    where that is unset (tests in local mode) a temporary folder is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="weftline-")
    return _FALLBACK[app]


def job_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, tag: str = "t", where: str = "true") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the plan ends
    there, and a lost executor costs no recomputation of earlier rounds. Its
    rows, and those that satisfy `where`, are counted on the way."""
    spark = df.sparkSession
    path = f"{job_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.expr(where)).alias("w")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path  # type: ignore[attr-defined]
    got = seen.get
    if "n" not in got:  # a plan the optimiser emptied may bring no metrics
        got = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(where)).alias("w")).first().asDict()
    out._weftline_rows, out._weftline_where = got["n"], got["w"]  # type: ignore[attr-defined]
    return out


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Inside, plans are not made again while they run. For a chain of many
    equal shuffles: adaptive execution would plan the whole chain again after
    each of them, at a cost that grows with the square of their number."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_written(df: DataFrame) -> int:
    """Rows of a table made by cut(), as counted when it was written: never less
    than there are, more if a lost task was repeated. Good for choosing a way to
    go and for telling none from some, not for results."""
    return df._weftline_rows  # type: ignore[attr-defined]


def rows_where(df: DataFrame) -> int:
    """As rows_written(), of the rows that satisfy cut()'s `where`."""
    return df._weftline_where  # type: ignore[attr-defined]


def is_empty(df: DataFrame) -> bool:
    return rows_written(df) == 0 if hasattr(df, "_weftline_rows") else df.isEmpty()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(*dfs: DataFrame | None) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_weftline_path", None)
        if path:
            _delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables made by cut() in this application: for the end of a
    job, when its results are written."""
    _delete(spark, job_dir(spark))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they
    need not have it installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="weftline-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
