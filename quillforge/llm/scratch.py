"""Shared scratch folders, sized salting and other Spark helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: paths of written tables that no sweep has deleted yet
_LIVE: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. One is made here where it is unset and all is on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillforge-")
    return _OWN[app]


#: rows of a batch for Python, at most, while a table is written: batches of whole texts are held on both sides
BATCH_ROWS = 2000


@contextmanager
def _under(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, sort: list[str] | None = None, by: str | None = None, **options: str) -> DataFrame:
    """Writes df to the shared folder (in a part for each value of by) and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    with _under(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        df = df.select("*")  # a new plan, under the setting
        (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _LIVE.append(path)
    return out


#: for tables of packed rows, which have up to some MB each: few are held at a time when they are read, written or sent to Python.
#: By default a reader holds 4096 rows and a writer 128 MB a task, in arrays that make an executor's heap grow and stay large
PACKED_SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": "16",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.maxConcurrentOutputFileWriters": "16",  # parts are written side by side, not sorted first
}
PACKED_OPTIONS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4"}


def settled(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """written() for packed rows, and the shuffle files of the query go as soon as it ends, not when the driver next collects garbage."""
    with _under(df.sparkSession, PACKED_SETTINGS | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return written(df, name, by=by, **PACKED_OPTIONS | options)


def mark() -> int:
    """What sweep() takes as the begin of an operator's own tables."""
    return len(_LIVE)


def sweep(spark: SparkSession, since: int, *keep: DataFrame | None) -> None:
    """Deletes tables written since the mark but for keep: what is left to read must be in keep."""
    stay = {getattr(df, "_scratch", None) for df in keep}
    mine = _LIVE[since:]
    _LIVE[since:] = [p for p in mine if p in stay]
    for p in mine:
        if p not in stay:
            _delete(spark, p)


def drop_part(spark: SparkSession, df: DataFrame, part: str) -> None:
    """Deletes a part of a table written by a column; no query may read it again."""
    _delete(spark, f"{df._scratch}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col):
    """Lower-cases A-Z only. Pure ASCII text takes the fast path; other text keeps its non-ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """rows join table on key, where table has one row for each key and ``weight`` says how many rows carry it.

    Keys with at least total/1000 rows number at most 1000, so that part is broadcast under a
    proven bound and its rows are never shuffled; the others go by a shuffled join whose
    largest key holds under a thousandth of all rows.
    """
    least = max(1, total // 1000)
    if how != "left":
        raise ValueError("only left joins")
    hot = F.broadcast(table.filter(F.col(weight) >= least).select("*", F.lit(True).alias("__hot")))
    cold = table.filter(F.col(weight) < least)
    first = rows.join(hot, key, "left")
    extra = [c for c in table.columns if c != key]
    near = first.filter(F.col("__hot")).select(*rows.columns, *extra)
    far = first.filter(F.col("__hot").isNull()).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *extra)
    return near.unionByName(far)
