"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators.common import spread

__all__ = ["BLANKS", "BROADCAST_ROWS", "ROW", "WORD", "counted", "free_name", "least_rows", "met", "numbered", "remove_written", "shared_folder", "spread", "table", "without_rows", "written"]

#: Characters that separate words: space and the five ASCII control blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
#: The most rows of a number or two that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 18

#: A row's name in a schema.
ROW = "row struct<file:long,at:long>"
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_own_folder: str | None = None
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    A cluster names it in spark.checkpoint.dir, and has to: a folder of the
    driver's own machine would be another one on each executor. On a local
    master alone a temporary folder is made once, used, and removed at the end.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="lexarium-")
        atexit.register(shutil.rmtree, _own_folder.removeprefix("file://"), ignore_errors=True)
    return _own_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    It cuts the lineage: a lost executor costs a reread and no recomputation,
    and several consumers don't repeat the work below.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, _BATCH_BYTES)  # what stands outside an executor's heap for each Python worker
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, was)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete all that ``written`` has put into the shared folder; for use once the results are stored. Returns how many tables went."""
    gone, path_of = 0, spark._jvm.org.apache.hadoop.fs.Path
    while _paths:
        path = path_of(_paths.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df with a column that names each row, and the name of that column.

    A row of files is named by its file and its place there, which every later
    read gives again; so df's texts aren't copied. What isn't a plain scan of
    Parquet files is written with a number for each row. Either way the name
    is the same in every later read, whatever doc_id the row has.
    """
    row = free_name(df, "row_name")
    if _is_scan(df):
        return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row
    return written(df.withColumn(row, counted()), label), row


def counted() -> Column:
    """A name for each row of a table that is read once."""
    return F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))


def _is_scan(df: DataFrame) -> bool:
    """Whether df is Parquet files as they are, or projections and filters of them."""
    if any(c.lower() == "_metadata" for c in df.columns):
        return False
    nodes = df._jdf.queryExecution().analyzed().toString().splitlines()
    above, last = nodes[:-1], nodes[-1].lstrip(" +-:")
    return last.startswith("Relation ") and last.endswith(" parquet") and all(n.lstrip(" +-:").startswith(("Project ", "Filter ")) for n in above)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def met(df: DataFrame, small: DataFrame, row: str, how: str) -> DataFrame:
    """df joined by the rows' names with a written table.

    The table is counted first: up to BROADCAST_ROWS rows it is broadcast and
    df, which holds the texts, stays where it is; beyond, both are shuffled by
    the row's name, which no key makes uneven.
    """
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, row, how)


def without_rows(df: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of a numbered df that aren't among gone(row), without their names."""
    return met(df, written(gone.select(row), "gone"), row, "left_anti").drop(row)


def least_rows(df: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """The n rows of df with the least order, a hash of 64 bits, then the least ties.

    A bound on the hash, taken from the count, lets through little more than n
    rows of the whole table, so the sort that follows gathers no n rows from
    every partition. Where the bound lets through too few, all rows are sorted.
    """
    total = df.count()
    share = (1.5 * n + 64) / max(total, 1)
    if share < 0.5:
        bounded = df.filter(order < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long"))
        if bounded.count() >= n:
            df = bounded
    return df.orderBy(order, *ties).limit(n)
