"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Only a local master without one gets a temporary folder; on a cluster a
    missing setting is an error, as each executor would write to its own disk.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="diffloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or named


def forgotten(df: DataFrame) -> DataFrame:
    """df without the size that Spark guessed for it.

    A checkpoint keeps the guess of its plan, and a join's guess is the product
    of both sides: in a loop of joins its digits double again and again until
    the driver does nothing but multiply.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there.

    narrow: rows of a few numbers each, written in an eighth of the partitions
    (32 at least) to spare small files, with no guess of their size.

    The copy survives lost executors.  Where the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints, Spark removes it once no
    plan refers to it any more; else it stays until the folder is cleared.
    """
    shared_dir(df.sparkSession)
    if narrow:
        df = df.coalesce(max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    out = df.checkpoint(eager=True)
    return forgotten(out) if narrow else out


#: Rows of whole texts in one batch for Python: batches of Spark's default of 10,000 hold 30 MB and more, in the JVM and in Python.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's batches for Python to TEXT_ROWS rows; a smaller setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= TEXT_ROWS:
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, rows go to Python in batches of at most `most`, for eager steps whose rows hold several texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """Return freed memory of a Python worker, which Spark keeps for later tasks, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends: workers wait for other stages beside busy ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def salted_join(rows: DataFrame, lookup: DataFrame, on: list[str], spread: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Join rows to a lookup with unique keys when one key may hold a third of the rows.

    Each lookup row is repeated for every salt and the rows of a key are dealt
    over the salts by `spread`, so no task gets more than a share of a key.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def held_out(col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text leaves the remainder `fold`; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Ids that may be broadcast: about 2 MB of long values.
BROADCAST_IDS = 250_000


def by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows whose `on` is (left_semi) or isn't (left_anti) in the one-column ids.

    The ids are counted first: up to BROADCAST_IDS they are broadcast and the
    rows, with their texts, stay where they are; more of them meet the rows in
    a shuffle.
    """
    few = ids.count() <= BROADCAST_IDS
    ids = ids.toDF("_wanted")
    return rows.join(F.broadcast(ids) if few else ids, rows[on] == ids["_wanted"], how)
