"""Shared pieces: the scratch folder, lineage cuts, words, row keys, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of the corpus contracts.
SPACE = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only when its estimated bytes stay below this.
BROADCAST_BYTES = 32 << 20


#: Where a local session whose spark.checkpoint.dir is unset keeps its tables.
_LOCAL = "siloflow.scratch"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Unset, it is refused on a cluster; a local session, as in tests, gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siloflow-")
        spark.conf.set(_LOCAL, base)
    return f"{base.rstrip('/')}/siloflow/{uuid.uuid4().hex}"


#: Folders written by ``cut`` within the running ``tidy`` functions of this thread or task, innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends, and a lost executor costs a reread only."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    if _WRITTEN.get():
        _WRITTEN.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read_by(df: DataFrame) -> str:
    """The root paths of the files that a plan reads, joined."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = (leaves.apply(i) for i in range(leaves.size()))
    return " ".join(x.relation().location().rootPaths().mkString(" ") for x in found if x.getClass().getSimpleName() == "LogicalRelation")


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete what the operator cut off on its way and its result does not read; the rest is left to an outer ``tidy``."""

    @wraps(operator)
    def tidied(*args, **kwargs) -> DataFrame:
        outer, written = _WRITTEN.get(), []
        token = _WRITTEN.set((*outer, written))
        try:
            out = operator(*args, **kwargs)
            needed = _read_by(out)
        finally:
            _WRITTEN.reset(token)
        for path in written:
            if path.rsplit("/", 1)[1] not in needed:
                remove(out.sparkSession, path)
            elif outer:
                outer[-1].append(path)
        return out

    return tidied


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, which reaches any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change accented letters."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separator: str = SPACE) -> Column:
    """The array of words; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def text_key(text: Column) -> list[Column]:
    """Two hashes that tell texts apart, for grouping rows without shuffling their text."""
    return [
        F.xxhash64(text).alias("_t1"),
        F.xxhash64(F.lit(7), text).alias("_t2"),
    ]


def fits_broadcast(n_rows: int, row_bytes: int) -> bool:
    return n_rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted rows fit; otherwise leave the choice (a shuffled join) to the planner."""
    return F.broadcast(df) if fits_broadcast(n_rows, row_bytes) else df


#: Bits of a sieve, and of each of its rows: a table of 16 MB at most, whatever it is made of.
SIEVE_BITS, SIEVE_ROW = 1 << 27, 1 << 15


def sieved(df: DataFrame, wanted: DataFrame, key: Callable[[], Column]) -> DataFrame:
    """The rows of df whose key, a hash, falls on a bit that a key of wanted sets: all that can meet, and few others if wanted has fewer rows than there are bits.

    It stands before a join that shuffles, so that little of a large side is moved.
    """
    at = lambda x: x.withColumn("_at", F.pmod(key(), F.lit(SIEVE_BITS))).withColumn("_block", F.floor(F.col("_at") / SIEVE_ROW)).withColumn("_bit", F.col("_at") % SIEVE_ROW)
    sieve = at(wanted).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) > 0
    return at(df).join(F.broadcast(sieve), "_block").where(is_set).select(*df.columns)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
