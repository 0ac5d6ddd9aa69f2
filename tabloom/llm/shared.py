"""Cutting lineage: tables in the folder that all executors share, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = (1 << 63) - 1
#: What was written: the JVM's file system and path, which outlive a stopped session, and the path as text.
_WRITTEN: list[tuple[object, object, str]] = []

#: Bytes of a batch that goes to Python: the setting, what it is where nobody has set it, and what it becomes then.
BATCH, UNSET, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes; what a task has freed goes back to the system."""
    spark = df.sparkSession
    if spark.conf.get(BATCH) == UNSET:
        spark.conf.set(BATCH, BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back what Arrow and the C library keep of freed memory: workers wait for the next stage, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir; only where that is unset, a local one, as in tests.

    On a cluster a local folder would hide what executors write, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tabloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written() -> int:
    """How many paths have been given out and not removed."""
    return len(_WRITTEN)


def remove(since: int = 0, last: int = 0) -> None:
    """Remove what was written after the first ``since`` paths, but for the ``last`` ones."""
    to = len(_WRITTEN) - last
    for fs, at, _ in _WRITTEN[since:to]:
        with contextlib.suppress(Exception):  # a stopped JVM; the folder is the cluster's to clear then
            fs.delete(at, True)
    del _WRITTEN[since:to]


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the program ends, or by :func:`remove`."""
    path = f"{folder(spark)}/tabloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((at.getFileSystem(spark._jsc.hadoopConfiguration()), at, path))
    return path


def table(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later steps do not depend on lost executors."""
    spark = df.sparkSession
    path = place(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


atexit.register(remove)

#: Rows up to which a written side is broadcast, at 16 to 48 bytes a row; beyond it, joins are shuffled.
SMALL = 400_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: Rows of a sieve, as powers of two: at least, and at most, at about 64 bytes a row where it is broadcast.
WORDS = (18, 20)


def sifted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose columns ``on`` are in a written table of keys, and few others where the table is too large to broadcast.

    There a sieve of bounded size takes its place: each key sets three bits of one 64-bit
    word, and a row goes on if its own three are set.  With half a million keys one row in
    several hundred passes by chance; a join with the keys drops these, and shuffles no others.
    """
    n = keys.count()
    if n <= SMALL:
        return df.join(F.broadcast(keys), on, "left_semi")
    width = min(WORDS[1], max(WORDS[0], (n // 2).bit_length()))
    h = F.xxhash64(F.lit(7), *on)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    word: list[Column] = [F.shiftrightunsigned(h, 64 - width).alias("sieve_at"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).alias("sieve_bits")]
    words = keys.select(*word).groupBy("sieve_at").agg(F.bit_or("sieve_bits").alias("set"))
    passes = F.col("sieve_bits").bitwiseAND(F.col("set")) == F.col("sieve_bits")
    rows = df.select("*", *word).alias("rows").join(F.broadcast(words).alias("words"), (F.col("rows.sieve_at") == F.col("words.sieve_at")) & passes, "left_semi")
    return rows.drop("sieve_at", "sieve_bits")


def keyed(docs: DataFrame) -> DataFrame:
    """(d, th, row): the id with null as the largest, a hash of the text, and all columns of docs."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("th"), row.alias("row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all columns, less the documents (d, th) of a written table."""
    left = keyed(docs).join(small(gone.select("d", "th")), ["d", "th"], "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not the least of its component, with the least.

    Edges are (a, b) of one orderable type.  Alternates large stars and small stars;
    each round's edges are written to the shared folder, and the rounds, which grow
    with the logarithm of the longest chain, end when a round changes nothing.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return now
        before = sign
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = table(small.union(lowest.select("a", "m")).distinct())
