"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialize import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

#: What splits words: ASCII white space only.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Characters of SPACE other than the blank itself, for str.translate.
_TO_BLANK = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
#: A-Z only, whatever the locale.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words_of(text: str) -> list[str]:
    """The maximal runs of characters other than ASCII white space."""
    if "\t" in text or "\v" in text or "\f" in text or "\r" in text or "\n" in text:
        text = text.translate(_TO_BLANK)
    return [w for w in text.split(" ") if w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Python workers get this repository on their path."""
    paths = spark.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most rows of an Arrow batch of texts: they are some kB each, and an executor holds a batch several times over.
BATCH_ROWS = 2000


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, and the session's Arrow batches small enough for texts.

    A few small files would otherwise leave most cores idle in work that is
    bound by CPU. Inputs of a useful size have more splits already and aren't
    shuffled.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """What an Arrow function needs, and the place of the text in it: the columns ``keep``, and the text where it isn't one of them."""
    if text in keep:
        return spread(df.select(*keep)), keep.index(text)
    return spread(df.select(*keep, F.col(text).alias("__text"))), len(keep)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def held_out_value(doc_id: int | None) -> bool:
    """The same on the driver."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def groups_of(n_rows: int, per_group: int) -> int:
    return max(1, -(-n_rows // per_group))


def dealt(doc_id: str, *more: Column) -> Column:
    """A number to deal rows by: a hash of the id and ``more``, or where the id is null the row's own number, so that null ids don't meet.

    Only for a column that is written before it is used: a row's number is
    another one where its input is read in other parts.
    """
    return F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(doc_id, *more))


def gapless(df: DataFrame, key: str, order: list[str], spread_by: list[str], to: str, n_buckets: Column) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in column ``to``.

    A window over a whole key would put it into one task. Here each key is
    dealt into n_buckets (an expression of the key) by a hash of ``spread_by``,
    rows are numbered within (key, bucket), and the rows of earlier buckets are
    added. ``key`` must not be null. Rows equal in ``order`` get distinct
    numbers in any order. The counts table has a row for each bucket, a small
    fraction of the input where n_buckets follows groups_of().
    """
    from pyspark.sql import Window

    put = df.withColumn("__bucket", F.pmod(F.xxhash64(*spread_by), n_buckets.cast("long")))
    counts = put.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(key, "__bucket").orderBy(*order)
    return (
        put.withColumn("__rank", F.row_number().over(within).cast("long"))
        .join(starts, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(to, F.col("__start") + F.col("__rank") - 1)
        .drop("__bucket", "__key", "__b", "__start", "__rank")
    )


def released(run):
    """An Arrow function that gives its memory back when its task ends: workers serve later tasks too, of other functions."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Return what is free to the system: Python's, Arrow's and the C library's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what is free
        pass


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met so far."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word)
        return h

    def of(self, words: list[str]):
        import numpy as np

        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def batches_of(texts: list[str | None], most: int = 1 << 19):
    """(start, end) of runs of texts of about ``most`` characters; a longer text is a run of its own."""
    start = held = 0
    for k, t in enumerate(texts):
        size = len(t) if t else 0
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
