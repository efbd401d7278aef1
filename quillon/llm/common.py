"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship

#: A word is a maximal run of anything but ASCII white space, in Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; executors get the package where they lack it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; a local session without the
    setting (tests) gets a folder of its own, which is then set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: lineage ends there."""
    path = f"{root}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this worker's operators remember, and how each forgets it.
_memos: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """``operator`` keeps something between tasks that ``forget`` lets go of."""
    _memos[operator] = forget


def lean(operator: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The kernel ``run`` of ``operator`` in a worker that other operators' kernels have used before.

    Workers live on from stage to stage: what others remember goes when this one begins, and memory
    that isn't in use returns to the system when a task ends.
    """

    def kept(batches):
        for other, forget in _memos.items():
            if other != operator:
                forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return kept


def trim() -> None:
    """Gives unused memory back to the system, as far as the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results are stored.

    Spark deletes a shuffle's files when the driver's garbage collector finds that nothing refers
    to it; between large steps that is asked for, so a step's files don't add to the next one's.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it.

    An optimizer rule may inline an expression into each of its uses, inside lambdas too;
    a lambda's own argument is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without keeping them."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(WORD)).cast("long")


class IdRanges:
    """Ranges of about equally many ids, for placing rows in id order without a global sort.

    The driver holds at most ``most`` cut points; rows find their range by binary search.
    """

    def __init__(self, ids: DataFrame, column: str, rows_each: int, most: int = 4096):
        n = ids.count()
        m = max(1, min(most, n // rows_each))
        at = [i / m for i in range(1, m)]
        got = ids.agg(F.percentile_approx(column, at, 10 * most)).first()[0] if at else None
        self.cuts = sorted(set(got or []))
        self.empty = not n

    def place(self, i: Column) -> Column:
        """Number of the id's range: how many cut points are at or below it.  Null ids go first."""
        if not self.cuts:
            return F.lit(0)
        bounds = F.split(F.lit(",".join(map(str, self.cuts))), ",").cast("array<bigint>")  # folded to one literal
        halvings = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.cuts).bit_length()))])
        return F.aggregate(halvings, F.lit(0), lambda p, s: F.when(F.coalesce(F.get(bounds, p + s - 1) <= i, F.lit(False)), p + s).otherwise(p))
