"""Mutation logs: replay, snapshots, durable prefixes, segments, compaction, supersession, quorum.

A log is ``(lsn, op, id, vec)`` with ``op`` ``put`` or ``del``.  Replay is per id, last writer
wins, so the order of rows never matters.  Nothing here uses a window over a whole log: what
would is done in two steps, over blocks and inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.schema import DELETE, PUT

#: Log records in a block of two-step operators.
BLOCK = 4096


def after(log: DataFrame, watermark: int) -> DataFrame:
    """The suffix of a log that a snapshot at ``watermark`` doesn't cover."""
    return log.where(F.col("lsn") > watermark)


def upto(log: DataFrame, lsn: int) -> DataFrame:
    """The prefix of a log: what a read at ``lsn`` sees."""
    return log.where(F.col("lsn") <= lsn)


def last_writes(log: DataFrame) -> DataFrame:
    """The last record of each id.  Tasks reduce what they read first, so hot ids don't pile up."""
    last = F.max_by(F.struct("lsn", "op", "vec"), "lsn")
    return log.where(F.col("op").isNotNull()).groupBy("id").agg(last.alias("w")).select("w.lsn", "w.op", "id", "w.vec")


def replay(log: DataFrame, snapshot: DataFrame | None = None, watermark: int = 0) -> DataFrame:
    """Live vectors ``(id, vec, lsn)`` of a snapshot at ``watermark`` and the log's suffix."""
    suffix = after(log, watermark).select("lsn", "op", "id", "vec") if snapshot is not None else log.select("lsn", "op", "id", "vec")
    if snapshot is not None:
        base = snapshot.select(F.lit(watermark).cast("long").alias("lsn"), F.lit(PUT).alias("op"), "id", "vec")
        suffix = suffix.unionByName(base)
    return last_writes(suffix).where(F.col("op") == PUT).select("id", "vec", "lsn")


def counts(log: DataFrame, watermark: int) -> DataFrame:
    """``(replayed, covered, max_lsn, puts, deletes)`` of a log and a watermark."""
    one = F.lit(1)
    return log.agg(
        F.count(F.when(F.col("lsn") > watermark, one)).alias("replayed"),
        F.count(F.when(F.col("lsn") <= watermark, one)).alias("covered"),
        F.max("lsn").alias("max_lsn"),
        F.count(F.when(F.col("op") == PUT, one)).alias("puts"),
        F.count(F.when(F.col("op") == DELETE, one)).alias("deletes"),
    )


def durable_prefix(records: DataFrame) -> DataFrame:
    """Records before the first bad one in (segment, offset) order: the rest was torn."""
    bad = records.where("is_bad").agg(F.min(F.struct("seg", "off")).alias("_bad"))  # one row
    return records.join(F.broadcast(bad), F.col("_bad").isNull() | (F.struct("seg", "off") < F.col("_bad"))).drop("_bad")


def corrupt_segments(records: DataFrame) -> DataFrame:
    """``seg`` of segments with a bad record that aren't the last: there it is damage, not a torn tail."""
    last = records.agg(F.max("seg").alias("_last"))  # one row
    return records.where("is_bad").select("seg").distinct().join(F.broadcast(last), F.col("seg") < F.col("_last")).select("seg")


def from_members(messages: DataFrame, members: DataFrame, sender: str = "sender", member: str = "id") -> DataFrame:
    """Messages of senders that the configuration lists; a null sender is nobody's."""
    listed = members.select(F.col(member).alias("_member")).distinct()
    return messages.join(listed, F.col(sender) == F.col("_member"), "left_semi")


def truncatable_segments(log: DataFrame, watermark: int) -> DataFrame:
    """``(seg, max_lsn)`` of segments that a snapshot covers; never the last one, which is in use."""
    segments = log.groupBy("seg").agg(F.max("lsn").alias("max_lsn"))
    active = segments.agg(F.max("seg").alias("_active"))
    return segments.join(F.broadcast(active), F.col("seg") < F.col("_active")).where(F.col("max_lsn") <= watermark).drop("_active")


def should_compact(replayed: Column, snapshotted: Column, factor: float = 0.5, floor: int = 1000) -> Column:
    """Whether so long a replay warrants a new snapshot."""
    return (replayed >= floor) | ((snapshotted > 0) & (replayed > factor * snapshotted))


def surviving(records: DataFrame, pos: str = "pos", idx: str = "idx") -> DataFrame:
    """The logical log of an append log whose indexes are sometimes rewound: a record stands unless
    a later one has an index at or below its own.

    The least later index is taken over blocks of positions, then inside the record's block.
    """
    block = F.floor(F.col(pos) / BLOCK)
    blocks = records.groupBy(block.alias("_block")).agg(F.min(idx).alias("_m"))
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)  # a row a block
    blocks = blocks.select("_block", F.min("_m").over(later).alias("_after"))
    inside = Window.partitionBy("_block").orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    placed = records.withColumn("_block", block).withColumn("_next", F.min(idx).over(inside)).join(blocks, "_block")
    lowest = F.least(F.col("_next"), F.col("_after"))  # least() skips nulls
    return placed.where(lowest.isNull() | (lowest > F.col(idx))).drop("_block", "_next", "_after")


def index_gaps(records: DataFrame, pos: str = "pos", idx: str = "idx") -> DataFrame:
    """Records whose index jumps ahead of the one before by more than 1: a hole in the log."""
    block = F.floor(F.col(pos) / BLOCK)
    ends = records.groupBy(block.alias("_block")).agg(F.max_by(idx, pos).alias("_last"))
    before = Window.orderBy("_block")
    ends = ends.select("_block", F.lag("_last").over(before).alias("_carry"))
    inside = Window.partitionBy("_block").orderBy(pos)
    placed = records.withColumn("_block", block).withColumn("_lag", F.lag(idx).over(inside)).join(ends, "_block")
    last = F.coalesce("_lag", "_carry")
    return placed.where(F.col(idx) > last + 1).drop("_block", "_lag", "_carry")


def quorum(n: int) -> int:
    return n // 2 + 1


def commit_index(matches: DataFrame, terms: DataFrame, current_term: int) -> DataFrame:
    """``(group_id, commit)``: the highest index a quorum has, if its term is the current one.

    ``matches`` has a row ``(group_id, node, match)`` a member, ``terms`` the term of each index.
    """
    held = F.sort_array(F.collect_list("match"), asc=False)  # of one group's members
    found = matches.groupBy("group_id").agg(F.element_at(held, F.floor(F.count(F.lit(1)) / 2).cast("int") + 1).alias("idx"))
    return found.join(terms, "idx").where(F.col("term") == current_term).select("group_id", F.col("idx").alias("commit"))


def with_ordinal(rows: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Numbers rows from 1 in the order of a number column: offsets of blocks, then inside them."""
    block = F.floor(F.col(key) / BLOCK)
    sizes = rows.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(key)
    return rows.withColumn("_block", block).withColumn(name, F.row_number().over(inside)).join(sizes, "_block").withColumn(name, F.col(name) + F.col("_offset")).drop("_block", "_offset")
