"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (by a digest of the document's
id); a source whose target exceeds its size is queued again, at most ``MAX_EPOCHS`` times in
all.  Documents are served in quanta of at most ``QUANTUM`` words, so a very long one doesn't
hold its source up.  A quantum's virtual finish time is the source's cumulative words, this
quantum included, divided by the source's target.  All quanta of all sources are sorted by that
time, and the mix is cut where the words served reach the total budget, the words of all
documents; the quantum in service there gives its part.  What a document is taken for are its
quanta before the cut.  At the cut each source is within a quantum of its target, but for what
the others' quanta in service leave over, which the next in order get.

The order is global, but no task holds it.  Sums run in steps: over digest ranges of a source,
then inside each range; and for the order of service over ranges of virtual time, over which
fair queueing spreads words evenly: wide ranges, the ranges in each, then the quanta inside a
range.  A hot source only has more quanta in each range.

Quanta that begin more words beyond their source's target than all sources together have quanta
can't be reached, and aren't made: by time 1 the words finished lack less than a quantum a
source to the budget.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
sources without words get target 0; a repeated row is a document of its own, and rows that tie
in digest, id and size are alike, so it doesn't matter which comes first; a very long text is
one row of many quanta; columns of any name pass by, those of the result aren't mixed up with
them; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import n_words_of

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Times a document can be taken.
MAX_EPOCHS = 3
#: Words served at once.
QUANTUM = 64
#: Words in a range of virtual time, and ranges in a wide one.
RANGE_WORDS, WIDE = 1 << 16, 4096
#: Hexadecimal digits of the digest that make a range: 16**3 ranges a source, so a range holds
#: a few million rows of a source with 1e10.
RANGE_DIGITS = 3


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: shares of the total by weight, none above
    ``max_epochs`` times its source's size, the excess shared again by weight.

    In order of size over weight, sources are full up to some place and share what is left
    from there on; a source is full exactly if its cap is at most its share of what the full
    ones before it leave.  One row a source: the windows here are over the table of sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    # orders strings by code point, as UTF-8 bytes compare
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = (
        sources.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
        .withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("shared", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("shared") * F.col("weight"))
    return found.select("source", "source_size", "place", "weight", target.alias("target"), F.sum("source_size").over(every).alias("budget"), F.count(F.lit(1)).over(every).alias("sources"))


def served(placed: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(place, served)``: words of each source before the cut, from all quanta in order of virtual finish time."""
    quanta = F.ceil(F.col("size") / QUANTUM)
    begin = F.col("begin") + F.floor(F.col("_i") / quanta) * F.col("source_size") + F.col("_i") % quanta * QUANTUM
    words = F.least(F.lit(QUANTUM), F.col("size") - F.col("_i") % quanta * QUANTUM)
    reach = F.col("target") + F.col("sources") * QUANTUM
    each = (
        placed.where("size > 0 AND target > 0")
        .where(F.col("begin") < reach)
        .select("place", "begin", "size", "source_size", "target", "budget", "sources", F.explode(F.sequence(F.lit(0).cast("long"), quanta * max_epochs - 1)).alias("_i"))
        .select("place", "target", "budget", reach.alias("reach"), begin.alias("begin"), words.alias("words"))
        .where(F.col("begin") < F.col("reach"))
        .select("place", "budget", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
        .withColumn("range", F.floor(F.col("finish") * F.greatest(F.lit(1), F.floor(F.col("budget") / RANGE_WORDS))))
    )
    ranges = each.groupBy("range").agg(F.sum("words").alias("w")).withColumn("wide", F.floor(F.col("range") / WIDE))
    wide = ranges.groupBy("wide").agg(F.sum("w").alias("w"))
    earlier = Window.orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)  # a row for WIDE ranges
    wide = wide.select("wide", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_wide"))
    in_wide = Window.partitionBy("wide").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_ranges", F.coalesce(F.sum("w").over(in_wide), F.lit(0))).join(wide, "wide").select("range", (F.col("_wide") + F.col("_ranges")).alias("_before"))
    in_range = Window.partitionBy("range").orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = each.withColumn("_inside", F.sum("words").over(in_range)).join(ranges, "range")
    left = F.col("budget") - (F.col("_before") + F.col("_inside") - F.col("words"))
    return ordered.groupBy("place").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left))).alias("served"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, taken, finish`` and
    the columns ``keep``.  ``finish`` is the virtual finish time of the first turn.

    Shuffles carry a few numbers a document, and what is named in ``keep``.
    """
    extra = [F.col(c).alias(f"_keep_{c}") for c in keep or []]
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words_of(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("digest"),
        *extra,
    ).withColumn("part", F.substring("digest", 1, RANGE_DIGITS))
    ranges = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sources = water_fill(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    offsets = ranges.withColumn("before", F.coalesce(F.sum("part_size").over(in_source), F.lit(0)))
    # one row a source and range, of 16 ** RANGE_DIGITS ranges at most: joined on both
    offsets = offsets.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("part").alias("_p"), "before", "source_size", "target", "place", "budget", "sources"
    )
    in_range = Window.partitionBy("source", "part").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("inside", F.sum("size").over(in_range)).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    placed = placed.withColumn("begin", F.col("before") + F.col("inside") - F.col("size"))
    cut = served(placed, max_epochs).withColumnRenamed("place", "_place")
    found = placed.join(cut, F.col("place") == F.col("_place"), "left")  # a row a source

    def turn(epoch: int) -> Column:
        """Words of that turn before the cut: a source's quanta are served in the order of its queue."""
        left = F.coalesce("served", F.lit(0)) - F.lit(epoch) * F.col("source_size") - F.col("begin")
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))

    return found.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        reduce(add, map(turn, range(max_epochs))).alias("taken"),
        F.when(F.col("target") > 0, (F.col("begin") + F.col("size")) / F.col("target")).alias("finish"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep or []],
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, in order of virtual finish time.

    Rows are whole: one in service at the cut is taken if at least half of it had been served.
    Every turn but the last is served whole, so that is the same as rounding.

    Only numbers are mixed; texts meet their turns by a digest of the whole row afterwards.  Rows
    equal in all columns are told apart by counting.
    """
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{n}") for n, c in enumerate(names)], F.col("doc_id").alias("doc"), F.col("text").alias("body"), F.col("source").alias("origin"))
    row = F.md5(F.to_json(F.struct(*[F.col(f"c{n}") for n in range(len(names))]), {"ignoreNullFields": "false"}))
    keyed = plain.withColumn("row", row)
    rows = mixed(keyed, weights, max_epochs, keep=["row"], id_col="doc", text_col="body", source_col="origin")
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    turns = F.when((F.col("size") > 0) & (times > 0), F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    at = F.transform(turns, lambda t: F.col("finish") + t * F.col("source_size") / F.col("target"))
    # equal rows take all their turns in the first of them: MAX_EPOCHS times their number
    chosen = rows.where(F.size(turns) > 0).groupBy("row").agg(F.flatten(F.collect_list(at)).alias("at")).select(F.col("row").alias("_r"), "at")
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("row").orderBy(F.lit(1)))).where("_nth = 1")
    out = first.join(chosen, F.col("row") == F.col("_r")).withColumn("_at", F.explode("at"))
    return out.orderBy("_at", "doc", "row").select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(names)])
