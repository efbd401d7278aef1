"""Line dedup by content-defined line chunks.

Lines of a text are hashed; a hash rolling over ``WINDOW`` neighbouring line hashes chooses where
chunks end: a chunk ends where the rolling hash is less than before and not more than after.
Boundaries so depend on the lines around them only and survive shifts: a passage inserted
elsewhere is cut in the same places.  Two ends are never neighbours, and none is next to a text's
begin or end, so a text of two lines or more has no chunk of one.  Chunks that occur in several
documents stay in the one with the smallest id; chunks that occur again in their own document
stay at their first place.  Of a passage that stands elsewhere too, the lines up to its first end
and from its last end on may stay: they share a chunk with what is around it.

Chunks are grouped by their bytes, not by a hash alone: the groups' keys hold the digest and the
bytes, and a digest that two different byte strings share removes nothing.  After that only
digests and places travel.  Shuffled are each chunk once (equal chunks of a task are merged
before), narrow rows, and each text once to take out its lines.  A digest of many documents is
one row in the table it is joined with, so its other side may be split.  A text costs time in
proportion to its lines but for sorting its chunks.

Defined results: null doc_ids take no part, their texts stay; rows with the same doc_id are one
document, so they never remove each other's chunks; null and empty texts stay as they are; a
text of one line has no multi-line chunk; very long texts are chunked as any; other columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, shared_dir, stored

#: Lines the rolling hash sees.
WINDOW = 2


def chunks_of(text: Column) -> Column:
    """Array of ``(first int, lines int, digest string, bytes string)``: the chunks of a text in order,
    ``first`` being the number of the first line, from 0."""

    def cut(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.md5(x)), lambda h: let(F.transform(h, lambda _, i: rolling(h, i)), lambda r: let(ends(r), lambda at: pieces(lines, at))))

    def rolling(h: Column, i: Column) -> Column:
        return F.md5(F.concat(*[F.coalesce(F.get(h, i - k), F.lit("")) for k in reversed(range(WINDOW))]))

    def ends(r: Column) -> Column:
        last = F.size(r) - 1
        inside = lambda i: (i >= 1) & (i <= last - 2)
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (inside(i) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    def pieces(lines: Column, at: Column) -> Column:
        return F.transform(at, lambda e, n: piece(lines, F.coalesce(F.get(at, n - 1), F.lit(-1)) + 1, e))

    def piece(lines: Column, first: Column, end: Column) -> Column:
        return let(F.array_join(F.slice(lines, first + 1, end - first + 1), "\n"), lambda b: F.struct(first.alias("first"), (end - first + 1).alias("lines"), F.md5(b).alias("digest"), b.alias("bytes")))

    return let(F.split(text, "\n"), cut)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__q_id, __q_text, _digest, _bytes, _first, _lines, _again)``, a row for each chunk; ``_again``
    if its document has had it before.  ``__q_text`` tells apart texts of one id."""

    def marked(c: Column) -> Column:
        # neighbours in the order of digests and places
        order = F.sort_array(F.transform(c, lambda x: F.struct(x["digest"].alias("digest"), x["first"].alias("first"), x["lines"].alias("lines"), x["bytes"].alias("bytes"))))
        return let(order, lambda o: let(F.md5(F.col(text_col)), lambda key: F.transform(o, lambda x, n: told(x, F.get(o, n - 1), key))))

    def told(x: Column, before: Column, key: Column) -> Column:
        again = F.coalesce(before["digest"] == x["digest"], F.lit(False))
        return F.struct(key.alias("text"), *[x[c].alias(c) for c in ("digest", "bytes", "first", "lines")], again.alias("again"))

    # a chunk needs a line end, so texts without one aren't cut
    rows = docs.where(F.col(id_col).isNotNull() & F.contains(F.col(text_col), F.lit("\n")))
    # the text's digest is in the array: beside it, it would be taken again for each chunk
    found = rows.select(F.col(id_col).alias("__q_id"), F.explode(let(chunks_of(F.col(text_col)), marked)).alias("_c"))
    return found.select("__q_id", F.col("_c.text").alias("__q_text"), *[F.col(f"_c.{x}").alias(f"_{x}") for x in ("digest", "bytes", "first", "lines", "again")])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_digest, _home)``: chunks of several documents and the smallest id that has each."""
    by_bytes = _numbered(docs, id_col, text_col).where(~F.col("_again")).groupBy("_digest", "_bytes").agg(F.min("__q_id").alias("_home"), F.max("__q_id").alias("_far"))
    by_digest = by_bytes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_home").alias("_home"), F.max("_far").alias("_far"))
    return by_digest.where((F.col("_n") == 1) & (F.col("_far") > F.col("_home"))).select("_digest", "_home")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text_col``, a row for each row.

    With ``stats``, adds ``n_lines`` and ``n_removed_lines`` (of the same names a table has
    already, these replace).
    """
    spark = docs.sparkSession
    # written: a join with the plain table can split a digest of many rows, one with an aggregate can't
    homes = stored(repeated_chunks(docs, id_col, text_col), shared_dir(spark), "repeated")
    chunks = _numbered(docs, id_col, text_col).select("__q_id", "__q_text", "_digest", "_first", "_lines", "_again")
    elsewhere = chunks.where(~F.col("_again")).join(homes, "_digest").where(F.col("__q_id") > F.col("_home"))
    place = ("__q_id", "__q_text", "_first", "_lines")
    gone = elsewhere.select(*place).union(chunks.where("_again").select(*place)).groupBy("__q_id", "__q_text").agg(F.sort_array(F.collect_set(F.struct("_first", "_lines"))).alias("__q_gone"))  # of one document's chunks
    joined = docs.withColumn("__q_md5", F.md5(F.col(text_col))).join(gone, (F.col(id_col) == F.col("__q_id")) & (F.col("__q_md5") == F.col("__q_text")), "left")

    def rest(lines: Column) -> Column:
        """The lines between the chunks that go."""
        whole = F.struct(F.size(lines).alias("_first"), F.lit(0).alias("_lines"))
        stops = F.concat(F.col("__q_gone"), F.array(whole))

        def between(stop: Column, n: Column) -> Column:
            before = F.get(F.col("__q_gone"), n - 1)
            begin = F.coalesce(before["_first"] + before["_lines"], F.lit(0))
            return F.slice(lines, begin + 1, stop["_first"] - begin)

        return F.flatten(F.transform(stops, between))

    out = joined.withColumn("__q_kept", F.when(F.col("__q_gone").isNotNull(), let(F.split(F.col(text_col), "\n"), rest)))
    if stats:
        removed = F.aggregate("__q_gone", F.lit(0), lambda n, x: n + x["_lines"])
        out = out.withColumn("n_lines", F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long")).withColumn("n_removed_lines", F.coalesce(removed, F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__q_kept").isNotNull(), F.array_join("__q_kept", "\n")).otherwise(F.col(text_col))).drop("__q_id", "__q_text", "__q_md5", "__q_gone", "__q_kept")
