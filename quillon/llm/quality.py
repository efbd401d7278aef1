"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of words are hashed into ``BUCKETS`` features.  Two multinomials over the
features are counted, of the trusted documents and of all documents; a document's score is the
mean over its n-grams of log(target probability / raw probability), so length cancels out.  A
document is kept if its score is at least ``THRESHOLD``: the same document always gets the same
verdict, there is no random draw.  The target is smoothed by the raw distribution with as much
weight as the trusted documents have themselves (``PRIOR``), so features the trusted documents
happen to lack cost at most log(1/2) each and small corpora behave as large ones.

Raw counts are over all documents.  Trusted documents are at most ``TRUSTED_DOCS`` rows labelled
as good, those with the least digest of their id: a set that doesn't depend on row order.

Everything is DataFrame functions.  What leaves the executors is one count per bucket.

Defined results: a null, empty or blank text has no words, all counts 0, fails the base rules
and has score 0; a repeated row is scored again; an empty table gives an empty result; a text of
any length is scored whole.  Words are compared by code point, as they are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, words_of

BUCKETS = 10_000
#: Weight of the raw distribution in the target's, against the trusted n-grams' own.
PRIOR = 1.0
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.025
#: Bound of the sample of trusted documents.
TRUSTED_DOCS = 20_000
#: Words a document needs.
MIN_WORDS = 50

SYMBOLS = r"[#*$%&|<>]"


def _shift(name: str, x: Column, n: Column) -> Column:
    return F.call_function(name, x, n)


def feature_ids(words: Column) -> Column:
    """Bucket of each word, then of each pair of neighbours.  ``words`` must be cheap to use twice."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(BUCKETS)).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def feature_counts(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Occurrences of each bucket over all of ``docs``: partial sums meet once per bucket and task."""
    ids = let(words_of(F.col(text_col)), feature_ids)
    rows = docs.select(F.explode(ids).alias("b")).groupBy("b").count().collect()  # BUCKETS rows at most
    out = [0] * BUCKETS
    for b, n in rows:
        out[b] = n
    return out


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of at most ``limit`` documents labelled good."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)


def log_ratios(target: list[int], raw: list[int]) -> list[float]:
    """log(target / raw probability) of each bucket."""
    n_raw, n_target = sum(raw), sum(target)
    if not n_raw or not n_target:
        return [0.0] * len(raw)
    base = [(r + 1) / (n_raw + len(raw)) for r in raw]
    prior = PRIOR * n_target
    return [round(math.log((t + prior * p) / (n_target + prior) / p), 6) for t, p in zip(target, base, strict=True)]


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratios of a corpus and its labels."""
    # at most TRUSTED_DOCS ids of 8 bytes, so the broadcast is bounded
    ids = F.broadcast(trusted_ids(labels).withColumnRenamed("doc_id", "_id"))
    texts = docs.select("doc_id", "text")
    target = feature_counts(texts.join(ids, F.col("doc_id") == F.col("_id"), "left_semi"))
    return log_ratios(target, feature_counts(texts))


def score_of(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a document's n-grams."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # constant, so folded to one literal
    total = F.aggregate(feature_ids(words), F.lit(0.0), lambda s, b: s + F.get(table, b))
    n = 2 * F.size(words) - 1
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, first one included.

    Window hashes are sorted with their positions packed into the low bits, so equal windows are
    neighbours; neighbours count as equal if their words are.  Linear but for the sort, whatever
    a text repeats.
    """
    n = F.size(words)

    def same(a: Column, b: Column) -> Column:
        return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

    def of_bits(bits: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def packed(i: Column) -> Column:
            h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            return _shift("shiftleft", _shift("shiftrightunsigned", h, bits + 1), bits).bitwiseOR(i.cast("long"))

        def of_sorted(p: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                y = F.get(p, j)
                equal = _shift("shiftrightunsigned", x, bits) == _shift("shiftrightunsigned", y, bits)
                return F.when(equal, same(place(x), place(y))).otherwise(F.lit(False))

            found = F.filter(p, lambda x, j: twin(x, j - 1) | twin(x, j + 1))
            return let(F.sort_array(F.transform(found, place)), covered)

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), packed)), of_sorted)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x).cast("long")

    return F.when(n >= 4, let(F.length(F.bin(n.cast("long"))), of_bits)).otherwise(F.lit(0).cast("long"))


def base_counts(words: Column, text: Column) -> Column:
    """Struct of the plain counts of a text whose words are given."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        n_repeat_words(words).alias("n_repeat_words"),
    )


def judged(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with its counts, score and verdict.  Map only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = let(words_of(F.col(text_col)), lambda w: F.struct(base_counts(w, text).alias("c"), score_of(w, ratios).alias("score")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        docs.select(F.col(id_col).alias("doc_id"), row.alias("r"))
        .select("doc_id", "r.c.*", "r.score")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("score") >= threshold))
    )
