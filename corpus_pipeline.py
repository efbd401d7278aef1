"""From raw documents to token ids, as stages that are each written and read again.

``STAGES`` are ``(name, function)``; a function takes the session, the documents its predecessor
kept and the folder of the tables.  All but the last return the columns of ``documents``:

1. toxicity: rows that score 0.5 or more go;
2. line dedup: chunks of lines that repeat leave the texts, no row goes;
3. near dedup: of each group of near copies, alike by ``NEAR_PERCENT`` of five-word shingles, the row with the smallest id stays;
4. mixing: rows are taken as often as their source's target asks, in order of virtual finish time;
5. byte-level BPE: token ids of each row, where their bytes end, and whether they decode to its text.

Null and empty texts aren't toxic, have no lines to remove and no near copies, so they stay up to
the mix, which takes no rows without words.  Null ids take no part in line and near dedup and stay.
Repeated rows stay or go together in stage 1 and 2; rows with equal ids are one document in stage 2
and 3; ties go by id.  Very long texts are handled whole, empty tables give empty ones, and extra
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from quillon.llm.common import shared_dir, stored, table
from quillon.llm.queries_bpe import RANKS
from quillon.llm.queries_toxicity import held_out

#: The model's segments and the tokenizer's merges are beyond SQL; tests use brute force.
ORACLE_SQL = None
#: Near copies go from this resemblance on.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return toxicity.clean_documents(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduped(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs, percent=NEAR_PERCENT).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    root = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), root, name)
    return STAGES[-1][1](spark, docs, sf_dir)
