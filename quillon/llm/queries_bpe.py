"""op9: byte-level BPE.  SQL can't express the merges; tests hold it against the tiktoken library."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import encoded_digests
from quillon.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
