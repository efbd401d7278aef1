"""The subpackage's queries and their SQL oracles."""

from quillon.llm import queries_bpe, queries_fingerprints, queries_licenses, queries_line_dedup, queries_mixing, queries_near_dedup, queries_quality, queries_substring_dedup, queries_toxicity, queries_warc

_MODULES = (queries_fingerprints, queries_toxicity, queries_licenses, queries_mixing, queries_near_dedup, queries_quality, queries_substring_dedup, queries_warc, queries_bpe, queries_line_dedup)


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
