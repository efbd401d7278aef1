"""op4: mixing sources to target weights."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.mixing import mixed

NAME = "op4_mix_sources"


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {NAME: op4_mix_sources}

SQL = {
    NAME: r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS place
  FROM d GROUP BY source),
s AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM s0),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
f AS (SELECT *, cap <= level * weight AS is_full FROM l),
t AS (
  SELECT source, place, source_size,
         CASE WHEN is_full THEN cap
              ELSE weight * (SELECT arg_min(level, cap / weight * 1e6 + place) FROM f WHERE NOT is_full) END AS target
  FROM f),
c AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begin_at
  FROM d),
q AS (
  SELECT row_id, place, target, least(64, size - 64 * k) AS words, begin_at + turn * source_size + 64 * k AS begin_at
  FROM (SELECT c.*, t.place, t.target, t.source_size, turn, unnest(range(0, (size + 63) // 64)) AS k
        FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source, range(0, 3) AS e(turn) WHERE size > 0 AND t.target > 0)),
o AS (
  SELECT row_id, words, sum(words) OVER (ORDER BY (begin_at + words) / target, place ROWS UNBOUNDED PRECEDING) AS reached FROM q),
g AS (
  SELECT row_id, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - (reached - words)))) AS taken FROM o GROUP BY row_id)
SELECT c.doc_id, c.size, t.source_size, t.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (row_id)
"""
}
