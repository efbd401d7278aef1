"""op10: line dedup by content-defined chunks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.line_dedup import deduped

NAME = "op10_line_chunk_dedup"


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), stats=True)
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


QUERIES = {NAME: op10_line_chunk_dedup}

SQL = {
    NAME: r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents),
l AS (SELECT row_id, doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line FROM d),
h AS (
  SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS rolling, max(n) OVER (PARTITION BY row_id) AS last_n
  FROM l WINDOW w AS (PARTITION BY row_id ORDER BY n)),
e AS (
  SELECT *, n = last_n OR (n >= 2 AND n <= last_n - 2 AND rolling < lag(rolling) OVER w AND rolling <= lead(rolling) OVER w) AS is_end
  FROM h WINDOW w AS (PARTITION BY row_id ORDER BY n)),
c AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY row_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM e),
k AS (
  SELECT row_id, doc_id, chunk, count(*) AS size, string_agg(line, chr(10) ORDER BY n) AS bytes FROM c GROUP BY ALL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY row_id, bytes, size >= 2 ORDER BY chunk) AS nth,
         min(CASE WHEN size >= 2 THEN doc_id END) OVER (PARTITION BY bytes) AS home
  FROM k),
s AS (
  SELECT *, size >= 2 AND (nth > 1 OR coalesce(doc_id > home, false)) AS gone FROM o),
r AS (
  SELECT row_id, sum(size)::BIGINT AS n_lines, coalesce(sum(CASE WHEN gone THEN size END), 0)::BIGINT AS n_removed_lines,
         coalesce(string_agg(CASE WHEN NOT gone THEN bytes END, chr(10) ORDER BY chunk), '') AS kept
  FROM s GROUP BY row_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed_lines, 0) AS n_removed_lines,
       sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (row_id)
"""
}
