"""op6: WARC files, written and read back."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import shared_dir, table
from quillon.llm.warc import read_archive, write_archive

NAME = "op6_warc_archive"


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark)
    manifest = write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {NAME: op6_warc_archive}

SQL = {
    NAME: r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(coalesce(html, '')) AS hex FROM pages),
h AS (SELECT hex, octet_length(raw) AS n, min(page_id) AS home FROM p WHERE page_id IS NOT NULL GROUP BY ALL),
b AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY i) AS digest FROM (
    SELECT hex, i, list_reduce(list_transform(range(5), lambda k: (ascii(bin4[(5 * i + k) // 4 + 1][(5 * i + k) % 4 + 1]) - 48) * (16 >> k)), lambda x, y: x + y) AS v
    FROM (SELECT hex, unnest(range(32)) AS i,
                 list_transform(string_split(regexp_replace(hex, '(.)', '\1,', 'g')[:-2], ','),
                                lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]) AS bin4
          FROM (SELECT DISTINCT hex FROM p)))
  GROUP BY hex)
SELECT p.page_id, octet_length(raw)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN p.page_id > home THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > home THEN home END AS refers_to
FROM p JOIN b USING (hex) LEFT JOIN h ON p.hex = h.hex AND octet_length(raw) = h.n
"""
}
