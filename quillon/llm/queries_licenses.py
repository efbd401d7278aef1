"""op3: licence scans by sentence rules."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.licenses import TRIGGERS, known_sentences, rules, scanned

NAME = "op3_license_scan"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    word = " OR ".join(f"contains(lower(text), '{t}')" for t in TRIGGERS)

    def view(name: str, text: str) -> str:
        return rf"""
{name} AS (
  SELECT row_id, list(i ORDER BY n) AS ids FROM (
    SELECT row_id, n, k.i FROM (
      SELECT row_id, generate_subscripts(s, 1) AS n, unnest(s) AS sent FROM (
        SELECT row_id, string_split(regexp_replace({text}, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM d WHERE hit))
    JOIN known k ON k.s = lower(trim(regexp_replace(sent, '[^A-Za-z0-9]+', ' ', 'g'))))
  GROUP BY row_id)"""

    steps, last = [], "m0"
    for n, (licence, run) in enumerate(rules(), 1):
        steps.append(
            f"m{n} AS (SELECT row_id, doc_id, ids, replace(left_ids, '{run}', ';') AS left_ids, "
            f"CASE WHEN contains(left_ids, '{run}') AND NOT list_contains(got, '{licence}') THEN list_append(got, '{licence}') ELSE got END AS got FROM {last})"
        )
        last = f"m{n}"
    return f"""
WITH known(s, i) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, text, ({word}) AS hit FROM documents),
{view("a", "text").strip()},
{view("b", "replace(text, chr(10), ' ')").strip()},
f AS (
  SELECT d.row_id, d.doc_id, CASE WHEN len(coalesce(b.ids, [])) > len(coalesce(a.ids, [])) THEN b.ids ELSE coalesce(a.ids, []) END AS ids
  FROM d LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id)),
m0 AS (SELECT row_id, doc_id, ids, ';' || array_to_string(ids, ';') || ';' AS left_ids, CAST([] AS VARCHAR[]) AS got FROM f),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ';') AS sentence_ids,
       array_to_string(got, ',') AS licenses,
       array_to_string(list_filter(string_split(left_ids, ';'), lambda x: x <> ''), ';') AS unexplained
FROM {last}
"""


QUERIES = {NAME: op3_license_scan}
SQL = {NAME: _sql()}
