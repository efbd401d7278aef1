"""Documents that any operator must take."""

ODD = [
    (1, "one two three four five six seven\neight nine ten", "en", "b", 0),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "a", 4),
    (5, "one two three four five six seven\neight nine ten", "en", None, 0),
    (5, "one two three four five six seven\neight nine ten", "en", None, 0),
    (5, "another text with the same id, of some more words than five", "en", "b", 0),
    (None, "a row without an id but with a few words of text", "en", "a", 0),
    (7, "naïve café — ünïcödé 漢字 𝔘𝔫𝔦 \u0085   end\r\n", "fr", "é", 0),
    (8, "word " * 30_000, "en", "b", 0),
    (9, "x" * 200_000, "en", "z", 0),
    (-4, "negative id", "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, parts=3):
    """With extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("id", "key", "size", "part", "digest", "bucket", "label", "rep", "n", "words", "score", "kept", "_id", "target"):
        df = df.withColumn(name, F.lit("extra"))
    return df.repartition(parts)


def docs(spark, rows, parts=3):
    """``rows`` of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0) for i, t in rows], SCHEMA).repartition(parts)
