"""Rows that every operator must take: nulls in any column, empty and very long texts, ties and
repeated rows, an empty table, and extra columns whose names operators use inside."""

from pyspark.sql import functions as F

CLASHING = ["id", "key", "bands", "rep", "score", "words", "a", "b", "token", "n", "comp", "bucket", "hash", "item_id", "gone", "own", "form", "place", "train", "row", "y",
            "spans", "n_words", "host", "path", "rule", "tokens", "docs", "op", "seq", "vec", "predicted", "class_id"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "some words of a very long text " * 8000


def clash(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


def documents(spark):
    rows = [(1, "One short text of seven words, here.", "en", "s"), (1, "One short text of seven words, here.", "en", "s"), (2, "one SHORT text of seven words here", None, None),
            (3, None, "en", "s"), (4, "", None, "s"), (5, " \n\t ", "en", None), (6, LONG, "en", "s"), (None, "no id at all but words", "en", "s"), (None, None, None, None),
            (7, "é漢😀 #!?", "fr", "t"), (8, "a", "en", "s")]
    return clash(spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS))


def no_documents(spark):
    return clash(spark.createDataFrame([], DOCS))
