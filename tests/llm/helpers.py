"""Small inputs shared by the tests of the training-data operators."""

EMPTY = "doc_id long, text string, lang string"
LONG = "wort " * 30_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, None, "en"), (3, "", None), (None, "no id here at all, only some words", "de"),
    (4, " \t\n ", "fr"), (5, LONG, "de"),
    (6, "a b c d e f g h i j a b c d e f g h i j", "en"), (6, "a b c d e f g h i j a b c d e f g h i j", "en"),
    (7, "same line\nsame line\n\nother\nsame line", None), (8, "Ünïcödé ñandú 日本語 ☃ #*$%", "es"),
]


def docs(spark, rows=None, schema=EMPTY):
    return spark.createDataFrame(ROWS if rows is None else rows, schema)


def clashing(df, *names):
    """The table with an extra column of each of these names."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit("old"))
    return df
