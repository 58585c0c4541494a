SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp long, h long, key string"

#: Nulls, blanks, ties, repeated rows and extra columns whose names operators use inside.
EDGES = [
    (1, None, None, None, None, 5, 6, "a"), (2, "", "en", "s", 0, None, None, None), (3, "  \n\n ", "en", "s", 4, 1, 1, ""),
    (4, "One two three four five six seven.", "en", None, 34, 1, 1, "x"), (4, "One two three four five six seven.", "en", None, 34, 1, 1, "x"),
    (5, "One two three four five six seven.", "fr", "t", 34, 2, 2, "y"), (None, "no id at all", None, None, None, None, None, None), (6, "é" * 3 + "\n" + "𝄞 " * 4, "fr", "t", 12, 0, 0, "z"),
]


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, "k") for i, t in enumerate(texts)], SCHEMA)
