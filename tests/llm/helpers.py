"""Edge rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, fp string, score double, words array<string>, n_hit long"

EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (4, "word"),
    (5, "two words"),
    (6, "one two three"),
    (None, "a text without an id"),
    (7, "ÀÉÎ ŒUVRE straße ﬁn 汉字 тест"),
    (8, "...!!!,,,"),
    (9, "long " * 30000 + "end"),
    (10, "One Two THREE"),
    (11, "😀 emoji 😀 text password=abcdef123"),
    (12, "   wide spaces \u0085"),
]


def edge_docs(spark):
    rows = [(i, t, None if n % 3 else "en", None if n % 4 else f"src{n}", None, "x", "y", 0.5, ["z"], 3) for n, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
