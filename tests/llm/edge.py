"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, root long, id long, `k` int"
LONG = "alpha beta gamma delta epsilon " * 9000


def odd_documents(spark):
    def row(i, text, lang="en", source="s"):
        return (i, text, lang, source, 1, 0.5, 7, 8, 9, 3)

    texts = ["", None, " \n\t ", "one", "two words", LONG, "x" * 70000, "déjà vu 中文 😀", "a\x00b\x1cc", "same text here again and again", "same text here again and again"]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(3, "one"), row(None, "no id"), row(90, "no lang", None, None), row(91, None, None, "s")]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
