import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with a column whose name clashes with many outputs."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + [None] * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS).withColumns({"score": F.lit("x"), "fp": F.lit("y"), "n_words": F.lit("z"), "_text": F.lit("t"), "ranges": F.lit("r")})

    return make


ODD = [(1, ""), (2, None), (None, "a b c"), (None, None), (3, " \n\t "), (4, "word " * 30000), (5, "same words here"), (5, "same words here"), (6, "\n\n"), (7, "é ñ 中文 😀"), (5, "other words here")]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, repeated rows, one id with two texts."""
    return ODD
