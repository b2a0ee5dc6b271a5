import datetime

import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType())


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """rows: texts, or (doc_id, text[, lang[, source]])."""
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows(spark, docs_of):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [(None, "null id text here now", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, long, "en", "a"), (4, long, "en", "a"), (5, "x" * 200_000, "en", "b"), (6, "plain words for a text of eight tokens", None, "b"), (6, "plain words for a text of eight tokens", None, "b"), (7, "😀 ünïcode tëxt 日本語 のテキスト", "de", "c")]
    from pyspark.sql import functions as F

    df = docs_of(rows)
    for name in ("id", "h", "row", "path", "rep", "label", "n", "words", "start", "component_id", "kept", "score", "spans", "_text", "host", "tail"):
        df = df.withColumn(name, F.lit(datetime.date(2020, 1, 1)))
    return df


@pytest.fixture(scope="session")
def no_rows(docs_of):
    return docs_of([])
