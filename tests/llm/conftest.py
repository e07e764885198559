import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text[, source]) rows."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOC_SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Columns that operators use inside or give out, as extra columns of an input.
CLASHES = ["id", "key", "ids", "decoded", "uid", "part", "size", "target", "copies", "taken", "mix_key", "score", "words", "found", "gone", "start", "end", "component_id", "kind", "of", "epochs", "cutoff", "rest", "ranges", "range", "span_of", "twice"]


@pytest.fixture
def clashes():
    return CLASHES
