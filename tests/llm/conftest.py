import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()),
                    # names that the operators use inside
                    T.StructField("component_id", T.StringType()), T.StructField("kept", T.StringType()),
                    T.StructField("n_tokens", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text, lang, source)``, with extra columns of clashing names."""
    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "x", "y", "z") for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOC)
    return make


WORDS = ("the of and to in river stone lantern orchard window copper meadow harbor signal thread velvet marble engine willow "
         "carbon summit island saddle mirror basket candle hammer pepper ribbon silver tunnel violet walnut yellow zephyr").split()


@pytest.fixture(scope="session")
def sentence():
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def odd_rows(sentence):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = "\n".join(sentence(900 + i, 40) for i in range(120))
    return [(1, sentence(1, 80), "en", "src1"), (2, None, "en", "src2"), (3, "", None, None), (4, " \t\n ", "de", "src0"),
            (5, sentence(1, 80), "en", "src1"), (6, sentence(1, 80), "en", "src1"), (6, sentence(1, 80), "en", "src1"),
            (7, long, None, "src3"), (None, sentence(2, 60), "en", "src1"), (8, "one two", "fr", None), (9, "x" * 5000, "en", "src4")]
