import pytest
from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"
LONG_WORDS = "langer satz mit vielen worten und noch mehr davon " * 4000
LONG_RUN = "ab1" * 60000


def doc_schema(extra=()):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
              T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    return T.StructType(fields + [T.StructField(n, T.StringType()) for n in extra])


#: nulls in every column, empty, blank, very long and repeated rows, ties
ODD_ROWS = [
    (1, "The cat sat on the mat with the other cat and the dog.", "en", "src1", 5),
    (1, "The cat sat on the mat with the other cat and the dog.", "en", "src1", 5),
    (2, "The cat sat on the mat with the other cat and the dog.", "en", "src2", 5),
    (3, None, "en", "src1", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "src3", 3),
    (None, "Der Hund und die Katze sitzen auf der Matte.", "de", "src3", 1),
    (None, None, None, None, None),
    (6, LONG_WORDS, "de", "src0", 1),
    (7, LONG_RUN, "en", "src0", 1),
    (8, "1234567 ... !!", "en", "src0", 1),
    (9, "Der Hund und die Katze sitzen auf der Matte und schlafen.", "de", "srcX", 1),
    (10, "日本語のテキスト é ü ß 🎉", None, "src5", 1),
]
CLASH = ("shard", "fp", "key", "component_id", "score", "hits", "tokens", "domain", "quota", "lines", "n_hit", "size", "slot", "items",
         "_id", "_hash", "_text_hash", "_bad", "_text_key", "_p", "_kept_id", "_kept_hash", "_bad_key")


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [r + tuple(f"x{i}" for i in range(len(CLASH))) for r in ODD_ROWS]
    return spark.createDataFrame(rows, doc_schema(CLASH)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], doc_schema())
