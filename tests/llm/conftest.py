import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names operators use inside.
CLASHING = ("row", "id", "key", "hash", "n", "part", "at", "size", "cuts", "row_", "label")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def words(rng, n):
    return ["".join(rng.choice(("ba", "do", "ré", "ku", "li", "st")) for _ in range(rng.randrange(1, 5))) + str(rng.randrange(99)) for _ in range(n)]


def edited(rng, w, times):
    w = list(w)
    for _ in range(times):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return w


def corpus_rows():
    rng = random.Random(11)
    passage, base = words(rng, 70), words(rng, 220)
    texts = [" ".join(base), " ".join(base), " ".join(edited(rng, base, 2)), " ".join(edited(rng, base, 4)), " ".join(edited(rng, base, 60))]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 30)) for _ in range(4)] + [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(20)]
    texts += [None, None, "", "", "  \n\t", "one", "one", "a b c", "word " * 300, " ".join(words(rng, 6000)), " ".join(passage[:49]), " ".join(words(rng, 60)) + "\n\nbase\\x " + " ".join(passage[10:62])]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, texts[0]), (None, None), (10_000_000_007, "ﬁn de ligne x   y  z\r\nlast")]


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    def put(rows, files=3):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return put


@pytest.fixture(scope="session")
def corpus(write):
    return write(corpus_rows())


@pytest.fixture(scope="session")
def empty(write):
    return write([], 1)
