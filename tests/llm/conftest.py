import random

import pytest
from pyspark.sql import types as T

from __spark_entry__ import queries

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
SYLLABLES = {"aa": ["ka", "lo", "mi", "ter", "nus"], "bb": ["sch", "üb", "ein", "ung", "pfa"]}


def sentence(rng, lang, words=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)) + "."


def corpus():
    """Two languages with copies, near copies, and every odd case."""
    rng = random.Random(5)
    rows = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        rows.append([i, "\n".join(sentence(rng, lang, rng.randint(6, 14)) for _ in range(rng.randint(2, 9))), lang, "s", 0])
    for i in range(8):
        rows.append([100 + i, rows[i][1], "aa", "s", 0])  # copies
        rows.append([120 + i, rows[i][1] + " tail of it", None, "s", 0])  # near copies
    rows += [
        [200, None, "aa", "s", 0], [201, "", "bb", "s", 0], [202, " \n\t ", None, "s", 0], [203, "12 ! 34", "aa", None, 0],
        [204, "one", "aa", "s", 0], [205, "one", "aa", "s", 0], [206, "ka lo mi", "aa", "s", 0],
        [207, sentence(rng, "aa", 9000), "aa", "s", 0], [208, "x" * 30_000, None, "s", 0], [209, "日本語 \u0301e 😀", None, "s", 0],
        [0, rows[0][1], "bb", "s", 0], [None, "ka lo no id mi ter", "aa", "s", 0],
    ]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows with further columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("id", "row", "score", "key", "bucket", "token", "part", "n", "m", "node", "length", "piece", "block", "words", "_text", "_key", "_digest", "digest", "least", "component_id"):
        out = out.withColumn(name, F.lit("other"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder of tables for the registered queries."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = docs.filter("doc_id < 100").selectExpr("doc_id", "cast(1 as int) quality", "cast(doc_id % 10 = 0 as int) toxic").distinct()
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def apply(spark, folder):
    return lambda name: queries()[name](spark, folder).collect()
