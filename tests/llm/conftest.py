import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text[, source]) rows."""
    def of(rows, start=0):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows, start)]
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977} the" for i in range(40_000)) + "\n" + "x" * 300_000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a text without an id"), (None, None), (5, long, None), (6, "same text of a row"),
        (6, "same text of a row"), (6, "other text of the id"), (7, "same text of a row"), (8, "é ü 中文 😀 the end", None), (9, "aa " * 2_000),
    ]
    frame = make(rows).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang")))
    names = ["shard", "slot", "size", "rows", "copies", "target", "label", "key", "h", "block", "fp", "component_id", "spots", "count", "_rid", "_fp", "_null", "_id", "_h", "_n", "_row", "_starts", "_ends", "_h0", "_size0", "_copies", "_rows", "_at", "_copy",
             "quality", "good_odds", "kind", "at", "rank", "start", "path", "n_words", "items", "word", "c", "rid"]
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(make):
    return make([]).limit(0)
