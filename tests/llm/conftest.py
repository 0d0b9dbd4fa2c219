import pytest
from pyspark.sql import types as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with those of the results."""
    names = ["kept", "n", "key", "score", "rank", "line", "row", "component_id", "group_size"]

    def make(rows):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
            + [T.StructField(x, T.StringType()) for x in names]
        )
        return spark.createDataFrame([(d, None, t, None if t is None else len(t), *names) for d, t in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """Deterministic invented text of so many words."""

    def make(n, seed=0):
        out, x = [], seed * 7919 + 17
        for _ in range(n):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            out.append("w" + format(x >> 44, "x"))
        return " ".join(out)

    return make
