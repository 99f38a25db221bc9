import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows, schema=SCHEMA):
        full = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, blank, tiny, long, repeated and unnamed rows, with extra columns whose names clash."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 997} of{i % 13}" for i in range(20_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\r\n", "en", None), (4, "one", None, None),
        (5, "Same Text here é 漢 ▁ x", "fr", "b"), (5, "Same Text here é 漢 ▁ x", "fr", "b"), (6, "Same Text here é 漢 ▁ x", "fr", "b"),
        (7, long, "en", "a"), (None, "no id at all", "en", "a"), (8, "!!!! 1234 ----", "en", "a"), (9, "a" * 5000, "de", "c"),
    ]
    names = (
        "score", "kept", "node", "bucket", "label", "ranges", "sketch", "cell", "distance", "predicted", "component_id",
        "lang_pred", "cold", "_row", "_id", "spans", "sample", "n_words",
    )
    return make(rows).withColumns({n: F.lit("extra") for n in names})


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
