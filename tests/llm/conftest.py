import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, clashing names."""
    long = " ".join(f"word{i % 997} and more{i % 613}" for i in range(20_000))
    rows = [(1, "a b c d e f g h", "s1", 1), (1, "a b c d e f g h", "s1", 1), (2, None, None, None), (3, "", "s1", 3), (None, "a b c d e f g h", "s2", 4), (None, None, None, None), (4, long, "s1", 5), (5, long + " end", "s2", 6), (6, "   \n", "s1", 7), (7, "x", "s1", 8)]
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), k, k, k, k, "z") for d, t, s, k in rows], "doc_id long, text string, lang string, source string, n_chars long, rep long, size long, band long, key long, stretch string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 0), (7, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
