import pytest

from larder.session import ship_package

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, fp long"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 9.0, 5, False, 3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, an added token, white space runs."""
    long = " ".join(f"word{i % 997} the" for i in range(40_000))
    return [
        row(1, "one two three four five six"), row(2, "one  two\nthree four five six"), row(3, "one two three four five six"), row(3, "one two three four five six"),
        row(None, None, None, None), row(None, None, None, None), row(5, ""), row(6, " \t\n"), row(7, None), row(8, long), row(9, long + " tail"), row(10, "<|endoftext|> x"),
        row(11, "12 34 ... !!", "de", "b"), row(12, "ein Satz über die Länge", "de", "b"), row(13, "ein Satz über die Länge", None, None), row(None, "orphan text here", "fr", "\U0001f600"),
        row(15, "   leading and trailing  ", "fr", "c"), row(16, "a" * 3000, "en", "c")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    ship_package(spark)
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    ship_package(spark)
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    ship_package(spark)
    return "/root/testdata/sf0.001"


