import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


ODD_TEXTS = [None, "", "   \n\t ", "word", "a b c d e f g h i j k l m", "x" * 30_000, "same words here in this line\n" * 40, "1234 5678", "日本語 テキスト"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src", len(t or ""), "slot", True) for i, t in enumerate(ODD_TEXTS)]
    rows += rows[:5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
