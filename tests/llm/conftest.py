import pytest

from quarry.llm._io import prepare
from tests.conftest import SF_CHECK, SF_SMALL, spark  # noqa: F401

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def tables(spark):  # noqa: F811
    """Rows of a small table as the driver's checks read them."""
    prepare(spark)

    def rows(name, sf=SF_SMALL):
        return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    return rows


@pytest.fixture(scope="session")
def messy(spark):  # noqa: F811
    """Documents with nulls in every column, empty and very long texts, repeated rows and columns
    that bear the names of results."""
    prepare(spark)
    text = "Mail jo@x.example.com or call +1 (017) 555-7713 now. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" the end"
    data = [(1, text, "en", "a"), (1, text, "en", "a"), (2, "", "en", "a"), (3, None, None, None), (None, text, None, "b"),
            (4, LONG, "en", "a"), (5, LONG + " x", "de", "b"), (6, "   \n\t ", "en", "a"), (None, None, None, None),
            (7, "idiot " * 3, "en", "c"), (8, "é" * 500 + "\n" + "é" * 500, "fr", "c"), (9, "0" * 30_000, "en", "c"),
            (10, "a" * 30_000 + "@", "en", "c")]
    clash = [(*r, 1.5, 7, "s", "f", 3, "t", "k", 4, "c") for r in data]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, score double, predicted int, "
                                 "spans string, findings string, n_bytes int, t string, kept string, id int, component_id string")
