import pytest

from pagesieve.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small documents table."""
    return [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
