import duckdb
import pytest

from llm_docs import CLASHING, ODD, docs_of


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, ties, clashing columns."""
    return docs_of(spark, ODD, CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [], CLASHING)


@pytest.fixture(scope="session")
def small():
    """Documents of the smallest test set as (doc_id, text)."""
    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
