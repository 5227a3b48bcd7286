import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture()
def table(spark):
    """A documents table from (doc_id, text) rows; more columns by name."""
    def make(rows, **more):
        rows = [(i, t, more.get("lang", "en"), more.get("source", "s0"), None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOCS)
    return make
