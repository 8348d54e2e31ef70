import pytest

from loanward.llm.common import send_package


@pytest.fixture(scope="session", autouse=True)
def sent(spark):
    send_package(spark)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""
    def build(rows, lang="en", source="s"):
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or "")) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long")
    return build


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
