import pytest

from placeweave.llm.queries import tokenizer_path


@pytest.fixture(scope="session")
def docs(spark):
    """A table with the standard columns from (id, text) or (id, text, source) rows, plus columns named like results."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", -1, "mine", 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "kept string, size int")
    return build


@pytest.fixture(scope="session")
def tokenizer_file():
    return tokenizer_path()


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
