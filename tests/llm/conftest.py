import pytest


@pytest.fixture
def docs_of(spark):
    """documents from texts, with ids from 0; a column of a clashing name besides."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", f"src{n % 3}", None if t is None else len(t), "x") for n, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


@pytest.fixture
def write_tables(tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
