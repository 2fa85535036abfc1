import importlib
import os

import duckdb

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ("canonical_entity", "canonical_predicate", "normalized_period", "normalized_unit_value", "page_score_total", "grounded_facts", "fact_fingerprint", "unique_predicted_pairs", "relationship_scores", "token_classification")


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_entry_and_names():
    importlib.reload(__spark_entry__)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_like_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in CHEAP:
        assert rows_of(known[name](spark, sf_dir).toPandas()) == rows_of(con.execute(sql[name]).df()), name
