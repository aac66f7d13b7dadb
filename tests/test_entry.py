import duckdb
import pytest

import __spark_entry__
from inkwell.plans import catalogue

catalogue.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {  # shared steps or many small jobs; the gate over all tables runs them
    "near_dup_pairs", "near_dup_members", "keep_first_dedupe", "components", "leakage_groups", "tfidf_nearest", "leakage_jaccard", "leakage_jaccard_documents", "greedy_word_pieces", "rule_quotas", "leakage_safe_split"}
FAST = sorted(set(catalogue.ORACLE) - SLOW)


def test_every_query_is_registered_once():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(tidy, v)) if isinstance(v, list) else v
    rows = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(tidy(r[i]) for i in at) for r in want.fetchall()), key=str)
