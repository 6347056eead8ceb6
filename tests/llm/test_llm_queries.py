"""The registered text queries against their SQL twins and the pipeline against brute force, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from emberline.llm import labelled, oracles, queries, toxicity

from .test_llm_operators import brute_components, brute_matches

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = oracle.sql(f"select {', '.join(columns)} from ({oracles.oracle_sql()[name]}) t").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql()) - {"op12_spelling"}))
def test_query_has_a_row_per_document(spark, oracle, name):
    ids = [r["doc_id"] for r in contract.queries()[name](spark, SF).collect()]
    assert sorted(ids) == [i for (i,) in oracle.sql("select doc_id from documents order by doc_id").fetchall()]


def test_pipeline_equals_its_stages_by_brute_force(spark, oracle):
    docs = {i: t for i, t in oracle.sql("select doc_id, text from documents").fetchall()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"), labelled.held_out(5, 0))
    clean = sorted(r["doc_id"] for r in toxicity.classify(table, model).filter("predicted = 0").collect())
    left = [(i, docs[i]) for i in clean]
    firsts = {c if n else i for i, n, c in brute_components(left)}
    items = oracle.sql("select item_id, text from benchmark").fetchall()
    expected = []
    for i in sorted(firsts):
        n_words, n_hit, _ = brute_matches(docs[i], items)
        if not (n_hit and 20 * n_hit >= n_words):
            expected.append(i)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == expected
