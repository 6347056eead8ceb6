"""Columns of the input that are named like results or like what an operator works with come back as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import decontaminate, jaccard, secrets
from emberline.llm.staging import freeing_shuffles, set_aside, unused

NAMES = ["_id", "_key", "_blank", "_text_key", "_row", "_lot", "_hits", "_items", "_longest", "_n_words", "n_words", "n_hit", "item_ids", "score", "Predicted", "spans", "node", "comp"]


@pytest.fixture
def docs(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    texts = [passage, passage + " more", "token = Abcdef1234567890x in a file of its own", "", None, passage]
    rows = [(i, text, "en", "web", len(text or "")) for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.withColumns({name: F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")) for name in NAMES})


def passage_of(i):
    return " ".join(f"word{(i * k) % 40}" for k in range(1, 20))


def own_values(rows):
    return all(row[name] == f"{name} of {row['doc_id']}" for row in rows for name in NAMES)


def test_stages_that_filter_or_redact_return_the_columns_of_the_input(spark, docs, tmp_path):
    labelled = [(100 + i, "stupid insult" if i % 2 else passage_of(i), i % 2) for i in range(200)]
    more = spark.createDataFrame([(i, text) for i, text, _ in labelled], "doc_id bigint, text string")
    more = more.withColumns({name: F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")) for name in NAMES})
    spark.createDataFrame([(i, bad, bad) for i, _, bad in labelled], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no text holds")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.unionByName(more, allowMissingColumns=True) if name == "toxicity" else docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns and rows and own_values(rows), name
        if name == "near_duplicates":
            assert sorted(row["doc_id"] for row in rows) == [0, 2, 3, 4]
        if name == "secrets":
            assert "[secret]" in {row["doc_id"]: row["text"] for row in rows}[2] and len(rows) == 6


def test_operators_keep_what_they_only_work_with(spark, docs):
    benchmark = spark.createDataFrame([("a", " ".join(f"word{i}" for i in range(3, 20)))], "item_id string, text string")
    found = {row["doc_id"]: row for row in decontaminate.matches(docs, benchmark, block_words=5).collect()}
    assert found[0]["n_hit"] == 17 and found[2]["n_hit"] == 0
    assert all(row[name] == f"{name} of {doc_id}" for doc_id, row in found.items() for name in NAMES if name not in decontaminate.RESULTS)
    scanned = secrets.scan(docs).collect()
    assert len(scanned) == 6 and all(row[name] == f"{name} of {row['doc_id']}" for row in scanned for name in NAMES if name != "spans")
    assert own_values(jaccard.keep_one(docs).collect())


def test_names_are_made_unique_in_any_case(spark):
    df = spark.range(1).select("id", F.lit(1).alias("Score"), F.lit(2).alias("score_own"))
    assert unused(df, "score") == "score_"
    aside, back = set_aside(df, ["score"])
    assert "Score" not in aside.columns and list(back.values()) == ["Score"] and len(set(aside.columns)) == 3


def test_shuffles_are_let_go_only_inside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with freeing_shuffles(spark), freeing_shuffles(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(key, None) == before
