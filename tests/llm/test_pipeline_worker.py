"""The last stage of the pipeline holds one Python worker per task."""

import hashlib

import public_tokenizers

import corpus_pipeline
from emberline.llm import bpe


def test_the_pipeline_encodes_and_decodes_in_one_worker(spark):
    texts = ["", None, "it's 12 naïve words", "<|endoftext|> a", "x" * 300, "a b c"] * 3
    docs = spark.createDataFrame([(i, "en", "s", t, 0) for i, t in enumerate(texts)], "doc_id bigint, lang string, source string, text string, n_chars bigint")
    out = corpus_pipeline.encode(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    apart = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, tokenizer), tokenizer).collect()}
    for row in out.collect():
        other = apart[row["doc_id"]]
        assert row["token_ids"] == other["token_ids"] and row["n_tokens"] == len(other["token_ids"])
        assert row["decoded_sha256"] == hashlib.sha256(other["decoded"].encode()).hexdigest()
