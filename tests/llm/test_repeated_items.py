"""Benchmark items that repeat one another: each text is searched and written out once."""

import random
import time

import numpy as np
import pyarrow as pa

from emberline.llm import decontaminate, words

from .test_llm_operators import brute_matches


def block_of(texts):
    column = pa.array(texts)
    found = [w[a:b] for _, t, w in words.word_hashes(column, words.LETTERS) for a, b in zip(t[:-1], t[1:])]
    return decontaminate.Block.of_items([str(i) for i in range(len(texts))], found, 13)


def test_copies_of_an_item_times_places_are_not_written_out():
    items = ["w"] * 2000 + ["w " * 20] * 300 + ["a b c"]
    shard = pa.array(["w " * 20_000, "a b c", "w w", "none of it"])
    _, texts, found = next(words.word_hashes(shard, words.LETTERS, limit=1 << 30))
    begun = time.time()
    starts, ends, pairs, _ = decontaminate.match_shard(block_of(items), found, texts)
    assert time.time() - begun < 20
    assert len(starts) < 3 * len(found)
    got = {row: set(pairs[pairs[:, 0] == row, 1].tolist()) for row in range(4)}
    assert got == {0: set(range(2300)), 1: {2300}, 2: set(range(2000)), 3: set()}
    covered = np.zeros(len(found), bool)
    for a, b in zip(starts, ends):
        covered[a:b] = True
    assert covered[: texts[3]].all() and not covered[texts[3] :].any()


def test_repeated_items_equal_brute_force(spark):
    docs = [(1, "x y " * 30), (2, "the x y z of it"), (3, "y"), (4, None), (5, "q " * 12 + "x y z")]
    items = [(str(i), t) for i, t in enumerate(["x y"] * 5 + ["x y " * 10] * 4 + ["y"] * 3 + ["x y z", "q " * 13, None, ""])]
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.matches(left, spark.createDataFrame(items, "item_id string, text string")).collect()
    for row in got:
        n_words, n_hit, found = brute_matches(dict(docs)[row["doc_id"]], items)
        assert (row["n_words"], row["n_hit"], sorted(row["item_ids"])) == (n_words, n_hit, sorted(found))


def test_short_texts_against_a_large_vocabulary_equal_brute_force():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 20, 30])))) for i in range(60)]
    block = block_of([text for _, text in items])
    for _ in range(60):
        doc = " ".join(rng.choice(items)[1] for _ in range(rng.randint(1, 4)))
        _, texts, found = next(words.word_hashes(pa.array([doc]), words.LETTERS))
        starts, ends, pairs, _ = decontaminate.match_shard(block, found, texts)
        covered = {place for a, b in zip(starts.tolist(), ends.tolist()) for place in range(a, b)}
        n_words, n_hit, named = brute_matches(doc, items)
        assert (len(found), len(covered), {str(i) for i in pairs[:, 1].tolist()}) == (n_words, n_hit, set(named))
