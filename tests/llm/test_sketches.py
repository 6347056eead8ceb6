"""Pairs of a group of near copies that cannot link are told apart before they become rows."""

import random

import numpy as np
import pyarrow as pa

from emberline.llm import jaccard


def near_copies(rows, words=150, seed=17):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    for number in range(rows):
        own = list(base)
        for place in rng.sample(range(words), rng.choice([1, 2, 3, 3, 4, 4])):
            own[place] = f"x{number}-{place}"
        yield " ".join(own)


def test_sketches_never_part_sets_that_link(spark):
    rng = random.Random(5)
    texts = list(near_copies(40)) + list(near_copies(20, words=40, seed=2)) + ["", None, "a", "a b c d e f", " ".join(f"v{rng.random()}" for _ in range(4000))]
    sets = list(jaccard.text_sets(pa.array(texts)))
    rows = [(len(own), [int(w) for w in jaccard.sketch_of(own)], [int(h) for h in own]) for own in sets]
    frame = spark.createDataFrame(rows, "n bigint, sketch array<bigint>, row array<bigint>").filter("n > 0")
    both = frame.crossJoin(frame.toDF("n_b", "sketch_b", "row_b"))
    near = jaccard.near_enough(*(both[c] for c in ("n", "n_b", "sketch", "sketch_b")))
    parted = 0
    for r in both.withColumn("near", near).collect():
        a, b = set(r["row"]), set(r["row_b"])
        assert r["near"] or 100 * len(a & b) < 80 * len(a | b)
        parted += not r["near"]
    assert parted > 1000


def test_the_last_turn_makes_few_pairs_that_cannot_link(spark, monkeypatch):
    texts, made = list(near_copies(120)), []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "_pairs", lambda pairs, plain=jaccard._pairs: made.append(plain(pairs).count()) or plain(pairs))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(docs, pivot_rounds=0).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(a, b) for b in range(120) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = list(range(120))
    for _ in range(120):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == dict(enumerate(least))
    assert len(links) > 500 and made[-1] <= 500


def test_values_that_occur_often_are_those_of_a_plain_count():
    rng = np.random.default_rng(8)
    for least in (2, 3, 5):
        made = [rng.integers(0, 50, size) for size in (0, 40, 7, 90)]
        value, times = np.unique(np.concatenate(made), return_counts=True)
        got = jaccard.often(list(made), least)
        assert got[0].tolist() == value[times >= least].tolist() and got[1].tolist() == times[times >= least].tolist()
    assert [len(x) for x in jaccard.often([], 3)] == [len(x) for x in jaccard.often([np.array([4, 4])], 3)] == [0, 0]


def test_later_turns_write_few_files(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(near_copies(200))), "doc_id bigint, text string")
    written = []

    def noted(df, name, plain=jaccard.staged):
        out = plain(df, name)
        written.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(jaccard, "staged", noted)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        jaccard.link_components(docs, pivot_rounds=2)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    turns = [files for name, files in written if name == "open-columns"]
    assert len(turns) > 1 and max(turns[1:]) <= 2 * spark.sparkContext.defaultParallelism < turns[0]
