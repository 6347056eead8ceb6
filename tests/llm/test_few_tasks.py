"""Small intermediate results take few steps and files; results stay those of the plain way."""

import os
import random

import pytest

from emberline.llm import jaccard, staging


def least_reached(pairs):
    least = {x: x for pair in pairs for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("per_task", [100_000, 120])
def test_components_settle_at_once_where_a_task_holds_the_links(spark, monkeypatch, per_task):
    rng, settled = random.Random(3), []
    names = [rng.randint(-(2**62), 2**62) for _ in range(700)]
    pairs = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 400)]
    pairs += [(rng.choice(names[400:]), rng.choice(names[400:])) for _ in range(160)]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    monkeypatch.setattr(jaccard, "settle", lambda df, settle=jaccard.settle: settled.append(1) or settle(df))
    got = jaccard.components(links, per_task=per_task).collect()
    assert {r["node"]: r["comp"] for r in got} == {x: least for x, least in least_reached(pairs).items() if any(a != b for a, b in pairs if x in (a, b))}
    assert len(got) == len({r["node"] for r in got})
    assert per_task < len(pairs) or len(settled) <= 2
    assert jaccard.components(links.limit(0)).count() == 0


def test_few_rows_are_few_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(900).repartition(150, "id")
        staging.few_files(rows, 900).write.parquet(f"{tmp_path}/few")
        many = staging.few_files(rows, 10**9)
        assert many.rdd.getNumPartitions() == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [name for name in os.listdir(f"{tmp_path}/few") if name.endswith(".parquet")]
    assert len(files) <= 2 * spark.sparkContext.defaultParallelism and spark.read.parquet(f"{tmp_path}/few").count() == 900


def test_a_pair_is_made_in_few_of_the_columns_it_shares(spark, monkeypatch):
    rng, made = random.Random(11), []
    base = [f"w{i}" for i in range(1000)]
    texts = []
    for group in range(30):
        own = list(base)
        for place in rng.sample(range(1000), 13):
            own[place] = f"x{group}-{place}"
        texts += [" ".join(own)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "_pairs", lambda pairs, plain=jaccard._pairs: made.append((pairs.count(), plain(pairs).count())) or plain(pairs))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(docs, pivot_rounds=0).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(a, b) for b in range(30) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == {i: i for i in range(30)} | least_reached(links)
    rows, pairs = made[-1]
    assert pairs > 100 and rows <= 2 * pairs
