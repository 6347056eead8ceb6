"""Exact top-k search, hard-negative mining and spelling variants against brute force, and their odd cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import hard_negatives, queries, spelling, vafile, vectors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id bigint, embedding array<double>, label int, _key string, rank int, cells string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "clash", 9, "clash") for row in rows], VECTORS)


def cells_of(rows):
    """Smallest cells of each id, as the operators define repeated ids."""
    found = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        cells = [math.floor(256 * x) for x in v]
        found[i] = min(found.get(i, cells), cells)
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, every, k):
    cells = cells_of(rows)
    out = []
    for q in cells:
        if q % every == 0:
            best = sorted((-dot(cells[q], cells[i]), i) for i in cells if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, every, positives=5, negatives=3):
    first = {}
    for i, v, label in rows:
        if label is not None and i in cells_of([(i, v, label)]):
            one = (label, cells_of([(i, v, label)])[i])
            first[i] = min(first.get(i, one), one)
    out = []
    for a, (label, own) in first.items():
        if a % every:
            continue
        others = sorted((-dot(own, c), i, o == label) for i, (o, c) in first.items() if i != a)
        for s, p, _ in [x for x in others if x[2]][:positives]:
            near = [(n, i) for n, i, same in others if not same and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(near, 1)]
    return sorted(out)


def some_vectors(seed=5, n=260, width=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, width))
    rows = [(i, (middles[i % 6] * rng.choice([0.2, 1, 3]) + 0.1 * rng.normal(size=width)).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(90)]  # one vector under many ids: ties
    rows += [(2000, [0.0] * width, 1), (2010, [], 0), (2020, [1.0, 2.0], 1), (-10, [-1.0] * width, 2)]
    rows += [(None, [1.0] * width, 1), (2030, None, 1), (2040, [None, 1.0], 2), (2050, [float("nan")] * width, 0), (2060, [float("inf")], 1)]
    rows += [(20, [9.0] * width, 0), (20, [9.0] * width, 0), (2070, [2.0] * width, None), (2080, [1e9] * 2, 3)]
    return rows


@pytest.mark.parametrize("components", [1 << 19, 256])
def test_top_k_equals_brute_force(spark, monkeypatch, components):
    monkeypatch.setattr(vectors, "COMPONENTS", components)
    rows = some_vectors()
    got = vafile.search(table(spark, rows), F.col("vec_id") % 10 == 0, k=4, bits=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 4)


@pytest.mark.parametrize("components", [1 << 19, 512])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, components):
    monkeypatch.setattr(vectors, "COMPONENTS", components)
    rows = some_vectors(seed=8)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


@pytest.mark.parametrize("search", [vafile.search, hard_negatives.mine])
def test_vectors_without_queries_or_others(spark, search):
    asked = F.col("vec_id") % 10 == 0
    for rows in ([], [(3, [1.0], 1)], [(10, [1.0], 1)], [(None, None, None)]):
        assert search(table(spark, rows), asked).collect() == []


def test_scores_beyond_floating_point_are_exact():
    q, c = np.array([[2**40 + 1, 3]]), np.array([[2**13, 1], [2**21, 7]])
    assert vectors.products(q, c).tolist() == [[(2**40 + 1) * 2**13 + 3, (2**40 + 1) * 2**21 + 21]]
    assert vectors.products(np.array([[2**62]]), np.array([[2**62], [-(2**62)]])).tolist() == [[2**63 - 1, -(2**63) + 1]]


def test_best_keeps_ties_by_smaller_id():
    scores, ids = vectors.best(np.array([[7] * 40 + [9]]), np.arange(41)[::-1], 3)
    assert scores.tolist() == [[9, 7, 7]] and ids.tolist() == [[0, 1, 2]]
    scores, ids = vectors.best(np.array([[vectors.LOW, 4]]), np.array([5, 6]), 3)
    assert scores[0].tolist() == [4, vectors.LOW, vectors.LOW]


def test_cells_hold_their_values_and_bounds_their_scores():
    rng = np.random.default_rng(1)
    cells = rng.integers(-90, 90, (300, 5)) // np.array([1, 1, 1, 40, 200])
    codes, least, most = vafile.quantise(cells, 3)
    at = np.arange(5)
    assert codes.max() < 8 and (least[at, codes] <= cells).all() and (cells <= most[at, codes]).all()
    q = rng.integers(-90, 90, (7, 5))
    low, high = vafile.bounds(q, {"codes": codes, "least": least, "most": most})
    scores = q @ cells.T
    assert (low <= scores).all() and (scores <= high).all()


def test_exact_vectors_are_read_only_as_far_as_needed():
    rng = np.random.default_rng(2)
    cells = np.floor(256 * rng.normal(size=(4000, 16)) / 4).astype(np.int64)
    codes, least, most = vafile.quantise(cells)
    part = {"ids": np.arange(4000), "cells": cells, "codes": codes, "least": least, "most": most}
    _, upper = vafile.bounds(cells[:1], part)
    scores, ids, read = vafile.read_down(cells[:1], upper[0], part, 0, -np.inf, 5)
    all_scores = cells @ cells[0]
    assert scores.tolist() == sorted(all_scores[1:].tolist())[::-1][:5] and (all_scores[ids] == scores).all()
    assert read < 400


def test_coordinate_lists_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 6))
    cells = np.floor(2560 * (middles[rng.integers(8, size=900)] + 0.02 * rng.normal(size=(900, 6)))).astype(np.int64)
    bucket = {"cells": cells, "lists": np.argsort(hard_negatives.units(cells), axis=0, kind="stable"), "longest": hard_negatives.lengths(cells).max()}
    bucket["sorted"] = np.take_along_axis(hard_negatives.units(cells), bucket["lists"], 0)
    q, exact = cells[:40], cells[:40] @ cells.T
    need = np.sort(exact, axis=1)[:, -30].astype(float)
    got, verified = hard_negatives.scored(q, need, bucket)
    assert (got[exact >= need[:, None]] == exact[exact >= need[:, None]]).all()
    assert verified < 0.7 * exact.size
    none, verified = hard_negatives.scored(q, np.full(40, 1e12), bucket)
    assert verified == 0 and (none == vectors.LOW).all()


def brute_near(words):
    """Pairs at one inserted, deleted or replaced code point, by writing out all such changes."""
    alphabet, out = sorted({c for w in words for c in w}), set()
    for w in words:
        for i in range(len(w) + 1):
            for c in alphabet:
                for x in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
                    if x != w and x in words:
                        out.add((min(w, x), max(w, x)))
    return out


def brute_variants(n):
    near = {w: set() for w in n}
    for a, b in brute_near(set(n)):
        near[a].add(b)
        near[b].add(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def brute_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            at = h % len(low)
            n[low[:at] + low[at + 1 :] if h % 199 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(700)}
    words |= {"a" * 5000, "a" * 4999, "a" * 4998 + "b", "listen", "silent", "enlist", "tinsel", "\U0001f600ab", "ab"}
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(rows).collect()}
    small = {w for w in words if len(w) < 100}
    assert {p for p in got if len(p[0]) < 100} == brute_near(small)
    assert {(len(a), len(b)) for a, b in got if len(a) >= 100} == {(4999, 5000), (4999, 4999)}


def test_forms_lead_to_roots_through_a_long_chain(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 5, "zzzzzy": 24, "zzzzyz": 24}
    rows = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = [tuple(r) for r in spelling.variants(rows).collect()]
    assert sorted(got, key=repr) == brute_variants(n)
    assert {w: root for w, _, root, *_ in got}["aaaaaa"] == "abbbbb"


def test_spelling_of_odd_documents_equals_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["Receive", "recieve", "ÀÉpple", "colour", "color", "colours", "x9yellow"]) for _ in range(400))) for i in range(30)]
    docs += [(None, None), (None, "receive receive"), (40, ""), (41, "1 2 ! \n"), (42, "longish" * 30000), (43, "colour " * 30000), (1, docs[1][1])]
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id bigint, text string, run string, word string")
    found = spelling.runs(rows)
    got = spelling.variants(spelling.counted(found.select(spelling.damaged(F.col("run"), F.col("doc_id")).alias("word"))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(brute_counts(docs))
    empty = spelling.counted(spelling.runs(rows.limit(0)).withColumnRenamed("run", "word"))
    assert spelling.variants(empty).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_spelling(spark, SF).collect()]
    assert sorted(got, key=repr) == brute_variants(brute_counts(docs))
