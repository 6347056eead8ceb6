"""N-gram Jaccard join: a blocked, masked sparse product of the document by n-gram incidence with itself.

Rows of the incidence matrix are distinct shingle sets (copies of a set are one row), columns are shingles,
dealt out in blocks by a hash. Entry (a, b) of the product is the number of shingles that a and b share. Sizes
bound it from below: sets of sizes m and n reach similarity t only with ceil(t (m + n) / (1 + t)) shared ones.
So only the first ``n - ceil(t n) + 1`` columns of a row, in one global order, can be the first shared column of
a linked pair, and from a shared column's places in both rows follows how many they can share at most. Pairs
that fall short of their bound are discarded; for those left (the mask) the whole rows are multiplied, and the
overlap count decides. The order puts frequent shingles last, which keeps blocks of passages that many texts
hold out of the product; it changes no result.

Only components are wanted, so a block needs no pair whose ends are connected already. Within each column one
row is the pivot and is tried with all others; what that joins needs no more trying. Columns that still span
several components get another pivot; once few are left over, every pair between different components is tried,
unless the rows' sketches already differ in more bits than a link leaves room for (``sketch_of``).
No group is ever written out as all its pairs, and no link between different sets is lost. Who wants the links
themselves, or their number per row, takes ``linked_pairs``, which tries every pair of the mask.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are components of their own
(also when repeated); fewer words than five make one shingle of all; rows map one to one, repeated ones too; null
ids are passed over for the smallest, a component of null ids alone has a null one; further columns are not
read; an empty table gives no rows. Sets and shingles are told apart by 62 and 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .staging import few_files, settle, staged, unused

SIZE, SHARE = 5, 80  # words in a shingle, least similarity in hundredths
HOT = 1 << 62
EARLIER = 8  # columns that a row of the last turn remembers
SKETCH = 16  # words of 64 bits in a row's sketch
_NULL_ID = -(2**63)


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1


def may_link(m: Column, n: Column, at_m: Column, at_n: Column, share: int = SHARE) -> Column:
    """Whether sets of sizes m and n whose first shared shingle has these places can share as many as they must."""
    fits = 100 * F.least(m, n) >= share * F.greatest(m, n)
    return fits & ((100 + share) * F.least(m - at_m, n - at_n) >= share * (m + n))


def sketch_of(own: np.ndarray) -> np.ndarray:
    """A bit per remainder of the shingles, set where an odd number of them falls.

    A shingle that only one of two sets holds turns one bit, one that both hold turns none. So two sets differ in at
    least as many shingles as their sketches do in bits. Sets of some 2,300 and more fill it and are told apart no more.
    """
    odd = np.bincount(own & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def near_enough(m: Column, n: Column, sketch_m: Column, sketch_n: Column, share: int = SHARE) -> Column:
    """Whether sets of sizes m and n with these sketches can link: they share what they must if they differ in no more than this."""
    apart = sum(F.bit_count(F.get(sketch_m, F.lit(i)).bitwiseXOR(F.get(sketch_n, F.lit(i)))) for i in range(SKETCH))
    return (100 + share) * apart <= (100 - share) * (m + n)


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for _, texts, found in words.word_hashes(column, words.BLANKS):
        made, stops = words.shingles(found, texts, SIZE)
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
            yield np.unique(made[a:b])


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def often(made: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur ``least`` times (2 and more) in all of ``made``, ascending, and how often they do."""
    value = np.concatenate([np.zeros(0, np.int64), *made])
    made.clear()
    value.sort()
    # the i-th of equal values has its like ``least - 1`` places on, but for the last ones: no array of all distinct values
    value, times = np.unique(value[: 1 - least][value[least - 1 :] == value[: 1 - least]], return_counts=True)
    return value, times + least - 1


def frequent(docs: DataFrame, least_local: int = 3, keep: int = 500_000) -> np.ndarray:
    """Shingles that many texts hold, for the global order only: the ``keep`` most frequent of those that occur
    ``least_local`` times in one Arrow batch of texts. Whatever it holds or misses, results are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [words.shingles(found, texts, SIZE)[0] for _, texts, found in words.word_hashes(batch.column("text"), words.BLANKS)]
            value, times = often(made, least_local)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times.astype(np.int64))], names=["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(rows.orderBy(F.desc("n"), "h").limit(keep).select("h").toArrow()["h"].to_numpy())


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, text_key, node (hash of the whole set; null without shingles), n, prefix (ordered keys), sketch of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most ``keep`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in (whole.slice(at, 2_000) for whole in batches for at in range(0, whole.num_rows, 2_000)):
            nodes, sizes, heads, sketches = [], [], [], []
            for own in text_sets(batch.column("text")):
                n = len(own)
                sizes.append(n)
                nodes.append(_node(own) if n else None)
                sketches.append(sketch_of(own) if n else None)
                if n and len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    late = hot[at] == own
                    own = np.concatenate([own[~late], own[late] | HOT])
                heads.append(own[: prefix_length(n)].copy() if n else own)  # a part that is no copy would hold the whole
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "prefix", "sketch"])

    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, n bigint, prefix array<bigint>, sketch array<bigint>")


def _columns(batches: Iterator[pa.RecordBatch], share: int = SHARE) -> Iterator[pa.RecordBatch]:
    """Sorted postings (key, node, n, at) to pivot pairs (a, b) and, of columns of three rows and more, their rows.

    A column is read as a stream: its first row is the pivot, its second is held back until a third comes. Of
    frequent columns, which come in several parts, every row is passed on.
    """
    key = pivot = None
    second: tuple | None = None
    for batch in batches:
        k, node, n, at = (batch.column(name).to_numpy() for name in ("key", "node", "n", "at"))
        total = len(k)
        if not total:
            continue
        new = np.ones(total, dtype=bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        starts = np.flatnonzero(new)
        # pivot and place within the column of every row; group 0 may go on from the batch before
        if new[0]:
            number = np.cumsum(new) - 1
            p_node, p_n, p_at = node[starts][number], n[starts][number], at[starts][number]
            place = np.arange(total) - starts[number]
        else:
            number = np.cumsum(new)
            p_node, p_n, p_at = (np.append(before, own[starts])[number] for before, own in zip(pivot[:3], (node, n, at)))
            place = np.arange(total) - np.append(-pivot[3], starts)[number]
        ok = (place > 0) & (node != p_node)
        ok &= 100 * np.minimum(n, p_n) >= share * np.maximum(n, p_n)
        ok &= (100 + share) * np.minimum(n - at, p_n - p_at) >= share * (n + p_n)
        pair = np.unique(np.stack([p_node[ok], node[ok]], axis=1), axis=0)
        # rows of columns with three and more: the third row brings the first two along
        third = np.flatnonzero((place == 2) & (k < HOT))
        rest = np.flatnonzero((place >= 2) | (k >= HOT))
        rows = [np.stack([k[rest], node[rest], n[rest], at[rest]], axis=1)]
        for i in third.tolist():
            rows.append(np.array([[k[i], p_node[i], p_n[i], p_at[i]], [k[i], *((node[i - 1], n[i - 1], at[i - 1]) if i else second)]]))
        rows = np.concatenate(rows)
        size = len(pair) + len(rows)
        out = {
            "a": np.concatenate([pair[:, 0], np.zeros(len(rows), np.int64)]),
            "b": np.concatenate([pair[:, 1], np.zeros(len(rows), np.int64)]),
        } | {name: np.concatenate([np.zeros(len(pair), np.int64), rows[:, j]]) for j, name in enumerate(("key", "node", "n", "at"))}
        out["is_pair"] = np.arange(size) < len(pair)
        if size:
            yield pa.RecordBatch.from_pydict(out)
        key, second = k[-1], (node[-1], n[-1], at[-1])
        pivot = (p_node[-1], p_n[-1], p_at[-1], int(place[-1]) + 1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as one edge from every node to the least one it reaches by them."""
    held = [np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()]) for batch in batches]
    nodes, number = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1), return_inverse=True)
    u, v = number.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        both = np.minimum(least[u], least[v])
        new = least.copy()
        for end in (u, v, least[u], least[v]):
            np.minimum.at(new, end, both)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    for at in range(0, len(moved), 10_000):
        part = moved[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[least[part]])], names=["u", "v"])


def components(links: DataFrame, most: int | None = None, per_task: int = 100_000) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b), at most ``most`` of them: stars of ``per_task`` links each, then,
    if these were several tasks, alternating large and small stars until nothing changes or one task holds the rest."""
    if most is None:
        links = settle(links)
        most = links.count()
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    held_by = lambda df, tasks: settle(df.repartition(tasks).mapInArrow(_stars, "u bigint, v bigint"))
    tasks = max(1, -(-most // per_task))
    edges = held_by(edges, tasks)
    before = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").filter("u != v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
        if now["n"] <= per_task:
            edges = held_by(edges, 1)
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def joined_up(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after ``links`` (a, b) are added: only what they join is gone through again."""
    most = links.count()
    if comps is None:
        return staged(few_files(components(links, most), 2 * most), "components")
    if not most:
        return comps
    for end in ("a", "b"):
        named = comps.select(F.col("node").alias(end), F.col("comp").alias(f"c_{end}"))
        links = links.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    # a link's own ends come along: nodes that no link has named before belong to themselves
    moved = components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), most)
    moved = staged(few_files(moved.toDF("comp", "now"), 2 * most), "moved")
    kept = comps.join(moved, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
    fresh = moved.select(F.col("comp").alias("node"), F.col("now").alias("comp")).join(comps.select("node"), "node", "left_anti")
    return staged(few_files(kept.unionByName(fresh), comps.count() + 2 * most), "components")


def _bitmap(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bit per remainder of the ids: at most 2**bits bits, put together on the executors."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    rows = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << bits}L) & 63 as int))").alias("b"))
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _taken(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return np.flatnonzero((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))


def _with_ends(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _of_nodes(own: DataFrame, nodes: DataFrame, most: int, *arrays: str) -> DataFrame:
    """node, n and these arrays of ``own``, one row for each of ``nodes``, at most ``most``; a few others slip through."""
    shared = own.sparkSession.sparkContext.broadcast(_bitmap(nodes.select(F.col("node").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _taken(shared.value, batch.column("bit").to_numpy())
            kept = kept[np.unique(batch.column("node").to_numpy()[kept], return_index=True)[1]]
            yield batch.select(["node", "n", *arrays]).take(pa.array(kept))

    bit = F.pmod(F.xxhash64("node"), F.lit(1 << 24))
    rows = own.filter("n > 0").select("node", "n", *arrays, bit.alias("bit"))
    rows = rows.mapInArrow(run, ", ".join(["node bigint, n bigint", *(f"{name} array<bigint>" for name in arrays)])).dropDuplicates(["node"])
    return staged(few_files(rows, most), f"{'-'.join(arrays)}-of-nodes")


def within_bounds(own: DataFrame, pairs: DataFrame, share: int = SHARE) -> DataFrame:
    """The ``pairs`` (a, b, settled) whose product over their prefix columns still lets them reach their bound.

    Up to the lesser of the two prefixes' last keys both rows are known, so their overlap is what they share
    there and, at most, all that the row with less left has behind it. Their sketches must let them link as well.
    """
    most = pairs.count()
    heads = _of_nodes(own, _ends(pairs), 2 * most, "prefix", "sketch")
    limit = F.least(F.element_at("prefix_a", -1), F.element_at("prefix_b", -1))
    left = lambda n, prefix: F.col(n) - F.size(F.filter(prefix, lambda key: key <= F.col("limit")))
    can = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.least(left("n_a", "prefix_a"), left("n_b", "prefix_b"))
    joined = _with_ends(pairs, heads, "n", "prefix", "sketch").withColumn("limit", limit)
    joined = joined.filter(near_enough(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), share))
    return settle(few_files(joined.filter((100 + share) * can >= share * (F.col("n_a") + F.col("n_b"))).select("a", "b"), most))


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, settled) of nodes with their sizes m and n and ``shared``, the product of their whole incidence rows.

    Only texts that stand for a node of some pair are read again: a bitmap of their ids (of bounded size, some
    others slip through) keeps the rest from being cut and sent.
    """
    ids = nodes.select("node", F.col("rep").alias("id")).join(_ends(pairs), "node", "left_semi").select("id")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _taken(shared.value, batch.column("bit").to_numpy())
            seen = {}
            for own in text_sets(batch.column("text").take(pa.array(kept))):
                if len(own):
                    seen.setdefault(_node(own), own)
            names, sets = list(seen), list(seen.values())
            for at in range(0, len(sets), 500):
                columns = [pa.array(names[at : at + 500], pa.int64()), pa.array(sets[at : at + 500], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "row"])

    bit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_NULL_ID))), F.lit(1 << 24))
    rows = docs.select("text", bit.alias("bit")).mapInArrow(run, "node bigint, row array<bigint>")
    rows = few_files(rows.dropDuplicates(["node"]), 2 * pairs.count())
    joined = _with_ends(pairs, staged(rows, "rows-of-pairs"), "row")
    shared_count = F.size(F.array_intersect("row_a", "row_b"))
    return joined.select("a", "b", F.size("row_a").alias("m"), F.size("row_b").alias("n"), shared_count.alias("shared"))


def _links(docs: DataFrame, own: DataFrame, nodes: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Those of the settled ``pairs`` that are links; of no pairs none, without another look at the texts."""
    if not pairs.isEmpty():
        pairs = within_bounds(own, pairs, share)
    if pairs.isEmpty():
        return pairs
    counted = overlaps(docs, nodes, pairs)
    links = counted.filter(100 * F.col("shared") >= share * (F.col("m") + F.col("n") - F.col("shared"))).select("a", "b")
    return settle(few_files(links, pairs.count()))


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_components(docs: DataFrame, share: int = SHARE, pivot_rounds: int = 6, block: int = 512) -> DataFrame:
    """doc_id, text_key, node, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = staged(prefixes(docs, frequent(docs)), "prefixes")
    # copies of one set become one row, that of the least id
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    nodes = settle(own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min(real("doc_id")).alias("least_id")))
    heads = own.join(nodes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
    postings = heads.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    postings = postings.select("key", "node", "n", F.col("at").cast("bigint").alias("at"))
    salt = F.when(F.col("key") >= HOT, F.pmod(F.xxhash64("node"), F.lit(parts))).otherwise(0)
    sorted_ = postings.repartition("key", salt).sortWithinPartitions("key", "node")
    streamed = staged(sorted_.mapInArrow(_columns, "a bigint, b bigint, key bigint, node bigint, n bigint, at bigint, is_pair boolean"), "columns")
    rest = streamed.filter("not is_pair").select("key", "node", "n", "at")
    tried = [settle(_pairs(streamed.filter("is_pair")))]
    comps = joined_up(None, _links(docs, own, nodes, tried[0], share))
    columns = None  # open ones of the turn before; a column that is closed stays so
    for turn in range(pivot_rounds + 1):
        rows = rest.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # each column's pivot of this turn is found along with its components, so that rows meet one row per column once
        lot = F.xxhash64("node", F.lit(turn))
        by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(lot).alias("lot"), *(F.min_by(c, lot).alias(c) for c in ("node", "n", "at")))
        major = F.max_by("comp", F.struct("size", "comp")).alias("major")
        pivot = [F.min_by(c, "lot").alias(f"q_{c}") for c in ("node", "n", "at", "comp")]
        spans = by_comp.groupBy("key").agg(F.sum("size").alias("total"), F.max("size").alias("most"), major, F.count("*").alias("kinds"), *pivot)
        spans = spans.filter("kinds > 1")
        open_ = staged(spans if columns is None else few_files(spans, columns), "open-columns")
        work = (F.col("total") - F.col("most")).cast("double") * F.col("total")
        cost, amount, columns = open_.agg(F.coalesce(F.sum(work), F.lit(0.0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
        if not amount:
            break
        last = turn == pivot_rounds or cost <= 64.0 * amount
        fits = may_link(F.col("q_n"), F.col("n"), F.col("q_at"), F.col("at"), share) & (F.col("q_comp") != F.col("comp"))
        if last:
            # a pair that shares an earlier open column is tried there; a few columns back find most of them
            earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("at").rowsBetween(-EARLIER, -1))
            rows = staged(rows.join(open_.select("key", "total", "major"), "key").withColumn("earlier", earlier), "open-rows")
            rows = rows.join(_of_nodes(own, rows.select("node").distinct(), amount, "sketch").select("node", "sketch"), "node")
            fits &= near_enough(F.col("q_n"), F.col("n"), F.col("q_sketch"), F.col("sketch"), share)
            blocks = F.ceil(F.col("total") / block).cast("int")
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks.cast("bigint")).cast("int"))
            minor = rows.filter("comp != major").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            minor = minor.select("key", "block", *(F.col(c).alias(f"q_{c}") for c in ("node", "n", "at", "comp", "earlier", "sketch")))
            found = minor.join(dealt, ["key", "block"]).filter(fits & ~F.arrays_overlap("q_earlier", "earlier")).select(F.col("q_node").alias("a"), F.col("node").alias("b"))
        else:
            found = rows.join(open_, "key").filter(fits).select(F.col("q_node").alias("a"), F.col("node").alias("b"))
        # but in the last turn a row makes one pair per column at most
        new = _pairs(found).join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(settle(new if last else few_files(new, amount)))
        comps = joined_up(comps, _links(docs, own, nodes, tried[-1], share))
        if last:
            break
    named = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_node = named.join(least, "comp").select("node", "comp", "component_id")
    joined = own.select(real("doc_id").alias("doc_id"), "text_key", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.withColumn("component_id", component)


def linked_pairs(docs: DataFrame, share: int = SHARE, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Every link, beside the components: (a, b, m, n, shared) of all linked pairs of different sets, and for every
    row of ``docs`` doc_id, text_key, node (its set, as a or b) and n_links, the number of other rows it links with.

    No candidate is left out for being connected already, so groups of near copies cost the square of their
    different sets, as does the result itself; copies of one set are one node, however many.
    """
    own = settle(prefixes(docs, frequent(docs)))
    nodes = settle(own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies")))
    heads = own.join(nodes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"]).dropDuplicates(["node"])
    postings = heads.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    totals = postings.groupBy("key").agg(F.count("*").alias("total")).filter("total > 1")
    rows = postings.join(totals, "key").withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int"))
    other = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("key", "block", *(F.col(c).alias(f"q_{c}") for c in ("node", "n", "at")))
    fits = (F.col("q_node") < F.col("node")) & may_link(F.col("q_n"), F.col("n"), F.col("q_at"), F.col("at"), share)
    tried = settle(_pairs(other.join(dealt, ["key", "block"]).filter(fits).select(F.col("q_node").alias("a"), F.col("node").alias("b"))))
    counted = overlaps(docs, nodes, within_bounds(own, tried, share))
    pairs = settle(counted.filter(100 * F.col("shared") >= share * (F.col("m") + F.col("n") - F.col("shared"))))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("to")))
    others = ends.join(nodes.select(F.col("node").alias("to"), "copies"), "to").groupBy("node").agg(F.sum("copies").alias("others"))
    degree = nodes.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = own.select(F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), "text_key", "node").join(degree, "node", "left")
    return pairs, members.select("doc_id", "text_key", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (of repeated rows any); rows without shingles stay."""
    found = link_components(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    chosen = found.filter("node is not null").groupBy("comp").agg(F.min(order).alias("o")).select("o.doc_id", "o.text_key", F.lit(False).alias("blank"))
    blank = found.filter("node is null").select("doc_id", "text_key", F.lit(True).alias("blank")).distinct()
    kept_id, key, is_blank, text_key, row, lot = (unused(docs, name) for name in ("_id", "_key", "_blank", "_text_key", "_row", "_lot"))
    kept = chosen.unionByName(blank).select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(key), F.col("blank").alias(is_blank))
    rows = docs.withColumn(text_key, F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id())
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_key) == F.col(key)))
    rows = rows.withColumn(lot, F.when(F.col(is_blank), F.col(row))).dropDuplicates([kept_id, key, lot])
    return rows.select(*docs.columns)
