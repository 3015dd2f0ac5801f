"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document is the set of its distinct word shingles. Documents with equal sets are one node. Every
node has a signature of ``TREES`` times ``DEPTH`` minimum hashes; each tree sorts the nodes by its
own ``DEPTH`` of them. Documents that are alike share long prefixes in some of the orders, so the
neighbours in each order with the longest common prefix are candidates: the node before, and the
hub of the region. The hub is the node whose prefixes most other nodes have in all trees, as the
original of many altered copies does. A region is a prefix of ``LEAST`` values; one with many nodes
goes deeper until it has at most ``REGION`` or the prefix ends, and its nodes also meet the hub of each
deeper region. The orders are cut by range, so a hot region spreads over tasks.

Round one: each node takes the candidate that most trees give it and the largest hub, those whose
signatures allow it are confirmed on the full sets, and confirmed links are joined into components. Round two covers the rest: in every region
that still holds more than one component, all nodes of different components are compared by signature in
cells of two blocks; those that may be alike send their full sets to the cell once, and the pairs
are confirmed there. What the first round leaves out by keeping two, the second takes up; of the pairs
that share a region it gives up only those with fewer agreeing hashes than ``SLACK`` allows. Nodes of the largest component of a region stay in
their blocks and only the others travel to all of them.

A pair at the threshold of 0.8 shares no region in any of 24 trees with a chance of 3.3e-8, and shares one
but has too few agreeing hashes for round two with a chance of 1.5e-8, so it is compared with a chance of
1 - 5e-8 (sums of binomials over independent hashes).

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows that share an id are one document,
and what is linked with one of them is linked with all; a row without an id is never linked, has
no component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import Scratch, buffers, whole_text, written

TREES, DEPTH, LEAST = 24, 5, 3
REGION = 64
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
SLACK = 0.22  # of the estimated similarity below the threshold, about six standard errors of 120 hashes
CACHE = 500_000
SALTS = 1024


# ---- shingle sets and signatures -----------------------------------------------------------------


def shingle_set(words: list[bytes], n: int, cache: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((cache.get(w) or _learn(cache, w) for w in words), np.uint64, len(words))
    out = np.zeros(max(1, len(h) - n + 1), np.uint64)
    width = min(n, len(h))
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    out = out ^ (out >> np.uint64(31))
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width))


def _learn(cache: dict, word: bytes) -> int:
    if len(cache) >= CACHE:
        cache.clear()
    cache[word] = h = xxhash.xxh64_intdigest(word) or 1
    return h


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, one row per non-empty set."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2**32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, TREES * DEPTH, np.uint64).astype(np.uint32)
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for k in range(TREES * DEPTH):
            y = (low * a[k]) ^ (high + b[k])
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0xC2B2AE35)
            out[first:last, k] = np.minimum.reduceat(y, starts)
        first = last
    return out


def document_sets(docs: DataFrame, n: int, id_column: str, text: str) -> DataFrame:
    """``id, n_shingles, key, signature``: the key is equal for equal sets, null for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            data = data.lower()
            for at in range(0, len(batch), 500):
                sets = [shingle_set(data[a:b].split(), n, cache) for a, b in zip(offsets[at : at + 500], offsets[at + 1 : at + 501])]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [next(rows).astype(">u4").tobytes() if len(s) else None for s in sets]
                yield pa.record_batch(
                    [batch.column(0).slice(at, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    ["id", "n_shingles", "key", "signature"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), whole_text(text).alias("t")).mapInArrow(run, "id bigint, n_shingles bigint, key binary, signature binary")


# ---- candidates of the sorted orders -------------------------------------------------------------


def forest(nodes: DataFrame, *keep: str) -> DataFrame:
    """``tree, key, node`` of each node in each tree."""
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("signature", 4 * DEPTH * t + 1, 4 * DEPTH).alias("key")) for t in range(TREES)])
    return nodes.select("node", *keep, F.explode(trees).alias("o")).select("o.tree", "o.key", "node", *keep)


def in_order(orders: DataFrame) -> DataFrame:
    """The sorted orders, cut by range over the tasks."""
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")


def _regions(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple[list, bool]]:
    """Rows ``(tree, key, node, ...)`` of one region after the other, and whether it may go on in another task.

    A very large region comes in parts; the second round joins what they leave apart.
    """
    held: list = []
    edge = True
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (row[0] != held[0][0] or row[1][: 4 * LEAST] != held[0][1][: 4 * LEAST] or len(held) >= most):
                full = len(held) >= most
                yield held, edge or full
                held, edge = [], full
            held.append(row)
    if held:
        yield held, True


def crowding(orders: DataFrame) -> DataFrame:
    """``node, weight``: nodes that share a region with others, and how many share their whole keys over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, edge in _regions(batches):
            if len(region) > 1 or edge:
                sizes: dict = {}
                for _, key, _ in region:
                    sizes[key] = sizes.get(key, 0) + 1
                yield pa.record_batch([pa.array([r[2] for r in region], pa.int64()), pa.array([sizes[r[1]] for r in region], pa.int64())], ["node", "weight"])

    return in_order(orders).mapInArrow(run, "node bigint, weight bigint").groupBy("node").agg(F.sum("weight").alias("weight"))


def _deeper(keys: list[bytes], rank: list[tuple], first: int, last: int, depth: int, out: list[tuple[int, int]]) -> None:
    """Candidates of the region ``first..last`` of equal prefixes: each node with the hub, and deeper if there are many."""
    hub = max(range(first, last), key=rank.__getitem__)
    out += [(i, hub) for i in range(first, last) if i != hub]
    if last - first > REGION and depth < DEPTH:
        start = first
        for i in range(first + 1, last + 1):
            if i == last or keys[i][: 4 * (depth + 1)] != keys[start][: 4 * (depth + 1)]:
                if i - start > 1:
                    _deeper(keys, rank, start, i, depth + 1, out)
                start = i


def candidates(orders: DataFrame) -> DataFrame:
    """``b`` and its candidate ``a`` of larger weight, one row for each time the forest of ``orders(tree, key, node, weight)`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, _ in _regions(batches):
            if len(region) > 1:
                keys, rank = [r[1] for r in region], [(r[3], -r[2]) for r in region]
                out = [(i, i + 1) if rank[i] < rank[i + 1] else (i + 1, i) for i in range(len(region) - 1)]
                _deeper(keys, rank, 0, len(region), LEAST, out)
                b, a = zip(*out)
                yield pa.record_batch([pa.array([region[i][2] for i in a], pa.int64()), pa.array([region[i][2] for i in b], pa.int64()), pa.array([region[i][3] for i in a], pa.int64())], ["a", "b", "weight"])

    return in_order(orders).mapInArrow(run, "a bigint, b bigint, weight bigint").filter("a != b")


def best_two(pairs: DataFrame) -> DataFrame:
    """For each node the candidate that most trees give it, and the one of the largest weight."""
    votes = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    n, weight = (-F.col("n")).alias("n"), (-F.col("weight")).alias("weight")
    mine = votes.groupBy("b").agg(F.min(F.struct(n, weight, "a")).alias("p"), F.min(F.struct(weight, n, "a")).alias("q"))
    return mine.select(F.explode(F.array_distinct(F.array("p.a", "q.a"))).alias("a"), "b")


def low_bytes() -> Column:
    """The lowest byte of each hash of ``signature``; chance equals add 1/256."""
    hexes = F.hex("signature")
    return F.unhex(F.concat_ws("", *[F.substring(hexes, 8 * k + 7, 2) for k in range(TREES * DEPTH)]))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the threshold, by the rule of the second round.

    Signatures decide before any text moves, so texts are read for pairs that are nearly links only.
    """
    least = TREES * DEPTH * (percent / 100 - SLACK)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), low_bytes().alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), TREES * DEPTH) for k in (2, 3))
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint").distinct()


# ---- confirmation on full sets -------------------------------------------------------------------


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets reach the threshold: ``100 * intersection >= percent * union``.

    The text of ``b`` travels with the pair; that of ``a`` once per pair's salt, so the pairs of a much
    repeated ``a`` spread over tasks.
    """
    salted = scratch.written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")))
    wanted = salted.select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("bigint").alias("b")).distinct()
    wanted = wanted.unionByName(salted.select(F.col("b").alias("node"), "a", "salt", "b"))
    # Written first, so Spark knows how small it is when it chooses how to find the texts, and only those move.
    needed = scratch.written(wanted.select("node").distinct())
    rows = wanted.join(texts.join(needed, "node", "left_semi"), "node").select("a", "salt", "b", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        owner, mine = None, None
        for batch in batches:
            found = []
            for a, salt, b, t in zip(*[c.to_pylist() for c in batch.columns]):
                s = shingle_set(t.encode().lower().split(), n, cache)
                if b is None:
                    owner, mine = (a, salt), s
                    continue
                if owner != (a, salt):
                    raise ValueError("a pair has lost the text of its first document")
                place = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                both = int((mine[place] == s).sum())
                if 100 * both >= percent * (len(mine) + len(s) - both):
                    found.append((a, b))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    ordered = rows.repartition("a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    found = ordered.mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label``: the smallest node reachable, by large-star and small-star steps until nothing changes.

    The links of each step are a table, so right sides are read plain and Spark can split a hot node.
    The tables of a step are deleted when it is done.
    """
    links = scratch.written(links.distinct())
    if links.isEmpty():
        return links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    earlier = None
    while True:
        step, after = Scratch(links.sparkSession), Scratch(links.sparkSession)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = step.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = step.written(both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct())
        # Small star: every node's smaller neighbours and itself move to the smallest of them.
        least = step.written(large.groupBy("b").agg(F.min("a").alias("m")))
        moved = large.join(least, "b")
        small = moved.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
        small = after.written(small.distinct())
        done = small.count() == links.count() and small.join(links, ["a", "b"], "left_anti").isEmpty()
        if done:
            small = scratch.written(small)
        for old in (step, earlier, after if done else None):
            if old:
                old.clear()
        if done:
            return small.select(F.col("b").alias("node"), F.col("a").alias("label"))
        links, earlier = small, after


# ---- the rest ------------------------------------------------------------------------------------

CELL = ["tree", "region", "kind", "i", "j"]


def mixed_cells(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``tree, region, kind, i, j, side`` and the columns of ``nodes``: where nodes of different components meet.

    ``nodes(node, label, signature, n_shingles)`` are those that share a region with any other. Blocks are
    bounded by rows and by shingles, so the sets of a cell fit into one task.
    """
    rows = scratch.written(forest(nodes, "label", "n_shingles").select("tree", F.substring("key", 1, 4 * LEAST).alias("region"), "node", "label", "n_shingles"))
    # A region with one component has nothing left to compare.
    held = rows.groupBy("tree", "region", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    mixed = held.groupBy("tree", "region").agg(
        F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    mixed = scratch.written(mixed.select(
        "tree", "region", F.col("most.label").alias("main"), blocks(F.col("most.n"), F.col("most.size")).alias("mains"),
        blocks(F.col("all") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("others")))
    some = rows.drop("n_shingles").join(mixed, ["tree", "region"])
    is_main = F.col("label") == F.col("main")
    some = some.withColumn("block", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # Cells of kind 0: one block of the main component (side 0) and one of the others. Kind 1: two blocks of the others.
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(upto(F.col("mains")), lambda i: cell(0, i, F.col("block"), F.lit(1)))
    with_others = F.transform(upto(F.col("others")), lambda j: cell(1, F.least(j, F.col("block")), F.greatest(j, F.col("block")), F.col("block") > j))
    of_main = F.transform(upto(F.col("others")), lambda j: cell(0, F.col("block"), j, F.lit(0)))
    cells = F.when(is_main, of_main).otherwise(F.concat(with_main, with_others))
    return some.select("tree", "region", F.explode(cells).alias("c"), "node").select("tree", "region", "c.*", "node")


def marks(nodes: DataFrame) -> DataFrame:
    """``node, label, n_shingles, bytes, regions``: what two nodes are compared by before their sets are.

    ``bytes`` has the lowest byte of each hash, ``regions`` a code of the region of each tree.
    """
    codes = F.array(*[F.hash(F.substring("signature", 4 * DEPTH * t + 1, 4 * LEAST)) for t in range(TREES)])
    return nodes.select("node", "label", "n_shingles", low_bytes().alias("bytes"), codes.alias("regions"))


class Cell:
    """The rows ``node, side, label, n_shingles, bytes, regions, ...`` of one cell."""

    def __init__(self, key: tuple, rows: list[tuple], percent: int):
        self.tree, self.across = key[0], key[2] == 0 or key[3] != key[4]
        self.rows, self.percent = rows, percent
        self.side, self.label, self.size = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        self.bytes = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.regions = np.array([r[5] for r in rows], np.int32)
        self.least = TREES * DEPTH * (percent / 100 - SLACK)

    def alike(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row and those of other components that may be alike and meet in no earlier tree."""
        sides = [np.flatnonzero(self.side == k) for k in (0, 1)]
        for i in sides[0] if self.across else range(len(self.rows) - 1):
            j = sides[1] if self.across else np.arange(i + 1, len(self.rows))
            j = j[self.label[j] != self.label[i]]
            j = j[100 * np.minimum(self.size[j], self.size[i]) >= self.percent * np.maximum(self.size[j], self.size[i])]
            j = j[(self.regions[j, : self.tree] != self.regions[i, : self.tree]).all(axis=1)]
            j = j[(self.bytes[j] == self.bytes[i]).sum(axis=1) >= self.least]
            if len(j):
                yield i, j

    def meeting(self) -> np.ndarray:
        """The rows that are in any such pair."""
        out = np.zeros(len(self.rows), bool)
        for i, j in self.alike():
            out[i] = True
            out[j] = True
        return np.flatnonzero(out)

    def links(self) -> list[tuple[int, int]]:
        """Labels whose components a pair of full sets joins; the set is the last column."""
        sets = [np.frombuffer(r[6], np.uint64) for r in self.rows]
        ends = np.cumsum([0] + [len(s) for s in sets])
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(places), bool)
        first, found = self.label.copy(), []
        for i, j in self.alike():
            j = j[self.label[j] != self.label[i]]
            if not len(j):
                continue
            own = places[ends[i] : ends[i + 1]]
            mine[own] = True
            both = np.array([np.count_nonzero(mine[places[ends[k] : ends[k + 1]]]) for k in j])
            mine[own] = False
            for k in j[100 * both >= self.percent * (self.size[i] + self.size[j] - both)]:
                if self.label[k] != self.label[i]:
                    found.append((int(first[i]), int(first[k])))
                    self.label[self.label == self.label[k]] = self.label[i]
        return found


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[tuple, Cell]]:
    """One cell after the other from rows sorted by cell: its five columns, then those of ``Cell``."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:5] != key:
                if len(held) > 1:
                    yield key, Cell(key, held, percent)
                key, held = row[:5], []
            held.append(row[5:])
    if len(held) > 1:
        yield key, Cell(key, held, percent)


def remaining_links(nodes: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: labels of different components that share a region and are linked by a pair of full sets.

    The signatures of a cell say which of its nodes are in a pair that may be alike and meets in no
    earlier tree. Only those send their sets to the cell, once each, where all its pairs are confirmed:
    what is shipped grows with nodes and blocks, and no pair is ever a row.
    """
    marked = scratch.written(marks(nodes))
    columns = [*CELL, "node", "side", "label", "n_shingles", "bytes", "regions"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in _cells(batches, percent):
            rows = cell.meeting()
            if len(rows):
                node, side = [cell.rows[i][0] for i in rows], [cell.rows[i][1] for i in rows]
                k = [pa.array([x] * len(rows), t) for x, t in zip(key, (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.record_batch([*k, pa.array(node, pa.int64()), pa.array(side, pa.int32())], [*CELL, "node", "side"])

    by_cell = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    met = by_cell(mixed_cells(nodes, scratch).join(marked, "node").select(*columns))
    met = scratch.written(met.mapInArrow(meet, "tree int, region binary, kind int, i int, j int, node bigint, side int"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            data = data.lower()
            for at in range(0, len(batch), 500):
                sets = [shingle_set(data[a:b].split(), n, cache).tobytes() for a, b in zip(offsets[at : at + 500], offsets[at + 1 : at + 501])]
                yield pa.record_batch([batch.column(0).slice(at, 500), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    wanted = texts.join(met.select("node").distinct(), "node").select("node", "t").mapInArrow(full, "node bigint, n bigint, shingles binary")
    # Rows that share an id may have other texts; the size of each set is its own.
    sent = met.join(marked.drop("n_shingles"), "node").join(wanted, "node").withColumnRenamed("n", "n_shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in _cells(batches, percent):
            found = cell.links()
            if found:
                yield pa.record_batch([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return by_cell(sent.select(*columns, "shingles")).mapInArrow(confirm, "a bigint, b bigint").distinct()


# ---- the operator --------------------------------------------------------------------------------


def near_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    return _classes(docs, n, percent, id_column, text, written)


def _classes(docs: DataFrame, n: int, percent: int, id_column: str, text: str, lasting: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``lasting`` writes the two tables that the result is read from; all others are deleted here."""
    scratch = Scratch(docs.sparkSession)
    sets = lasting(document_sets(docs, n, id_column, text))
    reps = scratch.written(sets.filter("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    crowd = scratch.written(crowding(forest(reps)))
    active = scratch.written(reps.join(crowd, "node").select("node", "n_shingles", "signature", "weight"))
    chosen = scratch.written(best_two(candidates(forest(active, "weight"))))
    texts = docs.select(F.col(id_column).cast("bigint").alias("node"), whole_text(text).alias("t"))
    links = scratch.written(confirmed(likely(chosen, active, percent), texts, n, percent, scratch))
    labels = components(links, scratch)
    nodes = scratch.written(active.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n_shingles", "signature"))
    more = scratch.written(remaining_links(nodes, texts, n, percent, scratch))
    if not more.isEmpty():
        joined = components(more, scratch).select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = nodes.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    keyed = lasting(reps.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id")))
    scratch.clear()
    named = sets.filter("id is not null and key is not null").join(keyed, "key").select("id", "n_shingles", "component_id")
    alone = sets.filter("id is null or key is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with the columns they came with.

    The ids that go meet the rows, as they are the fewer; a row without an id meets none and stays.
    """
    scratch = Scratch(docs.sparkSession)
    classes = _classes(docs, n, percent, id_column, text, scratch.written)
    dropped = written(classes.groupBy(F.col(id_column).alias("__dropped")).agg(F.max("kept").alias("kept")).filter("not kept").select("__dropped"))
    scratch.clear()
    return docs.join(dropped, F.col(id_column) == F.col("__dropped"), "left_anti")
