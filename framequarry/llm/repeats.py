"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed when a string of ``length`` bytes that covers it also starts somewhere else in the
corpus. Rolling-hash triggers (a hash that is the least of its neighbourhood) cut every document
into phrases at places that depend on the bytes around them only. Each starting position belongs to
the trigger that follows it, so its suffix is a phrase suffix followed by what stands after the
trigger: the order of the corpus is the order of the pairs (phrase suffix, parse suffix). Equal strings
have equal pairs and are neighbours in it.

The dictionary is counted first. A phrase context is a trigger with all bytes that strings of its
positions can reach. Contexts found twice are repeated as a whole and need no order. A context found
once is ordered against the other contexts of the dictionary that share its core, the ``2 * EDGE`` bytes
around the trigger, each taken once; contexts whose core is found nowhere else are done. So only the
borders of repeats are ever sorted, however often a passage occurs. Only equality of neighbours
matters, so the order is that of the suffixes' hashes and not of their letters.

Cores with more than ``GROUP`` different contexts are not sorted in one task: their pairs are counted by
an aggregation that combines before it shuffles, and joined back.

A stretch without triggers (a run of one letter) uses the middle of each string as its trigger.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` keeps all; repeated
rows repeat each other; rows without an id are told apart by their text; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import blocks, buffers, whole_text, written

LENGTH = 400
EDGE = 72  # a string's trigger stands so far from its ends at least
NEAR = 64  # neighbourhood of a trigger on either side, with WIDTH bytes of hash below EDGE
WIDTH = 8
GROUP = 8192
BLOCK = 2 << 20  # bytes worked on at once; one longer document is taken whole
BASE = 0x9E3779B97F4A7C15 | 1
ANCHOR = "id bigint, h bigint, at int, low int, high int, core bigint, context bigint"


class Hashes:
    """Hash of any substring from prefix sums of a polynomial modulo 2**64, mixed at the end."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        table = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
        power, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
        power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[data] * np.multiply.accumulate(power)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def triggers(data: np.ndarray) -> np.ndarray:
    """Positions whose hash is below all of the ``NEAR`` before and not above any of the ``NEAR`` after."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    x ^= x >> np.uint32(15)
    span, mix = 1, 0x85EBCA6B
    while span < WIDTH:
        x = x[:-span] * np.uint32(mix) + x[span:]
        mix = mix * mix * 5 % 2**32 | 1
        span *= 2
    x ^= x >> np.uint32(16)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    most = np.full(NEAR, 0xFFFFFFFF, np.uint32)
    least = np.concatenate([most, x, most])
    span = 1
    while span < NEAR:  # least[i] becomes the minimum of NEAR hashes from i on
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.flatnonzero((x < least[: len(x)]) & (x <= least[NEAR + 1 : NEAR + 1 + len(x)]))


def document_anchors(data: np.ndarray, start: int, end: int, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of one document with the distances, least and most, from which strings start before them.

    A string belongs to the first trigger between ``EDGE`` bytes after its start and ``EDGE`` before its
    end; whether a byte there is a trigger depends on bytes of the string alone. Without one it
    belongs to its middle.
    """
    most = length - EDGE
    if end - start < length:
        return (np.zeros(0, np.int64),) * 3
    before = np.concatenate([[start - length], found[:-1]])
    low = np.maximum(EDGE, found + length - end)
    high = np.minimum(np.minimum(most, EDGE + found - before - 1), found - start)
    ok = low <= high
    at, low, high = found[ok], low[ok], high[ok]
    # Starts between the reach of two triggers.
    reach_from, reach_to = at - high, at - low + 1
    free_from = np.concatenate([[start], reach_to])
    free_to = np.concatenate([reach_from, [end - length + 1]])
    gaps = np.flatnonzero(free_from < free_to)
    if len(gaps):
        middle = np.concatenate([np.arange(free_from[i], free_to[i]) for i in gaps]) + length // 2
        half = np.full(len(middle), length // 2)
        at, low, high = np.concatenate([at, middle]), np.concatenate([low, half]), np.concatenate([high, half])
    return at, low, high


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def dictionary_rows(docs: DataFrame, length: int) -> DataFrame:
    """Every trigger of every document: where, its reach, and the hashes of its core and its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(2))
            for first, last in blocks(offsets, BLOCK):
                base = offsets[first]
                x = np.frombuffer(data, np.uint8, offsets[last] - base, base)
                found = triggers(x)
                hashes = Hashes(x)
                bounds = np.searchsorted(found, np.array(offsets[first : last + 1]) - base)
                parts, rows = [], []
                for i in range(first, last):
                    a = document_anchors(x, offsets[i] - base, offsets[i + 1] - base, found[bounds[i - first] : bounds[i - first + 1]], length)
                    parts.append(a)
                    rows.append(np.full(len(a[0]), i))
                at, low, high = (np.concatenate(c) for c in zip(*parts))
                row = np.concatenate(rows).astype(np.int64)
                if not len(at):
                    continue
                core = hashes.of(at - EDGE, at + EDGE)
                context = mixed(hashes.of(at - high, at - low + length) + (low * 1024 + high).astype(np.uint64))
                begin = np.array(offsets)[row] - base
                yield pa.record_batch(
                    [pa.array(ids[row]), pa.array(hs[row]), pa.array((at - begin).astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _signed(core), _signed(context)],
                    ["id", "h", "at", "low", "high", "core", "context"])

    return docs.mapInArrow(run, ANCHOR)


def context_bytes(wanted: DataFrame, length: int) -> DataFrame:
    """Cut the bytes of listed contexts out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, texts, lists = (c.to_pylist() for c in batch.columns)
            out = []
            for id_, h, text, spans in zip(ids, hs, texts, lists):
                raw = text.encode()
                out += [(id_, h, s["at"], s["low"], s["high"], s["core"], s["once"], raw[s["at"] - s["high"] : s["at"] - s["low"] + length]) for s in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["id", "h", "at", "low", "high", "core", "once", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return wanted.mapInArrow(run, "id bigint, h bigint, at int, low int, high int, core bigint, once boolean, bytes binary")


def suffix_pairs(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Member, distance to the trigger, and the (phrase suffix, parse suffix) pair of every start in the contexts."""
    low, high = table.column("low").to_numpy().astype(np.int64), table.column("high").to_numpy().astype(np.int64)
    data = b"".join(table.column("bytes").to_pylist())
    hashes = Hashes(np.frombuffer(data, np.uint8))
    begin = np.concatenate([[0], np.cumsum(high - low + length)[:-1]])
    count = high - low + 1
    member = np.repeat(np.arange(len(low)), count)
    step = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[member] + step
    trigger = begin[member] + high[member]
    return member, high[member] - step, hashes.of(start, trigger), hashes.of(trigger, start + length)


def _runs(member: np.ndarray, distance: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join starts that follow each other into spans: member, start and end."""
    if not len(member):
        return member, member, member
    start = at[member] - distance
    order = np.lexsort([start, member])
    m, s = member[order], start[order]
    new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[new[1:] - 1, len(m) - 1]
    return m[new], s[new], s[last] + length


def _span_batch(table: pa.Table, member: np.ndarray, distance: np.ndarray, length: int) -> pa.RecordBatch:
    m, s, e = _runs(member, distance, table.column("at").to_numpy().astype(np.int64), length)
    take = lambda c: table.column(c).combine_chunks().take(pa.array(m))
    return pa.RecordBatch.from_arrays([take("id"), take("h"), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["id", "h", "start", "end"])


SPAN = "id bigint, h bigint, start int, end int"


def ordered_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Order the starts of contexts that share a core, group by group, and keep those equal to a neighbour."""

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        member, distance, phrase, parse = suffix_pairs(table, length)
        core = table.column("core").to_numpy()[member]
        order = np.lexsort([parse, phrase, distance, core])
        c, d, f, p = core[order], distance[order], phrase[order], parse[order]
        same = (c[1:] == c[:-1]) & (d[1:] == d[:-1]) & (f[1:] == f[:-1]) & (p[1:] == p[:-1])
        hit = np.r_[same, False] | np.r_[False, same]
        hit &= table.column("once").to_numpy(zero_copy_only=False)[member[order]]
        return _span_batch(table, member[order][hit], distance[order][hit], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cores = table.column("core").to_numpy()
            if held and held[-1].column("core")[-1].as_py() != cores[0] and rows >= 2000:
                yield solve(held)
                held, rows = [], 0
            # The rows come sorted by core; the last group of a batch may go on in the next.
            inner = np.flatnonzero(cores[1:] != cores[:-1]) + 1
            begin = 0
            for cut in inner.tolist():
                if rows + cut - begin >= 2000:
                    yield solve([*held, table.slice(begin, cut - begin)])
                    held, rows, begin = [], 0, cut
            held.append(table.slice(begin))
            rows += len(table) - begin
        if held:
            yield solve(held)

    return contexts.repartition("core").sortWithinPartitions("core").mapInArrow(run, SPAN)


def counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many contexts: pairs are counted across tasks and joined back."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                table = pa.Table.from_batches([batch.slice(at, 1000)])
                member, distance, phrase, parse = suffix_pairs(table, length)
                take = lambda c: table.column(c).combine_chunks().take(pa.array(member))  # noqa: B023, E731
                start = table.column("at").to_numpy().astype(np.int64)[member] - distance
                yield pa.RecordBatch.from_arrays(
                    [take("id"), take("h"), take("core"), take("once"), _signed(phrase), _signed(parse), pa.array(start.astype(np.int32)), pa.array((start + length).astype(np.int32))],
                    names=["id", "h", "core", "once", "phrase", "parse", "start", "end"])

    key = ["core", "phrase", "parse"]
    rows = contexts.mapInArrow(pairs, "id bigint, h bigint, core bigint, once boolean, phrase bigint, parse bigint, start int, end int")
    twice = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n"))
    return rows.filter("once").join(twice, key, "left_semi").select("id", "h", "start", "end")


def repeated_spans(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Spans to remove of ``rows(id, h, t)``; they may overlap."""
    anchors = written(dictionary_rows(rows, length))
    cores = written(anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n"))
    shared = written(anchors.join(cores, "core", "left_semi"))
    one = F.struct("id", "h", "at", "low", "high")
    contexts = written(shared.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")))
    whole = shared.join(contexts.filter("n >= 2").select("core", "context"), ["core", "context"], "left_semi")
    whole = whole.select("id", "h", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    # Only cores with a context found once have borders to order; every context of theirs takes part once.
    sizes = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m >= 2 and least = 1")
    borders = contexts.join(written(sizes.select("core", "m")), "core")
    borders = borders.select("one.*", "core", (F.col("n") == 1).alias("once"), "m")
    lists = borders.groupBy("id", "h").agg(F.collect_list(F.struct("at", "low", "high", "core", "once")).alias("spans"))
    big = written(borders.filter(F.col("m") > group).select("core").distinct())
    found = written(context_bytes(rows.join(lists, ["id", "h"]).select("id", "h", "t", "spans"), length))
    ordered = ordered_spans(found.join(big, "core", "left_anti").select(found.columns), length)
    counted = counted_spans(found.join(big, "core", "left_semi").select(found.columns), length)
    return whole.unionByName(ordered).unionByName(counted)


def text_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id``, ``h`` and ``t``: rows that share id and text are told apart by nothing and share their spans."""
    t = whole_text(text)
    return docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63))).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``spans`` (start, end; merged), and ``kept``, the bytes that remain."""
    rows = text_rows(docs, id_column, text)
    spans = repeated_spans(rows, length, group).groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (c.to_pylist() for c in batch.columns)
            sizes, merged, kept = [], [], []
            for text, found in zip(texts, lists):
                raw = text.encode()
                spans: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append(list(s))
                edges = [0, *[e for s in spans for e in s], len(raw)]
                sizes.append(len(raw))
                merged.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"])

    out = rows.join(spans, ["id", "h"], "left").select("id", "t", "spans").mapInArrow(cut, "id bigint, n_bytes bigint, spans array<struct<start int, end int>>, kept binary")
    return out.withColumnRenamed("id", id_column).withColumn(id_column, F.when(F.col(id_column) != -(2**63), F.col(id_column)))


def removed_bytes(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])

