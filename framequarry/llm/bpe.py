"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts into chunks at places that depend on the bytes around them
only, so a passage that many documents share falls into the same chunks everywhere. A chunk is
encoded once per worker and found again by its bytes. A cut may fall inside a word; the join of two
chunks is repaired by taking the open end of one and the open start of the next, up to the white
space on either side and over as many chunks as it takes, and encoding that stretch anew. White
space ends every piece the tokenizer looks at, so the result agrees exactly with encoding the whole
text. Inside a chunk the pieces between white space are reused in the same way.

This holds for tokenizers whose pieces never span ASCII white space and that drop it; ``reusable``
checks it. For others the whole text is encoded.

Defined cases: a null or empty text has no ids and decodes to an empty text; a text without white
space is one stretch, however long; repeated rows are encoded alike; an empty table gives an empty
result; extra columns are ignored by ``encode`` and ``decode``, and one to keep that has the name of a column
of the result is refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import blocks, buffers, whole_text

WINDOW = 16
BLOCK = 2 << 20  # bytes worked on at once; one longer text is taken whole
ROWS = 500  # texts joined from their ids at once
CHUNK_BITS = 9  # a chunk has 2 ** CHUNK_BITS bytes on average
PIECES = 40 << 20  # most bytes of pieces and
CHUNKS = 24 << 20  # of chunks that a worker keeps; beyond it the later half goes, as common ones come early
ENTRY = 200  # bytes of an entry beside its own
LONGEST = 1 << 16  # a longer piece is encoded each time
SPACES = b" \t\n\r\x0b\x0c"


def load(config: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(config)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def reusable(tokenizer) -> bool:
    """Whether pieces between ASCII white space can be encoded apart: tested on joins of every kind."""
    samples = ["a", "A1", "don't", "é", "é", "́", "...", "<|endoftext|>", "日本", " ", "Σ", "'s", "12"]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return all(ids(x + s + y) == ids(x) + ids(y) for x in samples for y in samples for s in (" ", "\n", "\t \x0b\x0c\r"))


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places where the hash of the ``WINDOW`` bytes before has ``bits`` zero bits."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    x = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    x ^= x >> np.uint32(15)
    span = 1
    mix = np.uint32(0x85EBCA6B)
    while span < WINDOW:  # doubling: the hash of 2n bytes from those of its halves
        x = x[:-span] * mix + x[span:]
        mix = np.uint32(int(mix) * int(mix) * 5 % 2**32 | 1)
        span *= 2
    x ^= x >> np.uint32(16)
    x *= np.uint32(0xC2B2AE35)
    return np.flatnonzero(x >> np.uint32(32 - bits) == 0) + WINDOW


class Kept(dict):
    """What a worker keeps, bounded in bytes."""

    def __init__(self, most: int):
        self.most, self.size = most, 0

    def keep(self, key: bytes, value: object, size: int) -> None:
        self.size += len(key) + size + ENTRY
        self[key] = value

    def trim(self) -> None:
        if self.size > self.most:
            share = len(self) // 2
            for key in [k for i, (k, v) in enumerate(self.items()) if i >= share or len(k) > LONGEST]:
                del self[key]
            # Entries are alike, so the earlier half is taken for half of the bytes.
            self.size //= 2


class Encoder:
    """Encodes batches; keeps the ids of pieces and of chunk middles, as bytes of 32-bit numbers."""

    def __init__(self, config: str):
        self.tokenizer = load(config)
        self.whole = not reusable(self.tokenizer)
        self.pieces, self.chunks = Kept(PIECES), Kept(CHUNKS)

    def _learn(self, pieces: set[bytes]) -> None:
        new = list(pieces.difference(self.pieces))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            for p, e in zip(part, found, strict=True):
                ids = array("i", e.ids).tobytes()
                self.pieces.keep(p, ids, len(ids))

    @staticmethod
    def _split(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """Open start, pieces inside, open end; None if there is no white space."""
        parts = chunk.split()
        if not parts:
            return b"", [], b""
        head = b"" if chunk[0] in SPACES else parts.pop(0)
        if not parts and len(head) == len(chunk):
            return None
        tail = b"" if chunk[-1] in SPACES or not parts else parts.pop()
        return head, parts, tail

    def encode(self, data: bytes, offsets: list[int]) -> list[bytes]:
        """Ids of each row of a batch."""
        if self.whole:
            texts = [data[a:b].decode() for a, b in zip(offsets, offsets[1:])]
            return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.pieces.trim()
        self.chunks.trim()
        cuts = np.unique(np.concatenate([cut_points(data), np.array(offsets, np.int64)])).tolist()
        pieces, new, needed, rows = self.pieces, {}, set(), []
        at = 0
        for start, end in zip(offsets, offsets[1:]):
            row = []
            while at + 1 < len(cuts) and cuts[at] < end:
                chunk = data[cuts[at] : cuts[at + 1]]
                row.append(chunk)
                if chunk not in self.chunks and chunk not in new:
                    new[chunk] = found = self._split(chunk)
                    if found:
                        needed.update(found[1])
                at += 1
            rows.append(row)
        self._learn(needed)
        for chunk, found in new.items():
            middle = b"".join([pieces[p] for p in found[1]]) if found else b""
            self.chunks.keep(chunk, found and (found[0], middle, found[2]), len(middle))
        plans, joins = [], set()
        for row in rows:
            plan, carry = [], b""
            for chunk in row:
                found = self.chunks[chunk]
                if found is None:
                    carry += chunk
                    continue
                head, middle, tail = found
                if carry or head:
                    plan.append((True, carry + head))
                    joins.add(carry + head)
                plan.append((False, middle))
                carry = tail
            if carry:
                plan.append((True, carry))
                joins.add(carry)
            plans.append(plan)
        self._learn(joins)
        return [b"".join([pieces[x] if joined else x for joined, x in plan]) for plan in plans]


def encoder(shared: dict) -> Encoder:
    """The encoder of this worker, kept beside the broadcast: later tasks find what earlier ones have learned."""
    if "encoder" not in shared:
        shared["encoder"] = Encoder(shared["config"])
    return shared["encoder"]


def _refuse_clashes(names: list[str]) -> None:
    if len(set(names)) < len(names):
        raise ValueError(f"columns to keep clash with others of the result: {sorted(n for n in set(names) if names.count(n) > 1)}")


def encoded_blocks(work: Encoder, texts: pa.Array) -> Iterator[list[bytes]]:
    """Ids of the rows of a batch, about ``BLOCK`` bytes of text at once."""
    data, offsets = buffers(texts)
    for first, last in blocks(offsets, BLOCK):
        at = offsets[first]
        yield work.encode(data[at : offsets[last]], [o - at for o in offsets[first : last + 1]])


def listed(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def encode(docs: DataFrame, config: str, id_column: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """One row per document: id, the columns of ``keep``, and ``ids``, the token ids of its whole text.

    ``config`` is the tokenizer's JSON; it is shared with the executors once, a few megabytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"config": config})
    _refuse_clashes([id_column, *keep, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(shared.value)
        for batch in batches:
            column = pa.concat_arrays([listed(ids) for ids in encoded_blocks(work, batch.column(batch.num_columns - 1))] or [listed([])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "ids"])

    rows = docs.select(F.col(id_column), *keep, whole_text(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, ids array<int>")


def joined(ids: pa.ListArray, words: pa.Array) -> pa.Array:
    """The word of each id, joined by one space, row by row; no word ends in a space."""
    taken = words.take(ids.flatten())
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64, len(taken) + 1)
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = ends[np.concatenate([[0], np.cumsum(lengths)])]
    spaced = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(rows.tobytes()), data])
    return pc.utf8_rtrim(spaced, " ")


def spaced_words(words: list[str]) -> pa.Array:
    return pa.array([w + " " for w in words], pa.large_string())


class Decoder:
    """The text of each row of ids, special tokens included."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        # Without a decoder the library joins the tokens by one space.
        self.words = spaced_words(tokens) if tokenizer.decoder is None and not any(t.endswith(" ") for t in tokens) else None

    def decode(self, ids: pa.ListArray) -> pa.Array:
        if self.words is not None:
            return joined(ids, self.words)
        return pa.array(self.tokenizer.decode_batch([row or [] for row in ids.to_pylist()], skip_special_tokens=False), pa.large_string())


def digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist()]


def round_trip(docs: DataFrame, config: str, id_column: str = "doc_id", text: str = "text", keep: list[str] = (), with_ids: bool = False) -> DataFrame:
    """One row per document: id, the columns of ``keep``, ``n_tokens``, and the SHA-256 digests ``ids_sha256`` and ``decoded_sha256`` of its decimal ids joined by one space and of the text they decode to.

    Text is encoded and decoded again in one pass, about ``BLOCK`` bytes at once, so neither ids nor decoded
    texts travel between processes, but for the column ``ids`` if it is asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"config": config})
    extra = ["ids"] if with_ids else []
    names = [id_column, *keep, "n_tokens", "ids_sha256", "decoded_sha256", *extra]
    _refuse_clashes(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(shared.value)
        if "decoder" not in shared.value:
            shared.value["decoder"] = Decoder(work.tokenizer)
            shared.value["numbers"] = spaced_words([str(i) for i in range(work.tokenizer.get_vocab_size())])
        decoder, numbers = shared.value["decoder"], shared.value["numbers"]
        for batch in batches:
            first = 0
            for ids in encoded_blocks(work, batch.column(batch.num_columns - 1)):
                column = listed(ids)
                rows = batch.slice(first, len(ids))
                first += len(ids)
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests(joined(column, numbers)), pa.string()), pa.array(digests(decoder.decode(column)), pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made, *([column] if with_ids else [])], names=names)

    rows = docs.select(F.col(id_column), *keep, whole_text(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, config: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for, special tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast({"config": config})

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = Decoder(load(shared.value["config"]))
        for batch in batches:
            yield pa.concat_arrays([work.decode(batch.slice(at, ROWS)).cast(pa.string()) for at in range(0, len(batch), ROWS)])

    return encoded.withColumn(into, run(F.col(ids)))


def id_digest(ids: str, vocabulary: int) -> Column:
    """SHA-256 in hexadecimal of the decimal ids joined by one space."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = spaced_words([str(i) for i in range(vocabulary)])
        for batch in batches:
            parts = (joined(batch.slice(at, ROWS), words) for at in range(0, len(batch), ROWS))
            yield pa.array([d for part in parts for d in digests(part)], pa.string())

    return run(F.col(ids))
