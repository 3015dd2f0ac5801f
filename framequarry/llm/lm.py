"""Log-bilinear language model trained with noise-contrastive estimation.

The model predicts the next word from the two before: each context position has word vectors of its
own, their sum meets the output vectors in a dot product, plus a bias for each output
(Mnih and Hinton 2007; Mnih and Teh 2012). Outputs are all words seen at least ``least`` times,
however many they are, ``CLASSES`` classes of the rarer words (by the last two bytes), and the end of
a text. A word of a class gets the class's probability times its own smoothed share of the class, so
every text has a normalised probability over all words, seen or not.

Outputs lie in blocks by frequency, each of a size near one over the square root of its outputs' share,
and each block has an output vector and bias too. The probability of an output is that of its block
times its own within the block (Goodman 2001), so a normaliser costs less than two square roots of the
vocabulary; it is taken for each token, in matrix products over the tokens of one block.

Counts cover all training documents. Training passes over all training documents once: every
task refines the model on its own rows and sends the change of the rows of parameters that it touched,
which are averaged by how often each task touched them, so a word of few tasks keeps what they learned.
A start is fitted on a bounded sample of ``warm_rows`` documents first, so that the averaged vectors agree.

Words below ``least`` and beyond the ``head`` most frequent ones do not travel to the tasks: their
counts meet the documents in a join, and no such word is frequent. The model itself does travel:
3 * ``size`` + 1 floats for each word seen ``least`` times, which grows with the corpus.

Defined cases: a null or empty text is the end token alone; without training documents all
counts are 0 and the outputs are even; repeated rows count and score each; a null id is fold 0; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import blocks as row_blocks
from framequarry.llm.base import whole_text, written

END = b""  # the end token among words, which are never empty
CLASSES = 64
NOISE = 64
BATCH = 2048
FLUSH = 400_000
CHUNK = 1 << 18  # tokens scored at a time
SCORES = 38_000  # scores worked on at once: so small a product is taken without packing
STEP = 1 << 13  # rows gathered at once
STRIP = 256  # tokens that meet the noise at once
LOG2_E = np.log2(np.e)
ROWS = 128  # rows of parameters that are averaged together: small, as a task that adds gets thousands of such pieces at once
BLOCK = 4 << 20  # bytes of text whose words are held at once; one longer document is taken whole


class Model(NamedTuple):
    first: np.ndarray  # vectors of the word just before
    second: np.ndarray  # vectors of the word before that
    out: np.ndarray  # of the outputs, then of their blocks
    bias: np.ndarray


class Blocks(NamedTuple):
    """Runs of outputs. The mean number of scores of a normaliser, all blocks and the outputs of one, is least with these sizes."""

    starts: np.ndarray  # first output of each block, and the end
    of: np.ndarray  # block of each output
    shares: np.ndarray


def blocks_of(noise: np.ndarray) -> Blocks:
    run = np.floor(np.cumsum(np.sqrt(noise)))
    first = np.r_[True, run[1:] != run[:-1]]
    starts = np.flatnonzero(first)
    return Blocks(np.r_[starts, len(noise)], np.cumsum(first) - 1, np.add.reduceat(noise, starts))


def classes_of(words: pa.Array) -> np.ndarray:
    """Class of each word, by its last two bytes."""
    ends = pc.binary_slice(words, -2).dictionary_encode()
    of = np.array([crc32(e) % CLASSES for e in ends.dictionary.to_pylist()], np.int64)
    return of[ends.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)


# Bytes that stand in words.
_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def words_of(data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Tokens of rows that lie end to end, lower-cased in A-Z, each row's words and then the end; and the number of tokens of each row."""
    x = np.frombuffer(bytes(data).lower(), np.uint8)
    word = _WORD[x]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    # A row ends a word.
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = word[heads]
    last[heads[1:] - 1] = word[heads[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    places = np.zeros(len(starts) + len(words) + 1, np.int32)
    np.cumsum(np.insert(ends - starts, np.cumsum(words), 0), out=places[1:])
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(x[word])]), words + 1


def token_blocks(column) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The rows in blocks of about ``BLOCK`` bytes: first row, tokens laid end to end, and the number of tokens of each row."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    # Only the text of a block is copied, not that of the batch.
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    for a, b in row_blocks(at.tolist(), BLOCK):
        yield a, *words_of(data[at[a] : at[b]].tobytes(), at[a : b + 1] - at[a])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word BINARY, c BIGINT`` over all documents; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for _, tokens, _ in token_blocks(batch.column(0)):
                found = tokens.value_counts()
                held.append(pa.table([found.field("values"), found.field("counts")], ["word", "n"]))
                rows += len(found)
                if rows > FLUSH:
                    held = [added(held)]
                    rows = len(held[0])
                    if rows > FLUSH // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from added(held).to_batches()
            del held
        pa.default_memory_pool().release_unused()  # the worker lives on

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    return docs.select(whole_text(text).alias("t")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


# ---- the model -----------------------------------------------------------------------------------


def new_model(noise: np.ndarray, size: int, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    n, shares = len(noise), np.concatenate([noise, blocks_of(noise).shares])
    small = lambda n: rng.normal(0, 0.05, (n, size)).astype(np.float32)
    return Model(small(n), small(n), small(len(shares)), np.log(shares).astype(np.float32))


def whole_rows(x: np.ndarray) -> np.ndarray:
    """The rows as one value each, which are moved faster than rows of numbers."""
    return x if x.ndim == 1 else x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


class Trainer:
    """AdaGrad by rows on the noise-contrastive objective, of the outputs and of their blocks; one set of noise serves a whole batch.

    It changes the model it is given, and counts in ``hits`` how often each row was touched.
    """

    def __init__(self, model: Model, noise: np.ndarray, seed: int, rate: float = 0.15):
        self.p = model
        self.seen = Model(*[np.full(len(x), 1e-2, np.float32) for x in model])
        self.hits = [np.zeros(len(x), np.int64) for x in model[:3]]
        self.place = np.empty(len(model.out), np.int32)  # worked on by ``_summed``
        self.n, self.blocks, self.rng, self.rate = len(noise), blocks_of(noise), np.random.default_rng(seed), rate
        self.levels = [(0, np.cumsum(noise)), (self.n, np.cumsum(self.blocks.shares))]
        self.log_noise = np.log(np.concatenate([noise, self.blocks.shares]) * NOISE).astype(np.float32)

    def _summed(self, rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows, and the gradient of each, added up in double precision where a row is repeated."""
        size, low = grad.shape[1], int(rows.min())
        if int(rows.max()) - low < len(rows):  # most of them are repeated
            place = rows - low
            at = np.flatnonzero(np.bincount(place))
            cells = (place * size)[:, None] + np.arange(size)
            return at + low, np.bincount(cells.ravel(), grad.ravel()).reshape(-1, size).take(at, axis=0).astype(np.float32)
        # One of the equal rows stands for all, only the others are added to it.
        k = np.arange(len(rows), dtype=np.int32)
        self.place[rows] = k
        stands = self.place.take(rows)
        alone = stands == k
        first, others = np.flatnonzero(alone), np.flatnonzero(~alone)
        at, g = rows.take(first), grad.take(first, axis=0)
        if len(others):
            to = stands.take(others)
            repeated = np.zeros(len(rows), bool)
            repeated[to] = True
            cells = ((np.cumsum(repeated) - 1).take(to) * size)[:, None] + np.arange(size)
            more = np.bincount(cells.ravel(), grad.take(others, axis=0).ravel()).reshape(-1, size)
            both = np.flatnonzero(repeated.take(first))
            g[both] = g.take(both, axis=0) + more
        return at, g

    def _step(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Add the gradient of repeated rows up, then scale by what each has seen; outputs have that of their bias in the last column."""
        np.add.at(self.hits[which], rows, 1)
        at, g = self._summed(rows, grad)
        size = self.p[which].shape[1]
        for k, g in zip((which, 3), (g[:, :size], g[:, size]) if g.shape[1] > size else (g,)):
            seen = self.seen[k].take(at) + (np.einsum("ij,ij->i", g, g) / size if g.ndim > 1 else g * g)
            self.seen[k][at] = seen
            scale = self.rate / np.sqrt(seen)
            new = self.p[k].take(at, axis=0) + g * (scale[:, None] if g.ndim > 1 else scale)
            whole_rows(self.p[k])[at] = whole_rows(new)

    def batch(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        p, size = self.p, self.p.first.shape[1]
        q = np.ones((len(w), size + 1), np.float32)  # the last column meets the bias
        vector = q[:, :size]
        np.add(p.first.take(c1, axis=0), p.second.take(c2, axis=0), out=vector)
        grad_q, rows, grads = np.zeros((len(w), size), np.float32), [], []
        for (first, cumulated), ids in zip(self.levels, (w, self.n + self.blocks.of.take(w))):
            noise = first + np.minimum(np.searchsorted(cumulated, self.rng.random(NOISE)), len(cumulated) - 1)
            own = p.out.take(ids, axis=0)
            s = np.einsum("ij,ij->i", vector, own) + p.bias.take(ids) - self.log_noise.take(ids)
            up = 1 / (1 + np.exp(np.clip(s, -30, 30)))  # chance that the output is taken for noise
            own *= up[:, None]
            grad_q += own
            grad = np.zeros((len(w) + NOISE, size + 1), np.float32)
            np.multiply(q, up[:, None], out=grad[: len(w)])
            rows.append(np.concatenate([ids, noise]))
            grads.append(grad)
        # The noise of both levels in one product; powers of two are the faster exponentials.
        noise = np.concatenate([x[len(w) :] for x in rows])
        others = p.out.take(noise, axis=0)
        outputs = np.ascontiguousarray(np.column_stack([others, p.bias.take(noise) - self.log_noise.take(noise)]).T) * np.float32(-LOG2_E)
        down = np.zeros((len(noise), size + 1), np.float32)
        with np.errstate(over="ignore"):  # beyond the largest power the chance is 0
            for at in range(0, len(w), STRIP):
                k = slice(at, at + STRIP)
                s = q[k] @ outputs
                np.exp2(s, out=s)
                s += 1
                np.reciprocal(s, out=s)  # chance that noise is taken for the output
                grad_q[k] -= s @ others
                down -= s.T @ q[k]
        for grad, part in zip(grads, np.split(down, 2)):
            grad[len(w) :] = part
        self._step(0, c1, grad_q)
        self._step(1, c2, grad_q)
        for ids, grad in zip(rows, grads):
            self._step(2, ids, grad)

    def train(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over texts laid end to end, in random order. Before a text stand end tokens."""
        end = self.n - 1
        rows = np.empty((len(tokens), 3), np.int32)  # what a token needs lies together
        rows[:, 0], rows[:, 1] = contexts(tokens, lengths, end)
        rows[:, 2] = tokens
        order = self.rng.permutation(len(tokens))
        for at in range(0, len(order), BATCH):
            self.batch(*rows.take(order[at : at + BATCH], axis=0).T.astype(np.intp, order="C"))


def contexts(tokens: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; the start of a text counts as ends."""
    c1 = np.concatenate([[end], tokens[:-1]])
    c2 = np.concatenate([[end, end], tokens[:-2]])[: len(tokens)]
    starts = np.cumsum(lengths) - lengths
    c1[starts] = end
    c2[starts] = end
    second = starts[lengths > 1] + 1
    c2[second] = end
    return c1, c2


class Tables(NamedTuple):
    """Log10 scores of word pairs, and the log10 normaliser of each context, of a small model without blocks: what ``log_probabilities`` gives with one block."""

    first: np.ndarray
    second: np.ndarray
    normal: np.ndarray


def tables(model: Model) -> Tables:
    a = model.first @ model.out.T + model.bias
    b = model.second @ model.out.T
    normal = np.empty((len(a), len(b)), np.float32)
    # exp of a sum is the product of exps, so all normalisers are one matrix product.
    shift_a, shift_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
    ea, eb = np.exp(a - shift_a), np.exp(b - shift_b)
    for at in range(0, len(a), 512):
        normal[at : at + 512] = np.log(ea[at : at + 512] @ eb.T + 1e-30) + shift_a[at : at + 512] + shift_b.T
    ten = np.float32(np.log(10))
    return Tables((a / ten).astype(np.float32), (b / ten).astype(np.float32), normal / ten)


def is_small(model: Model) -> bool:
    """Whether no score of the model can overflow an exponential: by Cauchy-Schwarz none passes this bound."""
    norm = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
    return (norm(model.first) + norm(model.second)) * norm(model.out) + float(np.abs(model.bias).max(initial=0)) < 60


def log_probabilities(model: Model, blocks: Blocks, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, small: bool | None = None) -> np.ndarray:
    """Log10 probability of each output ``w`` after its context: that of its block, then its own within the block.

    ``small`` is ``is_small`` of the model, for a caller who knows it.
    """
    n, size = model.first.shape
    found = np.empty(len(w))
    plain = is_small(model) if small is None else small  # then the largest score need not be taken off

    widest = int(max(np.diff(blocks.starts).max(initial=1), len(model.out) - n))
    room, ones = np.empty(max(SCORES, widest * 16), np.float32), np.ones(widest, np.float32)

    def normalisers(q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Log2 of the sum over the outputs a to b, of each context; the scores worked on at once stay in the cache."""
        outputs = np.ascontiguousarray(np.column_stack([model.out[a:b], model.bias[a:b]]).T) * np.float32(LOG2_E)
        sums, tops = np.empty(len(q), np.float32), np.zeros(len(q), np.float32)
        step = max(16, SCORES // (b - a))
        for i in range(0, len(q), step):
            x = q[i : i + step]
            s = np.matmul(x, outputs, out=room[: len(x) * (b - a)].reshape(-1, b - a))
            if not plain:
                top = tops[i : i + step]
                s.max(axis=1, out=top)
                s -= top[:, None]
            np.exp2(s, out=s)
            np.matmul(s, ones[: b - a], out=sums[i : i + step])
        return np.log2(sums) + tops

    for at in range(0, len(w), CHUNK):
        k = slice(at, at + CHUNK)
        # A normaliser is worked out once for all tokens of the chunk that share it: by the context for the blocks, by the context and the block within it.
        contexts, context = np.unique(c1[k].astype(np.int64) * n + c2[k], return_inverse=True)
        q = np.ones((len(contexts), size + 1), np.float32)  # the last column meets the bias
        for i in range(0, len(q), STEP):
            some = contexts[i : i + STEP]
            np.add(model.first.take(some // n, axis=0), model.second.take(some % n, axis=0), out=q[i : i + STEP, :size])
        normal = normalisers(q, n, len(model.out))
        block = blocks.of.take(w[k])
        keys = block * len(q) + context
        order = np.argsort(keys)  # tokens of a block stand together
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        pairs = keys[new]
        within, rows = np.zeros(len(pairs), np.float32), pairs % len(q)
        cuts = np.flatnonzero(np.r_[True, np.diff(pairs // len(q)) > 0, True]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            first, end = blocks.starts[pairs[a] // len(q) :][:2].tolist()
            if end - first > 1:
                within[a:b] = normalisers(q.take(rows[a:b], axis=0), first, end)
        less = within[np.cumsum(new) - 1] + normal[context[order]]
        alone = np.diff(blocks.starts) == 1  # the only output of its block has no score of its own there
        for i in range(0, len(order), STEP):
            o = order[i : i + STEP]
            out, of = w[k][o], block[o]
            own, bias = model.out.take(out, axis=0), model.bias.take(out)
            own[alone[of]] = 0
            bias[alone[of]] = 0
            own += model.out.take(n + of, axis=0)
            bias += model.bias.take(n + of)
            found[at + o] = (np.einsum("ij,ij->i", q.take(context[o], axis=0)[:, :size], own) + bias) / np.log(10) - less[i : i + STEP] * np.log10(2)
    return found


# ---- words and outputs ---------------------------------------------------------------------------


class Vocabulary(NamedTuple):
    head: pa.Array  # the frequent words, the most frequent first
    outputs: np.ndarray  # output of each of them
    counts: np.ndarray
    ends: int  # training documents
    tokens: int  # N
    distinct: int  # V
    noise: np.ndarray  # smoothed share of each output
    class_totals: np.ndarray  # of the words outside the model's own, plus one each and one for unseen
    words: int  # the model's own words, which are the most frequent ones


def vocabulary(counts: DataFrame, least: int, head: int) -> Vocabulary:
    """What all counts come to, all words seen ``least`` times or more, and rarer ones up to the ``head`` most frequent."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = (F.length("word") > 0) & (F.col("c") >= least)
    top = counts.filter(frequent).select("word", "c").toArrow()
    own = top.num_rows
    top = top.take(pc.sort_indices(top, [("c", "descending"), ("word", "ascending")]))
    if own < head:
        rest = counts.filter((F.length("word") > 0) & ~frequent).orderBy(F.desc("c"), "word").limit(head - own)
        top = pa.concat_tables([top, rest.select("word", "c").toArrow().cast(top.schema)])
    names, c = pa.concat_arrays([pa.array([], pa.binary()), *top.column("word").cast(pa.binary()).chunks]), top.column("c").to_numpy()
    ends = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    group = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(CLASSES)).alias("g")
    per_class = {r.g: (r.n, r.v) for r in counts.filter(F.length("word") > 0).groupBy(group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    totals = np.array([sum(per_class.get(g, (0, 0))) + 1 for g in range(CLASSES)], np.int64)
    of = classes_of(names)
    outputs = np.where(np.arange(len(names)) < own, np.arange(len(names)), own + of).astype(np.int32)
    np.subtract.at(totals, of[:own], c[:own] + 1)
    share = np.ones(own + CLASSES + 1)
    share[:own] += c[:own]
    share[own : own + CLASSES] += totals
    share[-1] += ends
    return Vocabulary(names, outputs, np.asarray(c, np.int64), int(ends), int(sums.n), int(sums.v), share / share.sum(), totals, own)


def output_ids(tokens: pa.Array, lengths: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each token among the frequent words or -1, its output, and which tokens are words without a place."""
    places = pc.fill_null(pc.index_in(tokens, voc.head), -1).to_numpy(zero_copy_only=False)
    out = np.full(len(places), voc.words + CLASSES, np.int32)
    known = places >= 0
    out[known] = voc.outputs[places[known]]
    known[np.cumsum(lengths) - 1] = True  # the ends
    rare = np.flatnonzero(~known)
    out[rare] = voc.words + classes_of(tokens.take(pa.array(rare)))
    return places, out, rare


def train(docs: DataFrame, voc: Vocabulary, shared, text: str = "text", id_column: str = "doc_id", size: int = 24, warm_rows: int = 1000, parts: int = 16) -> Model:
    """Fit on all rows of ``docs``: a start on ``warm_rows`` of them here, then one pass in the tasks, averaged.

    ``shared`` is the broadcast of ``voc``.
    """
    warm = docs.select(F.xxhash64(id_column).alias("h"), F.col(id_column).alias("id"), whole_text(text).alias("t")).orderBy("h", "id", "t").limit(warm_rows).select("t").toArrow()
    rows = [(output_ids(tokens, lengths, voc)[1], lengths) for chunk in warm.column("t").chunks for _, tokens, lengths in token_blocks(chunk)]
    model = new_model(voc.noise, size)
    if not rows:
        return model
    del warm
    trainer = Trainer(model, voc.noise, seed=1)
    for _ in range(2):
        trainer.train(np.concatenate([ids for ids, _ in rows]), np.concatenate([lengths for _, lengths in rows]))
    del trainer, rows
    # The start travels in half precision, and is what it is after that here too.
    for x in model[:3]:
        x[:] = x.astype(np.float16)
    start = docs.sparkSession.sparkContext.broadcast((*(x.astype(np.float16) for x in model[:3]), model.bias))
    # Outputs have their bias in the last column.
    side = lambda p, which, at: p[which][at].astype(np.float32) if which < 2 else np.column_stack([p[2][at].astype(np.float32), p[3][at]])
    kinds = ["side", "part", "at", "hits", "scale", "bias", "change"]

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, voc = None, Vocabulary(*shared.value)
        for batch in batches:
            for _, tokens, lengths in token_blocks(batch.column(0)):
                ids = output_ids(tokens, lengths, voc)[1]
                del tokens
                # The seed follows the rows, so a task that runs again gives the same parameters.
                trainer = trainer or Trainer(Model(*[x.astype(np.float32) for x in start.value]), voc.noise, seed=crc32(ids[: lengths[0]].tobytes()), rate=0.05)
                trainer.train(ids, lengths)
        if trainer:
            span = ROWS * 256
            for which, hits in enumerate(trainer.hits):
                for k in range(0, len(hits), span):
                    at = (k + np.flatnonzero(hits[k : k + span])).astype(np.int32)
                    if len(at):
                        change = side(trainer.p, which, at) - side(start.value, which, at)
                        # A vector travels as bytes of its own scale, a bias as it is.
                        bias, change = change[:, size:], change[:, :size]
                        scale = np.maximum(np.abs(change).max(axis=1), np.float32(1e-30)) / np.float32(127)
                        change = np.rint(change / scale[:, None]).astype(np.int8)
                        counts, place = hits[at].astype(np.uint32), (at % ROWS).astype(np.uint8)
                        cuts = np.flatnonzero(np.r_[True, np.diff(at // ROWS) > 0, True]).tolist()
                        cells = [(which, int(at[i]) // ROWS, *(x[i:j].tobytes() for x in (place, counts, scale, bias, change))) for i, j in zip(cuts, cuts[1:])]
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), *[pa.binary()] * 5))], kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for which, part, at, hits, scale, bias, change in (tuple(c[i].as_py() for c in batch.columns) for i in range(len(batch))):
                at, hits, scale = np.frombuffer(at, np.uint8), np.frombuffer(hits, np.uint32), np.frombuffer(scale, np.float32)
                change = np.frombuffer(change, np.int8).reshape(len(at), -1) * scale[:, None]
                change = np.column_stack([change, np.frombuffer(bias, np.float32).reshape(len(at), -1)])
                if (which, part) not in sums:
                    sums[which, part] = [np.zeros((ROWS, change.shape[1])), np.zeros(ROWS, np.int64)]
                total, n = sums[which, part]
                total[at] += change.astype(float) * hits[:, None]
                n[at] += hits
        for which in range(3):
            parts = sorted(part for side, part in sums if side == which)
            for k in range(0, len(parts), 256):
                some = [(part, *sums[which, part]) for part in parts[k : k + 256]]
                at = np.concatenate([np.flatnonzero(n) + part * ROWS for part, _, n in some]).astype(np.int32)
                mean = np.concatenate([total[n > 0] / n[n > 0, None] for _, total, n in some]).astype(np.float32)
                yield pa.record_batch([pa.array([which], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["side", "at", "change"])

    # A task adds what it gets piece by piece and holds one sum a part, so many tasks need no more memory.
    sent = docs.select(whole_text(text).alias("t")).mapInArrow(refine, "side int, part int, at binary, hits binary, scale binary, bias binary, change binary")
    merged = sent.repartition(max(parts, len(voc.noise) >> 14), "side", "part").mapInArrow(add, "side int, at binary, change binary").toArrow()
    start.destroy()
    for which, at, change in (tuple(c[i].as_py() for c in batch.columns) for batch in merged.to_batches() for i in range(len(batch))):
        at = np.frombuffer(at, np.int32)
        change = np.frombuffer(change, np.float32).reshape(len(at), -1)
        model[which][at] += change[:, :size]
        if which == 2:
            model.bias[at] += change[:, size]
    return model


def score_documents(docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text", least: int = 10, head: int = 1 << 18, size: int = 24, warm_rows: int = 1000) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``training`` says which rows are learned from. Scores are log10 probabilities of the whole text.
    """
    learned = docs.filter(training)
    counts = written(word_counts(learned, text))
    voc = vocabulary(counts, least, head)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(tuple(voc))
    fitted = sc.broadcast(tuple(train(learned, voc, shared, text, id_column, size, warm_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = Vocabulary(*shared.value), Model(*fitted.value)
        end, blocks, small = voc.words + CLASSES, blocks_of(voc.noise), is_small(model)
        log_count = np.log10(voc.counts + 1.0)
        log_class = np.log10(voc.class_totals.astype(float))
        log_end = np.log10(voc.ends + 1.0)
        log_all = np.log10(float(voc.tokens + voc.distinct + 1))
        for batch, (first, tokens, lengths) in ((batch, block) for batch in batches for block in token_blocks(batch.column(2))):
            places, out, rare = output_ids(tokens, lengths, voc)
            ends = np.cumsum(lengths) - 1
            starts = ends + 1 - lengths
            known = places >= 0
            value = np.zeros(len(out))
            value[known] = log_count[places[known]]
            c1, c2 = contexts(out, lengths, end)
            logp = log_probabilities(model, blocks, c1, c2, out, small)
            member = (out >= voc.words) & (out < end)
            # A class word: its class, then its smoothed share; a rare word's own count comes by the join.
            logp[member] += value[member] - log_class[out[member] - voc.words]
            value[ends] = log_end
            base, score = np.add.reduceat(value, starts) - lengths * log_all, np.add.reduceat(logp, starts)
            seen = np.add.reduceat(known.astype(np.int64), starts) + (1 if voc.ends else 0)
            rare_rows = np.bincount(np.searchsorted(ends, rare), minlength=len(lengths))
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare_rows)]).astype(np.int32)), tokens.take(pa.array(rare)))
            ids, training = (batch.column(k).slice(first, len(lengths)) for k in (0, 1))
            yield pa.record_batch([ids, training, pa.array(lengths), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score), tail], ["id", "training", "n_tokens", "n_known", "base", "score", "tail"])

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), training.alias("training"), whole_text(text).alias("t"))
    part = source.mapInArrow(run, f"id {kind}, training boolean, n_tokens bigint, n_known bigint, base double, score double, tail array<binary>")
    # The row number within this written table names a row, whatever its id.
    part = written(part.withColumn("row", F.monotonically_increasing_id()))
    fitted.destroy()
    shared.destroy()
    rare = part.select("row", F.explode("tail").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("known"))
    out = part.drop("tail").join(found, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select(
        F.col("id").alias(id_column), (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(voc.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))

