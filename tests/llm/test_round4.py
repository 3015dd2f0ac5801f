"""Words held in blocks by the language model, and the verdict column of the repeats."""

import collections
import tracemalloc
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from framequarry.llm import lm
from framequarry.llm.queries import QUERIES


def test_lm_holds_words_of_a_block_only(monkeypatch):
    texts = ["One two  two", "", None, "three\tfour " * 20, "x"]
    whole = [(first, tokens.to_pylist(), lengths.tolist()) for first, tokens, lengths in lm.token_blocks(pa.array(texts))]
    assert len(whole) == 1 and whole[0][2] == [4, 1, 1, 41, 2] and whole[0][1][:5] == [b"one", b"two", b"two", b"", b""]
    monkeypatch.setattr(lm, "BLOCK", 16)
    parts = list(lm.token_blocks(pa.array(texts)))
    assert len(parts) > 1 and [p[0] for p in parts] == np.cumsum([0, *[len(p[2]) for p in parts]])[:-1].tolist()
    assert sum((p[1].to_pylist() for p in parts), []) == whole[0][1]


def test_lm_outputs_by_word():
    words = [b"the", b"of", b"x", b"unseen", b"", b"y", b""]
    head = pa.array([b"the", b"of", b"x"], pa.binary())
    own = 2
    outputs = np.array([0, 1, own + crc32(b"x") % lm.CLASSES], np.int32)
    voc = lm.Vocabulary(head, outputs, np.array([9, 8, 1]), 1, 19, 4, np.ones(own + lm.CLASSES + 1), np.ones(lm.CLASSES), own)
    places, out, rare = lm.output_ids(pa.array(words, pa.binary()), np.array([5, 2]), voc)
    end = own + lm.CLASSES
    assert places.tolist() == [0, 1, 2, -1, -1, -1, -1] and rare.tolist() == [3, 5]
    assert out.tolist() == [0, 1, outputs[2], own + crc32(b"en") % lm.CLASSES, end, own + crc32(b"y") % lm.CLASSES, end]


def test_op5_says_which_documents_stay_whole(spark, tmp_path):
    rnd = np.random.default_rng(3)
    text = lambda: " ".join("".join(map(chr, rnd.integers(97, 123, 7))) for _ in range(90))
    passage = text()
    rows = [(1, f"{text()} {passage} {text()}"), (2, f"{passage} {text()}"), (3, text()), (4, "short"), (5, None), (6, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.kept, r.n_removed) for r in QUERIES["op5_repeats"](spark, str(tmp_path)).collect()}
    assert {i: kept for i, (kept, _) in got.items()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    assert all(kept == (n == 0) for kept, n in got.values())


def test_lm_words_are_cut_without_a_list():
    """Before, every word was a Python object of its own."""
    rnd = np.random.default_rng(11)
    rows = ["".join(map(chr, rnd.choice([32, 9, 10, 11, 13, 65, 90, 97, 0, 28, 133, 160, 233, 8232, 128512], rnd.integers(0, 12)))) for _ in range(400)] + ["", "A", "b"]
    offsets = np.cumsum([0, *[len(t.encode()) for t in rows]])
    tokens, lengths = lm.words_of("".join(rows).encode(), offsets)
    want = [[*t.encode().lower().split(), lm.END] for t in rows]
    assert tokens.to_pylist() == sum(want, []) and lengths.tolist() == [len(r) for r in want]
    tokens, lengths = lm.words_of(b"", np.zeros(3, np.int64))
    assert tokens.to_pylist() == [b"", b""] and lengths.tolist() == [1, 1]


def test_lm_step_adds_up_the_gradient_of_repeated_rows():
    rnd = np.random.default_rng(2)
    noise = np.full(50, 0.02)
    trainer = lm.Trainer(lm.new_model(noise, 4), noise, 1)
    rows, grad = rnd.integers(0, 50, 300), rnd.normal(size=(300, 4)).astype(np.float32)
    want = trainer.p.first.astype(float)
    for row in range(50):
        g = grad[rows == row].astype(float).sum(axis=0)
        if (rows == row).any():
            want[row] += g * 0.15 / np.sqrt(1e-2 + (g * g).sum() / 4)
    trainer._step(0, rows, grad)
    assert np.allclose(trainer.p.first, want, atol=1e-5) and (trainer.hits[0] == np.bincount(rows, minlength=50)).all()


def test_lm_works_a_normaliser_out_once(monkeypatch):
    """Before, every token had its own, also where context and block were those of another one."""
    rnd = np.random.default_rng(5)
    share = rnd.random(300)
    blocks = lm.blocks_of(share / share.sum())
    model = lm.Model(*[rnd.normal(0, 1, (n, 4)).astype(np.float32) for n in (300, 300, 300 + len(blocks.shares))], rnd.normal(0, 1, 300 + len(blocks.shares)).astype(np.float32))
    c1, c2, w = (rnd.integers(0, n, 20_000) for n in (5, 4, 300))
    done = []
    for name in ("exp", "exp2"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **k: done.append(np.size(x)) or f(x, *a, **k))
    got = lm.log_probabilities(model, blocks, c1, c2, w)
    assert sum(done) <= 20 * (300 + len(blocks.shares))
    for i in range(0, 20_000, 997):  # one context at a time, all outputs
        alone = lm.log_probabilities(model, blocks, np.full(300, c1[i]), np.full(300, c2[i]), np.arange(300))
        assert (10.0**alone).sum() == pytest.approx(1, abs=1e-4) and got[i] == pytest.approx(alone[w[i]], abs=1e-4)
    large = lm.Model(model.first * 40, model.second * 40, model.out * 40, model.bias)
    assert not lm.is_small(large)
    s = (large.first[1] + large.second[2]).astype(float) @ large.out.astype(float).T + large.bias
    for i, (a, b) in enumerate(zip(blocks.starts[:-1], blocks.starts[1:])):
        want = s[300 + i] - np.logaddexp.reduce(s[300:]) + s[a:b] - np.logaddexp.reduce(s[a:b])
        assert lm.log_probabilities(large, blocks, np.full(b - a, 1), np.full(b - a, 2), np.arange(a, b)) == pytest.approx(want / np.log(10), rel=1e-3, abs=1e-2)


def test_lm_step_adds_up_few_repeats_among_many_rows():
    rnd = np.random.default_rng(4)
    noise = np.full(5000, 1 / 5000)
    trainer = lm.Trainer(lm.new_model(noise, 4), noise, 1)
    rows, grad = np.concatenate([rnd.integers(0, 5000, 200), [7, 4999, 7, 7, 0]]), rnd.normal(size=(205, 5)).astype(np.float32)
    want, bias = trainer.p.out.astype(float), trainer.p.bias.astype(float)
    for row in np.unique(rows):
        g = grad[rows == row].astype(float).sum(axis=0)
        want[row] += g[:4] * 0.15 / np.sqrt(1e-2 + (g[:4] ** 2).sum() / 4)
        bias[row] += g[4] * 0.15 / np.sqrt(1e-2 + g[4] ** 2)
    trainer._step(2, rows, grad)
    assert np.allclose(trainer.p.out, want, atol=1e-5) and np.allclose(trainer.p.bias, bias, atol=1e-5)
    assert (trainer.hits[2] == np.bincount(rows, minlength=len(trainer.p.out))).all()


def test_lm_counts_words_that_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 3)
    monkeypatch.setattr(lm, "BLOCK", 16)
    rnd = np.random.default_rng(6)
    rows = [" ".join(f"w{k}" for k in rnd.integers(0, 30, rnd.integers(0, 12))) for _ in range(200)] + [None, "", "W1 w1"]
    want = collections.Counter(w for t in rows for w in [*(t or "").lower().encode().split(), lm.END])
    got = lm.word_counts(spark.createDataFrame([(t,) for t in rows], "text string").coalesce(2)).collect()
    assert {bytes(r.word): r.c for r in got} == want


def test_lm_copies_the_text_of_a_block_only(monkeypatch):
    """Before, the text of a whole batch was copied for its blocks."""
    monkeypatch.setattr(lm, "BLOCK", 1 << 16)
    column = pa.array([None, "first"] + ["some words " * 100] * 20_000).slice(1)
    tracemalloc.start()
    rows = [(first, lengths.sum()) for first, _, lengths in lm.token_blocks(column)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in rows) == 2 + 20_000 * 201 and rows[0][0] == 0
    assert most < 8 << 20 < column.nbytes
    assert not list(lm.token_blocks(pa.array([], pa.string()))) and len(list(lm.token_blocks(pa.array([None], pa.string())))) == 1
