"""Each operator against brute force or the library it must agree with, and on the awkward cases."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from framequarry.llm import bpe, exact, lm, mixing, near, quality, queries, repeats, rules, toxicity, urls
from framequarry.llm.base import fold

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int, t string, sha string, label int"
WIDE = lambda rows: [(i, t, "en", s, len(t or ""), "x", 1, "y", "z", 2) for i, t, s in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997} the" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, long, "b"), (5, long, "b"), (None, "no id here", "a"), (None, "no id here", None), (6, "The Cat", "c"), (7, "the cat", "c"), (8, "one", "c")]
    return spark.createDataFrame(WIDE(rows) + [(9,) + (None,) * 9], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert check.rows(got) == check.rows(want)


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


# ---- 1 quality ----


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op1(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "quality").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93


def test_quality_awkward(spark, awkward, empty, labels):
    model = quality.train(awkward, labels)
    got = rows_of(awkward.select("doc_id", quality.quality_score(model)))
    assert len(got) == awkward.count() and all(0 <= s <= 1 for _, s in got)
    assert quality.train(empty, labels).weights[-1] == 0
    assert rows_of(empty.select(quality.quality_score(model))) == []


# ---- 2 BPE ----


def test_bpe_agrees_with_the_library(spark):
    config = queries.tokenizer_json()
    work, t = bpe.Encoder(config), bpe.load(config)
    assert not work.whole
    rnd = random.Random(3)
    letters = [*"aAé ́ \n\t'stre.,<|>1Σß日\u0085 ", "<|endoftext|>", " word", "  "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 4000 if i % 40 == 0 else 80))) for i in range(800)] + ["a" * 9000, "", " ", "日本" * 3000]
    data, offsets = bpe.buffers(pa.array(texts))
    got = [np.frombuffer(x, np.int32).tolist() for x in work.encode(data, offsets)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    ids = pa.array([*got, None], pa.list_(pa.int32()))
    words = bpe.spaced_words([t.id_to_token(i) for i in range(t.get_vocab_size())])
    assert bpe.joined(ids, words).to_pylist()[:-1] == t.decode_batch(got, skip_special_tokens=False)


def test_bpe_whole_texts_where_pieces_do_not_split():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        work = bpe.Encoder(f.read())
    assert work.whole
    data, offsets = bpe.buffers(pa.array(["a b", ""]))
    assert np.frombuffer(work.encode(data, offsets)[0], np.int32).tolist() == work.tokenizer.encode("a b").ids


def test_bpe_awkward(awkward, empty):
    config = queries.tokenizer_json()
    out = bpe.decode(bpe.encode(awkward, config), config)
    t = bpe.load(config)
    texts = {(i, x or "") for i, x in rows_of(awkward.select("doc_id", "text"))}
    assert collections.Counter((i, tuple(ids), d) for i, ids, d in rows_of(out)).keys() == {(i, tuple(t.encode(x).ids), t.decode(t.encode(x).ids)) for i, x in texts}
    size = t.get_vocab_size()
    want = {hashlib.sha256(" ".join(map(str, t.encode(x).ids)).encode()).hexdigest() for _, x in texts}
    assert {r[0] for r in rows_of(out.select(bpe.id_digest("ids", size)))} == want
    assert rows_of(bpe.decode(bpe.encode(empty, config), config)) == []
    trip = rows_of(bpe.round_trip(awkward, config, with_ids=True))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(trip) == awkward.count()
    assert {(i, tuple(ids)) for i, _, _, _, ids in trip} == {(i, tuple(t.encode(x).ids)) for i, x in texts}
    assert all((n, a, b) == (len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))) for _, n, a, b, ids in trip)
    assert rows_of(bpe.round_trip(empty, config)) == []
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(awkward.withColumn("ids", F.lit(1)), config, keep=["ids"])


def test_bpe_small_memory_agrees():
    config = queries.tokenizer_json()
    work = bpe.Encoder(config)
    work.pieces, work.chunks = bpe.Kept(5000), bpe.Kept(5000)
    rnd = random.Random(5)
    for k in range(6):
        texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(200)) for _ in range(20)] + ["x" * (bpe.LONGEST + k) + " y"]
        data, offsets = bpe.buffers(pa.array(texts))
        assert [np.frombuffer(x, np.int32).tolist() for x in work.encode(data, offsets)] == [e.ids for e in work.tokenizer.encode_batch(texts)]
        work.pieces.trim()
        assert work.pieces.size <= 5000 + work.pieces.most or len(work.pieces) < 500


# ---- 3 rules ----


def test_rules_measures(spark, awkward, empty):
    text = "a b c a b c\nx # y\nx # y\n \n!!"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = rules.quality_rules(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_marks, r.n_lines) == (13, 14, 2, 1, 12, 2, 4)
    out = {(r.doc_id, r.n_words): r for r in rules.quality_rules(awkward).collect()}
    assert out[1, 0].base_failed and not out[1, 0].kept and out[4, 60_000].n_repeat_words == 60_000
    assert rules.quality_rules(awkward).filter("not kept").count() == awkward.count()
    assert rules.quality_rules(empty).count() == 0


def test_rules_run_no_python(awkward):
    plan = rules.quality_rules(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# ---- 4 language model ----


def test_lm_base_score_and_gain(spark, small):
    out = lm.score_documents(small, fold("doc_id", 7) != 2, head=500).toPandas().set_index("doc_id")
    texts = dict(rows_of(small.select("doc_id", "text")))
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, row in tokens.items() if not held[i] for w in row)
    n, v = sum(c.values()), len(c)
    for i, row in tokens.items():
        r = out.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(row), sum(w in c for w in row), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in row))
    assert out.score.sum() > out.base_score.sum()


def test_lm_outputs_sum_to_one():
    rng = np.random.default_rng(0)
    model = lm.Model(*[rng.normal(0, 1, (30, 4)).astype(np.float32) for _ in range(3)], rng.normal(0, 1, 30).astype(np.float32))
    t = lm.tables(model)
    p = 10.0 ** (t.first[3] + t.second[5] - t.normal[3, 5])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_lm_blocks_sum_to_one():
    rng = np.random.default_rng(1)
    share = rng.random(200)
    for blocks in (lm.blocks_of(share / share.sum()), lm.Blocks(np.array([0, 200]), np.zeros(200, int), np.ones(1))):
        model = lm.Model(*[rng.normal(0, 1, (n, 4)).astype(np.float32) for n in (200, 200, 200 + len(blocks.shares))], rng.normal(0, 1, 200 + len(blocks.shares)).astype(np.float32))
        got = lm.log_probabilities(model, blocks, np.full(200, 3), np.full(200, 5), np.arange(200))
        assert (10.0 ** got).sum() == pytest.approx(1, abs=1e-4)
    t = lm.tables(lm.Model(model.first, model.second, model.out[:200], model.bias[:200]))
    assert got == pytest.approx(t.first[3] + t.second[5] - t.normal[3, 5], abs=1e-4)


def test_lm_models_every_frequent_word(spark):
    """Words of one class beyond the 1024 commonest have their own chances after a context."""
    pairs = [f"a{i:04d}xx b{i:04d}xx" for i in range(1500)]
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.sample(pairs, 30))) for i in range(1500)]
    rows += [(10_000 + i, p) for i, p in enumerate(pairs)] + [(20_000 + i, f"{p[:7]} {q[8:]}") for i, (p, q) in enumerate(zip(pairs, pairs[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = {r.doc_id: r.score for r in lm.score_documents(docs, F.col("doc_id") < 10_000).collect()}
    assert np.mean([s[10_000 + i] - s[20_000 + i] for i in range(1499)]) > 0.3


def test_lm_awkward(awkward, empty):
    out = lm.score_documents(awkward, fold("doc_id", 7) != 2).collect()
    assert len(out) == awkward.count() and all(r.score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_documents(empty, fold("doc_id", 7) != 2).count() == 0
    none = lm.score_documents(awkward, F.lit(False)).filter("doc_id = 1").first()
    assert none.train_tokens == 0 and none.base_score == 0


# ---- 5 repeats ----


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((len(r), sum(cover), bytes(b for b, c in zip(r, cover) if not c)))
    return out


@pytest.mark.parametrize("group", [8192, 3])
def test_repeats_against_brute_force(spark, group):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh éß") for _ in range(2500))
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randint(1, 5)):
            k = rnd.random()
            s = rnd.randint(0, 2000)
            t += base[s : s + rnd.randint(350, 600)] if k < 0.5 else "".join(rnd.choice("xyz ") for _ in range(rnd.randint(1, 300))) if k < 0.7 else "a" * rnd.randint(300, 900) if k < 0.85 else "abc" * rnd.randint(100, 300)
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept)) for r in repeats.remove_repeats(docs, group=group).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats([t for _, t in rows], 400)


def test_repeats_awkward(awkward, empty):
    out = repeats.remove_repeats(awkward).collect()
    assert len(out) == awkward.count()
    assert all(bytes(r.kept) == b"" for r in out if r.doc_id in (4, 5))
    assert repeats.remove_repeats(empty).count() == 0


# ---- 6 mixing ----


def test_mixing_meets_targets(small):
    a, b = [sorted(rows_of(mixing.mix(small.repartition(n), [5, 2, 1])), key=str) for n in (3, 5)]
    assert a == b
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for _, size, total, target, times, source in a:
        by[source][0] += size * times
        by[source][1] = target
        by[source][2] = max(by[source][2], size)
        assert 0 <= times <= 3 and target <= 3 * total
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(r[1] for r in a))
    assert all(abs(taken - target) <= most for taken, target, most in by.values())


def test_water_filling_caps_and_shares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, [5, 2, 1], 3).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(120), None: pytest.approx(60)}


def test_mixing_awkward(awkward, empty):
    out = mixing.mix(awkward, [5, 2, 1]).collect()
    assert len(out) == awkward.count() and {r.size for r in out if r.doc_id in (1, 2, 3, 9)} == {0}
    assert mixing.mix(empty, [1]).count() == mixing.take(empty, [1]).count() == 0
    assert mixing.take(awkward, [5, 2, 1]).columns == awkward.columns
    with pytest.raises(ValueError, match="target"):
        mixing.mix(awkward.withColumn("target", F.lit(1)), [1], keep=["target"])


@pytest.mark.parametrize("repeated", [False, True])
def test_mixing_takes_what_the_mix_says(spark, repeated):
    """Whole rows by one cut per source; with one id in all rows no cut tells them apart, and rows are ordered instead."""
    rows = [(7 if repeated else k % 97, "w " * (3 if repeated else k % 11), None if k % 5 == 0 else "ab"[k % 2], k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    out = mixing.take(docs, [5, 2, 1])
    assert out.columns == docs.columns
    mixed = mixing.mix(docs, [5, 2, 1]).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("n")).collect()
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert {r.source: r.n for r in mixed if r.n} == {s: n for s, n in got.items() if n}
    if not repeated:
        want = collections.Counter()
        for i, t, s, n in mixing.mix(docs.withColumn("x", F.struct("doc_id", "text", "source")), [5, 2, 1], keep=["x"]).select("x.doc_id", "x.text", "x.source", "times").collect():
            want[i, t, s] += n
        assert collections.Counter((r[0], r[1], r[2]) for r in out.collect()) == +want


# ---- 7 exact ----


def test_exact_awkward(awkward, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_classes(awkward).collect()}
    assert {(1, 9, 3, False), (2, 9, 3, False), (9, 9, 3, True), (4, 5, 3, False), (5, 5, 3, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (3, 3, 1, True)} <= got
    left = exact.deduplicate(awkward)
    assert left.columns == awkward.columns
    assert sorted(rows_of(left.select("doc_id")), key=str) == sorted([(9,), (3,), (5,), (7,), (8,), (None,)], key=str)
    assert exact.exact_classes(empty).count() == exact.deduplicate(empty).count() == 0


def test_exact_holds_when_the_filter_is_full(small):
    a, b = [sorted(rows_of(exact.exact_classes(small, max_bits=m))) for m in (64, 1 << 28)]
    assert a == b


# ---- 8 toxicity ----


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op8(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter(fold("doc_id", 4) == 2).toPandas()
    assert (~out.kept[out.toxic == 1]).mean() > 0.85 and out.kept[out.toxic == 0].mean() > 0.98
    assert out.severity.between(0, 3).all()


def test_thresholds_are_ordered_and_chances_sum_to_one():
    rows = [("nice day here", 0), ("fine words", 0), ("bad scum", 1), ("vile scum scum", 1)] * 20
    model = toxicity.fit(rows, {0: 40, 1: 40})
    assert (np.diff(model.thresholds) > 0).all()
    p = toxicity.grade_chances(np.array([-5.0, 0.0, 5.0]), model.thresholds)
    assert p.sum(axis=1) == pytest.approx(1) and (p >= 0).all()


def test_toxicity_awkward(awkward, empty, labels):
    for model in (toxicity.train(awkward, labels), toxicity.train(empty, labels)):
        assert toxicity.grade_documents(awkward, model).count() == awkward.count()
        assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
        assert toxicity.grade_documents(empty, model).count() == 0


# ---- 9 URLs ----


def test_url_parts_rules_and_model(spark):
    cases = {
        "https://Blog.Example.ORG/es/x?y#z": ("blog.example.org", "/es/x", "example.org/es/", "block"),
        "http://a.org/q": ("a.org", "/q", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://www.example.org/en/12": ("www.example.org", "/en/12", "example.org/en/1", "block"),
        "http://myexample.org/en/12": ("myexample.org", "/en/12", "org/", "allow"),
        "x://b.com/de/1": ("b.com", "/de/1", "com/de/", "block"),
        "x://b.com/fr/1://c": ("b.com", "/fr/1://c", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "https://m.ads-track.example.net/en/5": ("m.ads-track.example.net", "/en/5", None, "block"),
        "https://garden.example.net/en/5": ("garden.example.net", "/en/5", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, queries.URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert not urls.train([]).any()


def test_urls_of_unseen_labels_are_judged_by_their_parts():
    """No label below stands in the table; prefixes alone decide nothing, and one kind of label gives 0.5 to all."""
    weights = urls.with_share(urls.train(urls.split_labelled(urls.LABELLED_URLS)), urls.LABELLED_URLS, urls.SHARE)

    def score(host):
        place, value = urls.features(host, "/x/5")
        return weights[place] @ value + weights[-1]

    assert all(score(h) > 0 for h in ("www.casino-night.example.net", "blog.adult-zone.example.org", "m.ads-delivery.example.com"))
    assert all(score(f"{p}quietriver.example.net") < 0 for p in ("", "www.", "m.", "blog."))
    assert not urls.with_share(urls.train([]), [], 0.1).any()


# ---- 10 near duplicates ----


def brute_near(rows, n):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_against_brute_force(spark, n):
    rnd = random.Random(7)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstu")
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 12)):
            w = [x if rnd.random() > 0.02 else word() for x in base]
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, " ")]
    rnd.shuffle(rows)
    got = {r[0]: r[1:] for r in rows_of(near.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), n))}
    assert got == brute_near(rows, n)


def test_near_second_round_misses_less_than_the_forest():
    """Of pairs at the threshold fewer are dropped by signature than share no region."""
    n, p = near.TREES * near.DEPTH, 0.8 + 0.2 / 256  # low bytes also agree by chance
    region = np.zeros(near.TREES, np.int32)

    def meet(agreeing):
        rows = [(k, 0, k, 100, bytes([k] * (n - agreeing) + [9] * agreeing), region) for k in (0, 1)]
        return len(near.Cell((0, 0, 1, 0, 0), rows, 80).meeting()) == 2

    least = next(k for k in range(n + 1) if meet(k))
    dropped = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
    assert dropped < (1 - 0.8**near.LEAST) ** near.TREES


def test_near_awkward(awkward, empty):
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near.near_classes(awkward, 4).collect()}
    assert out[1, 0] == (1, True) and out[3, 0] == (3, True) and out[7, 1] == (6, False) and out[None, 1] == (None, True)
    assert [v for (i, _), v in out.items() if i == 5] == [(4, False)]
    left = near.drop_near(awkward)
    assert left.columns == awkward.columns and left.filter("doc_id = 5").count() == 0 and left.filter("doc_id is null").count() == 2
    assert near.near_classes(empty).count() == near.drop_near(empty).count() == 0


# ---- the pipeline ----


def test_pipeline_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = small
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "near dedup":
            assert after == {i for i, r in brute_near(rows_of(docs.select("doc_id", "text")), 5).items() if r[2]}
        if name == "exact dedup":
            texts = collections.defaultdict(list)
            for i, t in rows_of(docs.select("doc_id", "text")):
                texts[(t or "").encode().lower()].append(i)
            assert after == {max(v) for v in texts.values()}
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_pipeline_awkward(spark, awkward, empty):
    for docs in (awkward, empty):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = spark.createDataFrame(stage(spark, out, SF).toArrow())
        assert out.count() <= 3 * docs.count()


def plain_mix(rows, weights, epochs=3):
    """Copies to take of each row, by water-filling and the seeded order, in plain Python."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, left = {}, sum(total.values())
    open_sources = list(sources)
    while open_sources:
        share = {s: weight[s] * left / sum(weight[o] for o in open_sources) for s in open_sources}
        over = [s for s in open_sources if share[s] > epochs * total[s]]
        target |= {s: epochs * total[s] for s in over} if over else share
        left -= sum(target[s] for s in over)
        open_sources = [s for s in open_sources if s not in over] if over else []
    times, start = [0] * len(rows), collections.Counter()
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix:{rows[k][0]}".encode()).hexdigest(), rows[k][0], size[k])):
        s = rows[k][2]
        if total[s]:
            whole = int(target[s] // total[s])
            times[k] = whole + (2 * start[s] + size[k] < 2 * (target[s] - whole * total[s]))
        start[s] += size[k]
    return times


def test_pipeline_rows_against_plain_python(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    after = lambda name, docs: spark.createDataFrame(stages[name](spark, docs, SF).toArrow())
    plain = lambda df: sorted(rows_of(df.select("doc_id", "text", "source")), key=str)

    model = toxicity.train(small.filter(fold("doc_id", 4) != 2), spark.read.parquet(f"{SF}/labels.parquet"))
    eta = lambda t: sum(model.weights[model.features[f]] for f in toxicity.text_features(t or "", None, {}) if f in model.features)
    clean = after("toxicity", small)
    want = [r for r in plain(small) if 1 - toxicity.grade_chances(np.array([eta(r[1])]), model.thresholds)[0, 0] < 0.3]
    assert plain(clean) == want and 0 < len(want) < small.count()

    single = after("near dedup", after("exact dedup", clean))
    rows = plain(single)
    mixed = after("mixing", single)
    times = plain_mix(rows, queries.WEIGHTS)
    assert plain(mixed) == sorted([r for r, n in zip(rows, times) for _ in range(n)], key=str) and len(set(times)) > 1

    t = bpe.load(queries.tokenizer_json())
    encoded = after("bpe", mixed)
    got = sorted((r.doc_id, r.source, list(r.ids), r.n_tokens) for r in encoded.collect())
    assert got == sorted((i, s, (ids := t.encode(x or "", add_special_tokens=False).ids), len(ids)) for i, x, s in plain(mixed))
    assert all(r.decoded_sha256 == hashlib.sha256(t.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in encoded.collect())
    assert sorted(rows_of(corpus_pipeline.run(spark, SF)), key=str) == sorted(rows_of(encoded), key=str)
