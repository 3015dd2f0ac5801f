"""Divergence of sources, benchmark leaks and filter interaction against plain Python, and on awkward cases."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from framequarry.llm import divergence, interaction, leaks, queries

SCHEMA = "doc_id long, text string, lang string, source string, row string, id int, n int, key string, term string, spans int, items int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def frame(spark, rows):
    """Rows of id, text, language and source, with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "k", "t", 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and terms of many kinds."""
    rnd = random.Random(5)
    vocabulary = ["the", "The", "été", "Été", "x1y", "don't", "日本", "a", "b", "zz", "über", "naïve-c", "#tag", "Z"]
    rows = []
    for i in range(150):
        text = rnd.choice([" ", "  ", "\n", "\x00", "\x85"]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 9, 10, 40, 250])))
        rows.append((i, text, rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S3", None])))
    rows += [rows[40], rows[40], (500, rows[41][1], "de", "s1"), (501, rows[41][1], "en", "s1"), (None, rows[41][1], "en", "s9"), (None, None, None, None), (502, None, "fr", "s1"), (503, "", "fr", None)]
    rows += [(504, "lone words here", "it", "only"), (505, " ".join(f"w{k % 701} The" for k in range(40_000)), "en", "s1"), (505, "another text", "en", "s1")]
    return rows


# ---- 11 divergence ----


def plain_divergence(rows, least, top):
    groups = collections.defaultdict(collections.Counter)
    seen = collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
        groups[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {l for l, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = collections.Counter()
        for (l, _), c in groups.items():
            if l == lang:
                whole.update(c)

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (size + 2 * len(kept)) for t in kept}

        q = shares(whole)
        of = {s: shares(c) for (l, s), c in groups.items() if l == lang}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, p in of.items():
            pairs = sorted((-sum(f(p[t], o[t]) for t in kept), other.encode()) for other, o in of.items() if other != s)
            terms = sorted((-f(p[t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, held", [(10, 10, 300_000), (1, 3, 50), (1000, 10, 300_000)])
def test_divergence_against_plain_python(spark, docs, monkeypatch, least, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.audit_sources(frame(spark, docs).repartition(3), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(rows_of(got)) == plain_divergence(docs, least, top)


def test_divergence_counts_in_small_blocks(monkeypatch, docs):
    """Counts do not depend on how texts are cut into blocks or when they are passed on."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in docs]) for k in (2, 3, 1)], names=["lang", "source", "text"])

    def total(batches):
        out = collections.Counter()
        for b in divergence.count_terms(batches):
            for lang, source, term, n, found in zip(*[c.to_pylist() for c in b.columns]):
                out[lang, source, term] += n + found * 1_000_000
        return out

    want = total([batch])
    monkeypatch.setattr(divergence, "BLOCK", 100)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert total([batch.slice(0, 30), batch.slice(30, 0), batch.slice(30)]) == want


def test_divergence_large_counts_and_many_sources(spark, monkeypatch):
    """Shares are exact where counts pass 2^33, and blocks narrower than a row of sources work."""
    rows = spark.createDataFrame([(10**16 + 3, 10**17 + 9, 77)], "n long, size long, v long")
    got = rows.select(divergence.share(rows.n, rows.size, rows.v)).first()[0]
    assert got == 1 + 10**9 * (10**16 + 5) // (10**17 + 9 + 154)
    monkeypatch.setattr(divergence, "CELLS", 5)
    docs = [(i, f"a{'b' * (i % 3)} c", "en", f"s{i % 17}") for i in range(60)]
    assert sorted(rows_of(divergence.audit_sources(frame(spark, docs), 1, 2))) == plain_divergence(docs, 1, 2)


def test_divergence_of_an_empty_table(spark):
    assert rows_of(divergence.audit_sources(frame(spark, []))) == []


# ---- 12 leaks ----


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def plain_leaks(rows, items, n):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text, *_ in rows:
        w = plain_words(text)
        hit, found = set(), set()
        for size in {len(g) for g in windows}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[g]
        spans = [[a, b] for k, g in itertools.groupby(sorted(hit), key=lambda p, c=itertools.count(): p - next(c)) for a, *r in [list(g)] for b in [(r[-1] if r else a) + 1]]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None), spans))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaky(docs):
    rnd = random.Random(6)
    small = [f"t{k}" for k in range(12)]
    items = [(k, " ".join(rnd.choice(small) for _ in range(rnd.choice([3, 11, 14])))) for k in range(12)]
    items += [(20, "The, été; X1Y 日本 a b zz!"), (21, ""), (22, None), (23, "?!"), (24, "a"), (25, items[1][1].upper()), (3, items[3][1]), (None, "no id but words"), (100, items[1][1])]
    texts = [(700 + k, " ".join([rnd.choice(small) for _ in range(rnd.randint(0, 30))] + [rnd.choice(items)[1] or ""] * rnd.randint(0, 2) + ["-t1", "T2;"]), "en", "s") for k in range(60)]
    return docs + texts, items


@pytest.mark.parametrize("n", [10, 4, 1])
def test_leaks_against_plain_python(spark, leaky, n):
    rows, items = leaky
    got = leaks.find_leaks(frame(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), n)
    assert got.columns == ["doc_id", "text_key", "n_words", "n_hit", "items", "spans"]
    found = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), [list(s) for s in r.spans]) for r in got.collect()], key=str)
    want = plain_leaks(rows, items, n)
    merged = [(d, w, h, i, s) for d, w, h, i, s in want]
    # Spans that touch are one span here and in plain Python.
    assert found == merged and any(s for *_, s in found)


def test_leaks_beyond_the_broadcast_and_with_a_full_bit_field(spark, leaky, monkeypatch):
    rows, items = leaky
    monkeypatch.setattr(leaks, "MOST_WINDOWS", 0)
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    got = leaks.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 10)
    found = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), [list(s) for s in r.spans]) for r in got.collect()], key=str)
    assert found == plain_leaks(rows, items, 10)


def test_leaks_dropped_or_cut(spark, leaky):
    rows, items = leaky
    items = [i for i in items if i[0] not in (24,)]
    table, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    clean = {(d, h == 0) for d, _, h, *_ in plain_leaks(rows, items, 10)}
    kept = leaks.drop_leaks(table, benchmark)
    assert kept.columns == table.columns
    want = collections.Counter(str(r) for r in rows for d, _, h, *_ in plain_leaks([r], items, 10) if h == 0)
    assert collections.Counter(str(tuple(r)[:4]) for r in kept.collect()) == want and len(clean) > 1
    cut = leaks.cut_leaks(table, benchmark)
    assert cut.columns == table.columns and cut.count() == len(rows)
    plain = {(r[0], r[1]): r for r in rows}
    for r in cut.collect():
        if (r.doc_id, r.text) not in plain:
            assert plain_words(r.text) != [] or r.doc_id is not None
    before = {d: (w, h) for d, w, h, *_ in plain_leaks([r for r in rows if r[0] is not None and r[0] >= 700], items, 10)}
    for r in cut.filter("doc_id >= 700").collect():
        assert len(plain_words(r.text)) == before[r.doc_id][0] - before[r.doc_id][1]


def test_cut_keeps_the_text_around_a_span(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"  Intro: {item.upper()}, after!\n", "en", "s"), (2, item, "en", "s"), (3, f"{item}; {item}. End", "en", "s"), (4, "Clean -- text ", "en", "s"), (5, None, "en", "s")]
    got = {r.doc_id: r.text for r in leaks.cut_leaks(frame(spark, rows), spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert got == {1: "  Intro: after!\n", 2: "", 3: "End", 4: "Clean -- text ", 5: None}


def test_leaks_empty_tables_and_text_ids(spark, leaky):
    rows, _ = leaky
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, len(r["items"])) for r in leaks.find_leaks(frame(spark, rows), none).collect()} == {(0, 0)}
    assert rows_of(leaks.find_leaks(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == []
    named = spark.createDataFrame([("doc", "a b c")], "doc_id string, text string")
    assert leaks.find_leaks(named, spark.createDataFrame([("it", "b")], "item_id string, text string")).first()["items"] == ["it"]


def test_leaks_plan_is_native(spark):
    plan = queries.op12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapInPandas|RDDScan", plan) and "BroadcastHashJoin" in plan


# ---- 13 interaction ----


def plain_report(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = collections.defaultdict(list)
    for i, text, lang, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[lang or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        table = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                table[order, step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        share = collections.Counter()
        for (order, step), v in table.items():
            share[order[step - 1]] += v[1]
        out += [(part, order, step, *v, share[order[step - 1]]) for (order, step), v in table.items()]
    return sorted(out)


def test_interaction_against_plain_python(spark, docs):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 500, 2)] + [(None, 1, 1), (4, None, None), (6, 1, 0), (6, 0, 1), (505, 1, 1), (999, 1, 1)]
    rows = docs + [(600 + i, "$ COPY " * 3, "en", "s") for i in range(20)] + [(599, "$ COPY " * 3, "de", "s"), (599, "$ COPY " * 3, "en", "s")]
    got = interaction.audit_filters(frame(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(rows_of(got)) == plain_report(rows, labels)


def test_interaction_without_rows_or_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows_of(interaction.audit_filters(frame(spark, []), none)) == []
    got = interaction.audit_filters(frame(spark, docs), none)
    assert sorted(rows_of(got)) == plain_report(docs, [])


def test_removal_steps_are_a_min_plus_product():
    orders, positions = interaction.position_matrix("XYZ")
    masks = np.array([[0, np.inf, 0], [np.inf] * 3, [np.inf, 0, np.inf]])
    steps = interaction.removal_steps(masks, positions)
    assert len(orders) == 6 and np.isinf(steps[1]).all()
    assert [int(s) for s in steps[0]] == [min(o.index("X"), o.index("Z")) for o in orders]
    assert [int(s) for s in steps[2]] == [o.index("Y") for o in orders]


def test_failed_filters_at_the_thresholds():
    word = b"a b c d e f g h i j "
    bits = interaction.failed_filters
    assert bits(b"") == 1 and bits(word * 19) & 1 and not bits(word * 20) & 1
    assert bits(b"a a b b") == 1 and bits(b"a a a b b") == 3  # half of the words distinct passes
    assert bits(b"ABC" + b"x" * 97) == 1 and bits(b"ABC" + b"x" * 96) == 5
    assert bits("ABC".encode() + "é".encode() * 97) == 1  # code points, not bytes
    assert bits(b"x|") & 8 and not bits(b"x<") & 8
