"""Language identification (7), quality (9) and decontamination (10): held-out accuracy and planted cases."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chalkline.llm import decontamination as dc
from chalkline.llm import language, quality
from chalkline.llm.batches import labelled_sample


def fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def more(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def test_language_of_held_out_documents(more):
    docs, folder = more
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    got = language.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == fold(r.doc_id) for r in got) and len(got) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_every_label_is_sampled(spark):
    rows = spark.range(2400).selectExpr("id AS doc_id", "concat('l', id % 1200) AS lang")
    sample, counts = labelled_sample(rows, "lang", "doc_id", 300)
    assert len(counts) == 1200 and {r.lang for r in sample.collect()} == set(counts)


def test_presence_is_a_set_of_ngrams():
    bits = language.presence([b"abc", b"abc abc", b"", b"b", b"a1!b", b"a b"])
    assert (bits[0] <= bits[1]).all() and bits[3].sum() >= 1
    assert (bits[4] == bits[5]).all()  # other characters are one space
    long = language.presence([b"abcd" * 1000, b"abcd" * 2000])
    assert (long[0] == long[1]).all()


def test_language_of_odd_rows(odd, odd_rows, empty):
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.held_out == fold(r.doc_id)
    und = [(i, t) for i, t, _, _ in odd_rows if not any(c.isalpha() for c in t or "")]
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == sorted(str(i) for i, _ in und)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(empty).count() == 0


def test_language_without_labels(docs_of):
    got = language.identify(docs_of([(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_quality_of_held_out_documents(spark, more):
    docs, folder = more
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count() and all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    held = [i for i in truth if fold(i)]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(2)
    size = quality.WORDS + 3 * quality.BINS
    m = quality.Model(np.zeros((3, quality.BINS - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    rows, feats, vals = np.array([0, 0, 0, 1, 1]), np.array([5, 9, 20, 5, 7]), np.array([0.5, 1.0, 2.0, 1.5, -1.0])
    z, _ = m.margin(rows, feats, vals, 2)
    for r in (0, 1):
        f, x = feats[rows == r], vals[rows == r]
        want = 0.3 + (m.w[f] * x).sum() + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(z[r] - want) < 1e-9


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (5, 1), (5, 0), (9, 0), (10, 1), (None, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        model = quality.train(odd, lab)
        got = quality.score(odd, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert quality.score(empty, model).count() == 0
    assert {r.score for r in got} == {0.5}


# --- decontamination --------------------------------------------------------------------------


def normal(text):
    return [t for t in dc.terms_of(pa.array(text.split(), pa.string())).to_pylist() if t]


def holds(words, piece):
    return any(words[i : i + len(piece)] == piece for i in range(len(words) - len(piece) + 1))


def test_exact_leaks_of_given_documents(spark, more):
    docs, folder = more
    bench = duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    items = [(i, normal(t)) for i, t in bench]
    want = {(i, k) for i, t in texts for k, q in items if holds(normal(t), q)}
    got = {(r.doc_id, r.item_id): r for r in dc.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert want and want == set(got)
    assert all(r.lcs == r.passage_words and r.answer for r in got.values())


def test_paraphrases_and_clean_documents(spark, docs_of):
    rnd = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([12, 25, 55])))) for k in range(20)]
    rows, want = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        filler = lambda n: [rnd.choice(words) for _ in range(n)]
        changed = [x if rnd.random() > 0.1 or j >= len(w) - 4 else "other" for j, x in enumerate(w)]
        rows.append((100 + k, " ".join(filler(80) + changed + filler(70)), None, None))
        kept = len(w) - changed.count("other")
        if kept >= 0.6 * len(w):
            want.add((100 + k, i))
        rows.append((200 + k, " ".join(filler(200)), None, None))
        rows.append((300 + k, " ".join(filler(50) + w[: len(w) // 3] + filler(50)), None, None))  # a third of an item is no leak
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want - got) <= 0.1 * len(want) and got <= want  # recall 0.9 at least, no clean document


def test_verbatim_items_of_a_large_benchmark(spark, docs_of):
    rnd = random.Random(11)
    words = [f"word{k}" for k in range(5000)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, some(40)) for k in range(2000)]
    rows = [(k, f"{some(60)} {items[k * 33][1]} {some(60)}", None, None) for k in range(60)] + [(1000 + k, some(200), None, None) for k in range(60)]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k * 33) for k in range(60)}


def test_rank_follows_the_passages(spark, docs_of):
    rnd = random.Random(12)
    items = [(k, " ".join(f"word{rnd.randrange(3000)}" for _ in range(40))) for k in range(700)]
    docs = docs_of([(1, "word1 word2", None, None)])
    p = next(dc.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", None))
    dc.weigh(p, docs, "text")
    dc.decompose(p, docs)
    a = p.matrix(list(range(len(p.rows))))
    assert np.linalg.norm(a @ p.basis, axis=1).min() >= 0.9 and np.allclose(np.linalg.norm(p.latent, axis=0), 1, atol=1e-3)


def test_items_at_the_end_of_a_document(spark):
    rnd = random.Random(13)
    for n in range(24, 65):
        piece = list(range(n))
        p = dc.Passages({str(k): k for k in piece}, [1], [np.array(piece)], [np.array(piece[-4:])])
        for share in (0.15, 0.3, 0.35):
            lost = set(rnd.sample(range(n - 4), int(share * n)))
            doc = [-1] * 150 + [-1 if k in lost else k for k in piece]
            for a in (110, 130, 150):  # wherever the candidate's window lies
                assert dc.verdict(p, 0, doc, a, min(len(doc), a + 64))[:2] == (n - len(lost), True)


def test_windows_passed_over_have_no_candidate():
    rnd = np.random.default_rng(14)
    ids = rnd.integers(-3, 20, 3000)
    weight = np.where(ids >= 0, 1.0 + ids % 7, 5.0)
    bound = np.where(ids >= 0, (2 * dc.repeats(ids) - 1) * weight**2, 0)
    for width in dc.WIDTHS:
        for a in range(0, 2900, 37):
            here, n = np.unique(ids[a : a + width], return_counts=True)
            assert bound[a : a + width].sum() >= sum((k * (1.0 + i % 7)) ** 2 for i, k in zip(here, n) if i >= 0) - 1e-6


def test_windows_within_the_cosine_are_projected(monkeypatch):
    p = dc.Passages({f"a{k}": k for k in range(4)}, [1], [np.arange(4)], [np.arange(4)])
    p.idf, p.unknown, p.others = np.full(4, 4.0), 7.0, np.full(1 << 16, 7.0)  # four words of eight have a cosine of 0.5 and a quarter of the squared weight
    p.basis, p.latent = np.eye(4, dtype=np.float32), np.full((4, 1), 0.5, np.float32)
    monkeypatch.setattr(dc, "_anchored", lambda *_: None, raising=False)
    other = " ".join(f"b{k}" for k in range(40))
    found = dc.matches(p, [f"{other} a0 a1 a2 a3 {other}".encode()])
    assert [r[:2] for r in found] == [(0, 1)] and abs(found[0][2] - (4 / (4 + 4 * 49 / 16)) ** 0.5) < 1e-3


def test_sums_of_halves_find_every_window_within_the_cosine():
    # Against one product per window, with texts of every length around the widths and between texts without a match.
    rnd = np.random.default_rng(17)
    v, passages = 60, 7
    p = dc.Passages({f"a{k}": k for k in range(v)}, list(range(passages)), [np.arange(5)] * passages, [np.arange(2)] * passages)
    p.idf, p.others = rnd.uniform(0.5, 7, v), np.full(1 << 16, 3.0)
    p.basis = np.eye(v, 20, dtype=np.float32)
    latent = rnd.random((20, passages)) ** 8
    p.latent = (latent / np.linalg.norm(latent, axis=0)).astype(np.float32)
    p.multiply()
    sizes = np.array([1, 3, 4, 5, 8, 9, 31, 32, 33, 0, 63, 64, 65, 96, 97, 128, 500, 2, 1000])
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.where(rnd.random(first[-1]) < 0.7, rnd.integers(0, v, first[-1]) // 3, -10)
    weight = np.where(ids >= 0, p.idf[np.maximum(ids, 0)], 3.0)
    windows, want = [], {}
    for width in dc.WIDTHS:
        at = [(a, min(a + width, int(first[t + 1])), t) for t in range(len(sizes)) for a in range(int(first[t]), int(first[t + 1]), width // 2) if rnd.random() < 0.6]
        windows.append(tuple(np.array(x) for x in zip(*at)))
        for a, z, t in at:
            x = np.bincount(ids[a:z][ids[a:z] >= 0], minlength=v) * p.idf
            cos = x @ p.basis @ p.latent / np.sqrt(x @ x + 9.0 * (ids[a:z] < 0).sum())
            want |= {(width, a, z, t, j): cos[j] for j in np.flatnonzero(cos >= dc.COSINE)}
    got = {}
    for a, z, text, j, product in dc._close(p, ids, weight, first, windows):
        cos = product / dc._norms(p, ids, weight, a, z)
        got |= {k: c for *k, c in zip(a, z, text, j, cos) if c >= dc.COSINE for k in [tuple(map(int, k))]}
    assert len(want) > 50 and {k[1:] for k in want} == set(got)
    assert all(abs(got[k[1:]] - c) < 1e-4 for k, c in want.items())


def test_short_items_in_long_documents(spark, docs_of):
    rnd = random.Random(15)
    items = [(k, " ".join(f"item{k}x{i}" if i % 2 else f"word{rnd.randrange(40)}" for i in range(3 + k % 5))) for k in range(40)]
    some = lambda n: " ".join(f"other{rnd.randrange(60)}" for _ in range(n))
    rows = [(k, f"{some(300)} {t} {some(300)}", None, None) for k, t in items] + [(1000 + k, some(600), None, None) for k in range(60)]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items}


@pytest.mark.parametrize("n", [1_000, 1_000_000])
def test_candidates_do_not_depend_on_the_number_of_documents(spark, docs_of, n, monkeypatch):
    # Every word of the block stands in a hundredth of n documents, "stop" in all of them and other words in none.
    rnd = random.Random(16)
    items = [(k, " ".join(f"word{rnd.randrange(1500)}" for _ in range(40))) for k in range(60)]
    p = next(dc.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", None))
    counts = [(t, n // 100) for t in range(len(p.vocab))] + [(-1, n), (-10 - zlib.crc32(b"stop") % dc.OTHERS, n)]
    monkeypatch.setattr(dc, "map_arrow", lambda *_: spark.createDataFrame(counts, "term long, n long"))
    dc.weigh(p, docs_of([(1, "x", None, None)]), "text")
    monkeypatch.undo()
    assert p.others[zlib.crc32(b"stop") % dc.OTHERS] == pytest.approx(0.1, abs=1e-2) and max(p.idf.max(), p.others.max()) <= 7.1
    dc.decompose(p, docs_of([(1, "x", None, None)]))
    p.anchor()
    monkeypatch.setattr(dc, "_anchored", lambda *_: None)  # the cosine alone
    texts = []
    for _, t in items:
        w = t.split()
        lost = set(rnd.sample(range(36), 14))  # 0.65 and the answer stay
        w = [f"new{rnd.random()}" if k in lost else x for k, x in enumerate(w)]
        texts.append(" ".join(["new%d" % rnd.randrange(10**9) for _ in range(30)] + w + ["stop new%d" % rnd.randrange(10**9) for _ in range(15)]).encode())
    got = {(r[0], r[1]) for r in dc.matches(p, texts)}
    assert len(got & {(k, p.items[k]) for k in range(60)}) >= 54 and p.items == list(range(60))


def test_odd_rows_and_items(spark, odd, empty, odd_rows):
    items = [(1, "the lazy dog and runs"), (2, None), (3, ""), (4, "!!! ..."), (None, "the lazy dog and runs"), (5, "base3 base4 base5 base6 base7 base8 base9 base10 base11"), (6, "no such words here at all in any text"), (7, "one two")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, body string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(odd, bench).collect()}
    base = {i for i, t, _, _ in odd_rows if t and holds(normal(t), normal(items[5][1]))}
    assert got == {(1, 1)} | {(i, 5) for i in base}
    assert dc.leaks(empty, bench).count() == 0 and dc.leaks(odd, bench.limit(0)).count() == 0


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dc.lcs(masks, len(a), b) == table[-1][-1]


def test_singular_vectors_span_the_passages(spark, docs_of):
    docs = docs_of([(k, f"alpha{k} beta{k % 3} gamma", None, None) for k in range(12)])
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k % 3} gamma delta{k}") for k in range(12)], "item_id long, text string")
    p = next(dc.blocks(bench, "item_id", "text", None))
    dc.weigh(p, docs, "text")
    dc.decompose(p, docs)
    a = p.matrix(list(range(12)))
    assert np.allclose(a @ p.basis @ p.basis.T, a, atol=1e-4)
    assert p.idf[p.vocab["gamma"]] < p.idf[p.vocab["beta0"]] < p.idf[p.vocab["alpha1"]]
