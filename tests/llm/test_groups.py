"""Exact dedup (2), the n-gram join (3) and substring dedup (4) against plain loops."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import batches, common
from chalkline.llm import exact_dedup as ed
from chalkline.llm import ngram_join as nj
from chalkline.llm import substring_dedup as sd
from chalkline.llm.components import components
from chalkline.llm.fm_index import FMIndex
from chalkline.llm.shingles import band_hashes, bands_and_rows, shingle_hashes, word_hashes


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def order(i):
    return (i is None, i or 0)


# --- exact dedup -----------------------------------------------------------------------------


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return Counter((i, least(ids), len(ids), hashlib.sha256(body.encode()).hexdigest()) for body, ids in groups.items() for i in ids), groups


@pytest.mark.parametrize("capacity", [1 << 16, 5])
def test_exact_dedup(odd, odd_rows, given, given_docs, capacity):
    for docs, rows in ((given_docs, given), (odd, [(i, t) for i, t, _, _ in odd_rows])):
        want, groups = exact(rows)
        got = ed.dedup(docs, capacity=capacity).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_of_nothing(empty):
    assert ed.dedup(empty).count() == 0


def test_directory_splits_overfull_buckets(given_docs):
    _, index, cells = ed.build_index(given_docs, capacity=8)
    sizes = Counter(r.bucket for r in index.collect())
    depths = {r.depth for r in cells.collect()}
    assert max(sizes.values()) <= 8 and len(depths) > 1  # no bucket overflows, and not all split equally often
    rows = index.select("key64", "bucket").collect()
    for r in rows:  # a bucket is a prefix of the key
        depth, prefix = map(int, r.bucket.split("/"))
        assert (r.key64 % (1 << 64)) >> (64 - depth) == prefix if depth else True


# --- n-gram join ------------------------------------------------------------------------------


def near(rows, num=4, den=5, n=5):
    """(texts, links between them, class of each)."""
    texts = list(dict.fromkeys(tuple((t or "").encode().split()) for _, t in rows))
    sets = [{w[i : i + n] for i in range(len(w) - n + 1)} if len(w) >= n else ({w} if w else set()) for w in texts]
    links, root = defaultdict(set), list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            common = len(a & sets[y])
            if common and common * den >= num * (len(a) + len(sets[y]) - common):
                links[x].add(y)
                links[y].add(x)
                p, q = top(x), top(y)
                root[max(p, q)] = min(p, q)
    return texts, links, [top(x) for x in range(len(texts))]


def check_near(docs, rows, **limits):
    texts, links, top = near(rows)
    at = {w: x for x, w in enumerate(texts)}
    ids = defaultdict(list)
    for i, t in rows:
        ids[at[tuple((t or "").encode().split())]].append(i)
    members = defaultdict(list)
    for x, r in enumerate(top):
        members[r] += ids[x]
    want = Counter()
    for x, own in ids.items():
        near_by = sum(len(ids[y]) for y in links[x])
        for i in own:
            want[i, least(own), least(members[top[x]]), len(members[top[x]]), len(own) - 1 + near_by, len(links[x])] += 1
    got = nj.near_duplicates(docs, **limits).collect()
    assert Counter((r.doc_id, r.text_id, r.class_id, r.class_size, r.n_links, r.n_text_links) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(members) and all(r.doc_id == r.class_id for r in kept)


@pytest.mark.parametrize("limits", [{}, {"unit_texts": 4, "unit_shingles": 300}])
def test_near_duplicates(docs_of, odd, odd_rows, limits):
    check_near(odd, [(i, t) for i, t, _, _ in odd_rows], **limits)
    rnd = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(12):  # edits at a few places: similarities on both sides of the threshold
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(60)] = f"x{rnd.random()}"
            rows.append((len(rows), " ".join(w), None, None))
    check_near(docs_of(rows), [(i, t) for i, t, _, _ in rows], **limits)


def test_near_duplicates_of_given_documents(given, given_docs, empty):
    check_near(given_docs, given)
    assert nj.near_duplicates(empty).count() == 0


def test_bands_reach_the_target_recall():
    bands, rows = bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    rnd = random.Random(1)
    hit = 0
    for k in range(300):  # pairs of similarity 0.8: 80 shared of 100 shingles
        common = [f"{k}c{i}" for i in range(84)]
        a, b = common + [f"{k}a{i}" for i in range(10)], common + [f"{k}b{i}" for i in range(10)]
        flat, sizes, _ = word_hashes([" ".join(a).encode(), " ".join(b).encode()])
        h, count = shingle_hashes(flat, sizes, 5)
        x = band_hashes(h, count, bands, rows)
        hit += bool((x[0] == x[1]).any())
    assert hit >= 299 and rnd


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[top(a)] = top(b)
    assert set(got) == set(root)
    assert len({(got[x], top(x)) for x in root}) == len({top(x) for x in root}) == len(set(got.values()))


# --- substring dedup ----------------------------------------------------------------------------


def removed(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g not in first or order(i) < order(first[g]):
                first[g] = i
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if order(first[tuple(w[k : k + window])]) < order(i):
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return want


@pytest.mark.parametrize("limits", [{}, {"shard_words": 500, "name_segments": 2}])
def test_substring_dedup(docs_of, odd, odd_rows, limits):
    got = sd.dedup_substrings(odd, **limits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed([(i, t) for i, t, _, _ in odd_rows], 50)
    rnd = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(4)] + [["same"] * 25]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(1, 5)):
            w += rnd.choice(passages)[: rnd.choice([12, 30])] if rnd.random() < 0.7 else [f"r{rnd.randrange(40)}" for _ in range(9)]
        rows.append((rnd.randrange(80), " ".join(w), None, None))
    got = sd.dedup_substrings(docs_of(rows), window=20, **limits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed([(i, t) for i, t, _, _ in rows], 20)
    for r in got:
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.intervals) == r.n_removed


def test_equal_windows_enter_an_index_once(docs_of, monkeypatch):
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}"] * 20 + passage + [f"b{i}"] * 20), None, None) for i in range(40)]
    seen, search = [], sd.searched
    monkeypatch.setattr(sd, "searched", lambda r, *a: seen.append(r.groupBy("place", "words").count().agg(F.max("count")).first()[0]) or search(r, *a))
    got = sd.dedup_substrings(docs_of(rows), window=20, name_segments=2).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed([(i, t) for i, t, _, _ in rows], 20)
    assert seen == [1]


def test_staged_tables_leave_no_shuffle_files(spark, docs_of, tmp_path):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in map(str, (files.apply(i) for i in range(files.size()))) if f.endswith(".data")}

    own, before = spark.conf.get(common.CLEAN, None), shuffled()
    table = common.staged(docs_of([(i, f"t{i}", "en", "a") for i in range(100)]).groupBy("text").count(), "counts")
    wait = time.time() + 20  # the files go in the background
    while shuffled() - before and time.time() < wait:
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 100 and spark.conf.get(common.CLEAN, None) == own


def test_words_of_segments_are_dealt_once(docs_of, monkeypatch):
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}"] * 20 + passage + [f"b{i}"] * 20), None, None) for i in range(40)]
    plans, search = [], sd.searched
    monkeypatch.setattr(sd, "searched", lambda r, *a: plans.append(r._jdf.queryExecution().executedPlan().toString()) or search(r, *a))
    got = sd.dedup_substrings(docs_of(rows), window=20).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed([(i, t) for i, t, _, _ in rows], 20)
    few = plans[0].split("Union")[1].split("MapInArrow")[0]
    assert "LeftAnti" in few and "Exchange hashpartitioning(name" not in few


def test_substring_dedup_of_given_documents(given, given_docs, empty):
    got = sd.dedup_substrings(given_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(given, 50)
    assert sd.dedup_substrings(empty).count() == 0


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(100):
        most, letters = rnd.randint(2, 6), rnd.choice([2, 3, 6])
        seqs = [[rnd.randint(10, 9 + letters) for _ in range(rnd.randint(0, 20))] for _ in range(rnd.randint(1, 6))]
        own = [rnd.randint(0, 50) for _ in seqs]
        index = FMIndex(np.array(sum(seqs, []), np.uint64), np.array([len(s) for s in seqs]), np.array(own), most)
        asked = [[rnd.randint(9, 10 + letters) for _ in range(rnd.randint(0, 15))] for _ in range(4)] + seqs
        length, owner = index.statistics(np.array(sum(asked, []), np.uint64), np.array([len(s) for s in asked]))
        at = 0
        for s in asked:
            for p in range(len(s)):
                found = [[own[j] for j, t in enumerate(seqs) for x in range(len(t) - n + 1) if t[x : x + n] == s[p : p + n]] for n in range(1, min(most, len(s) - p) + 1)]
                n = sum(1 for f in found if f)
                assert length[at] == n and owner[at] == (min(found[most - 1]) if n == most else -1)
                at += 1


def test_no_pairs_of_a_group_are_written(spark, docs_of):
    rows = [(i, " ".join(f"w{k}" for k in range(100)) + f" end{i}", None, None) for i in range(400)]
    got = nj.near_duplicates(docs_of(rows), unit_texts=64)
    assert got.agg(F.min("n_text_links"), F.max("n_text_links"), F.countDistinct("class_id")).first() == (399, 399, 1)


def test_segments_do_not_stay_on_disk(spark, docs_of, tmp_path, monkeypatch):
    """The words of the segments are stored only while the next step reads them."""
    from chalkline.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}"] * 20 + passage + [f"b{i}"] * 20), None, None) for i in range(40)]
    got = sd.dedup_substrings(docs_of(rows), window=20, name_segments=2)
    kept = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "llm").iterdir()}
    assert not kept & {"substr-segments", "substr-single"} and "substr-places" in kept
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == removed([(i, t) for i, t, _, _ in rows], 20)


def test_python_holds_few_whole_texts_at_once(spark, docs_of):
    def rows_of(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    own = spark.conf.get(batches.BATCH)
    rows = spark.range(0, 3000, 1, 1)
    held = [r["n"] for r in batches.map_arrow(rows, rows_of, "n long", batches.TEXT_ROWS).collect()]
    assert sum(held) == 3000 and max(held) <= batches.TEXT_ROWS
    docs = docs_of([(1, "one two", "en", "a")])
    batches.map_arrow(rows, rows_of, "n long")
    nj.signatures(docs, 18, 4, 5, "doc_id", "text")
    assert spark.conf.get(batches.BATCH) == str(batches.TEXT_ROWS)
    assert [r["n"] for r in batches.map_arrow(rows, rows_of, "n long").collect()] == [3000]
    assert spark.conf.get(batches.BATCH) == own
