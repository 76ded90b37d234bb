"""Mixing (8), sharding (5) and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from chalkline.llm import mixing, ngram_join, sharding
from chalkline.llm.sharding import communication_matrix


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def check_mix(got, rows, range_rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    target = shares(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _, _ in rows)


@pytest.mark.parametrize("range_rows", [4096, 3])
def test_mix(docs_of, odd, odd_rows, range_rows):
    check_mix(mixing.mix(odd, range_rows=range_rows).collect(), odd_rows, range_rows)
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(0, 30), None, rnd.choice(["a", "a", "a", "Ä", "b", "B", None, "z"])) for i in range(300)]
    docs = docs_of(rows)
    first = mixing.mix(docs, range_rows=range_rows)
    check_mix(first.collect(), rows, range_rows)
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))  # reruns agree


def test_mix_of_nothing(empty, docs_of):
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, None, None, "a"), (2, "", None, None)])).collect()] == [0, 0]


def test_matrix_has_its_margins():
    m = communication_matrix([5, 0, 17, 100, 3], 24)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100, 3] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    total = sum(communication_matrix([30, 60], 3, seed=s) for s in range(400)) / 400
    assert np.allclose(total, [[10] * 3, [20] * 3], atol=0.6)  # means of the hypergeometric law
    spread = np.var([communication_matrix([30, 60], 3, seed=s)[0, 0] for s in range(400)])
    assert abs(spread - 30 * (1 / 3) * (2 / 3) * (60 / 89)) < 1.2


def check_shards(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(given, given_docs, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 10)  # many partitions and ranges
    check_shards(sharding.shard(given_docs).collect(), given, 24)
    check_shards(sharding.shard(odd, shards=5).collect(), [(i, t) for i, t, _, _ in odd_rows], 5)
    assert sharding.shard(empty).count() == 0


def test_shards_mix_all_sources_of_order(spark, docs_of):
    got = sharding.shard(docs_of([(i, "x", None, None) for i in range(4000)]), shards=4).collect()
    means = [np.mean([r.doc_id for r in got if r.shard == k]) for k in range(4)]
    assert max(abs(m - 2000) for m in means) < 150
    early = [r.slot for r in got if r.doc_id < 1000]
    assert abs(np.mean(early) - 500) < 40


# --- pipeline ------------------------------------------------------------------------------------


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_pipeline_stage_by_stage(spark, given_docs, small, tmp_path):
    docs, sizes = given_docs, []
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = rows_of(docs)
        path = str(tmp_path / str(k))
        stage(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns, name
        after = rows_of(out)
        assert set(after) <= set(before), name
        if name == "n-gram jaccard join":
            kept = {r.doc_id for r in ngram_join.near_duplicates(docs).where("kept").collect()}
            assert {r[0] for r in after} == kept and max(after.values()) == 1
        if name == "mixing":
            want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mixing.mix(docs).collect() if r.size}
            assert {r[0]: n for r, n in after.items()} == {i: n for i, n in want.items() if n}
        docs = out
        sizes.append(sum(after.values()))
    final = cp.STAGES[-1][1](spark, docs, small).collect()
    check_shards(final, [(r.doc_id, r.text) for r in docs.collect()], 24)
    assert cp.run(spark, small).count() == len(final) and sizes[0] >= sizes[1] >= sizes[2] > 0


def test_pipeline_of_odd_rows(spark, odd, empty, small):
    for docs in (odd, empty):
        columns = docs.columns
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, small)
            if k < 4:
                assert docs.columns == columns
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() >= 0
