"""Phrase collocations (12) against plain counting."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from chalkline.llm import collocations as co


def plain(rows, least, first, share):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if n >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            within = (q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * often[q] >= share * a for q in within):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def made():
    rnd = random.Random(12)
    words = ["New", "york", "CITY", "the", "of", "état", "Ärger", "x y", "日本", "a-b", "😀"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", " ! "]) for _ in range(rnd.randint(0, 60)))
    rows = [(i, text(), rnd.choice(["en", "en", "en", "de", "und", None]), "a") for i in range(250)]
    return rows + [(1000 + i, "the quick brown fox. the quick brown cat", "fr", "a") for i in range(40)] + [(7, "same text of the same row", "en", "a")] * 50


ODD = [(None, None, None, None), (None, "", "en", "a"), (3, " \t ", "en", "a"), (4, "...!?", None, "a"), (None, "one two three. " * 5000, "long", "a"), (5, "w" * 200_000 + " " + "w" * 200_000, "long", "a")]


@pytest.mark.parametrize("bits", [64, 6, 0])
def test_phrases(docs_of, monkeypatch, bits):
    """Also where nearly all fingerprints collide."""
    rows = made() + ODD
    monkeypatch.setattr(co, "SLICE_BYTES", 3000)
    monkeypatch.setattr(co, "RUN_WORDS", 400)
    for least, first in ((5, 2000), (30, 7)):
        got = co.collocations(docs_of(rows), least, first, 80, mask=(1 << bits) - 1)
        assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(rows, least, first, 80)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rows = made() + ODD
    monkeypatch.setattr(co, "CUT_CHARS", 40)
    monkeypatch.setattr(co, "SLICE_BYTES", 200)
    monkeypatch.setattr(co, "RUN_WORDS", 100)
    assert list(co.stretches("a" * 60 + ".b c. " + "d" * 50)) == ["a" * 60 + ".", "b c. " + "d" * 50]
    printer, count, names = co.Printer("en", (1 << 64) - 1), Counter(), {}
    flat = Counter()
    for _, t, _, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t or ""):
            w = re.findall(r"[^\x20\x09]+", piece)
            flat.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    for p in flat:
        h = np.array([co.word_hash(w) for w in p], np.uint64)
        names[int(printer.prints(h, len(p)).view(np.int64)[0]), int(printer.checks(h, len(p))[0])] = p
    run, runs = co.Run("en", (1 << 64) - 1), 0

    def take():
        for part in run.grams((1, 2, 3, 4)):
            for p, c, n in zip(part["print"], part["check"], part["n"]):
                count[names[int(p), int(c)]] += int(n)

    for _ in run.add([r[1] or "" for r in rows], np.arange(len(rows))):
        runs += 1
        take()
        run.empty()
    take()
    assert count == flat and runs > 20


def test_the_bit_field_holds_every_frequent_print(spark):
    prints = [0, -1, 1 << 40, -(1 << 63), (1 << 63) - 1, 123456789 << 30]
    field = np.frombuffer(co._field(spark.createDataFrame([(p,) for p in prints], "print long")), np.uint8)
    assert co.marked(field, np.array(prints, np.int64).view(np.uint64)).all()
    assert not co.marked(field, np.array([1 << 50, 5 << 50], np.uint64)).any() and np.unpackbits(field).sum() == len({(p & ((1 << 64) - 1)) >> 38 for p in prints})


def test_scores_beyond_64_bits(spark):
    """Products pass 64 bits; the quotient is exact."""
    big = 9 * 10**18
    inner = [(0, 1, 1, 1), (1, 1, 2, 2)]
    phrases = spark.createDataFrame([("en", 2, "a b", 3, 3, inner, big - 10)], co.PHRASES + ", f long")
    counts = spark.createDataFrame([(1, 1, big), (2, 2, big - 1), (3, 3, big - 10)], "print long, check int, f long")
    table = co.scored(phrases, counts)
    assert table.collect()[0].score == 2000000 * (big - 10) // (2 * big - 1)
    assert [x.phrase for x in co.without_fragments(table).collect()] == ["a b"]


def test_no_documents(empty):
    assert co.collocations(empty).collect() == []
