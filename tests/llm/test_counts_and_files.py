"""Token counts (1) and token files (6) against the library."""

import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import regex
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chalkline.llm import token_counts as tc
from chalkline.llm import token_files as tf

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = st.sampled_from(["'", "r", "e", "ll", "s", " ", "  ", "\n", "\t", "a", "The", "12", "!", "é", "<|endoftext|>", "<|", "日本", " ", "😀", "---", "'re", "'ll", "İ", "ß", "½", "\x1c", "́", "ɐ"])


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounter(BYTES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@cases(st.lists(PIECES, max_size=14))
def test_every_prefix_counts_as_the_library_counts(parts):
    c, t = tc.counter(BYTES), _library(BYTES)
    text = "".join(parts)
    want = [len(e.ids) for e in t.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
    assert c.prefixes(text).tolist() == want
    for budget in (0, 1, 3, 7):
        assert c.reach(text, budget) == (want[-1], max(i for i, n in enumerate(want) if n <= budget))


_libraries = {}


def _library(file):
    return _libraries.setdefault(file, Tokenizer.from_file(file))


@settings(max_examples=300, deadline=None)
@cases(st.lists(PIECES, max_size=14))
def test_words_encode_as_whole_texts(parts):
    text = "".join(parts)
    ids, n = tf.encoder(WORDS, 1).encode([text.encode()])
    assert ids.tolist() == [*_library(WORDS).encode(text, add_special_tokens=False).ids, 1] and n.tolist() == [len(ids)]


def test_characters_are_classed_as_the_library_does(counter, library):
    split = library.pre_tokenizer.pre_tokenize_str
    alike = regex.compile(f"[{tc.ALIKE}]")
    for c in range(1, sys.maxunicode):
        ch = chr(c)
        if not alike.match(ch):
            continue
        s = f"a{ch}1{ch}!{ch} {ch}"
        want = [s[a:b] for _, (a, b) in split(s)]
        assert counter.words.findall(s) == want, hex(c)
        if c < 0x250:
            assert counter.latin_words.findall(s) == want, hex(c)


def test_counts_and_tables_of_given_documents(spark, given, given_docs, library):
    want = [len(e.ids) for e in library.encode_batch([t for _, t in given], add_special_tokens=False)]
    rows = {r.doc_id: r for r in tc.token_counts(given_docs, BYTES).collect()}
    assert [rows[i].n_tokens for i, _ in given] == want
    assert all(rows[i].n_bytes == len(t.encode()) and rows[i].over_limit == (n > 512) for (i, t), n in zip(given, want))
    table = {r.doc_id: r for r in tc.prefix_table(given_docs, BYTES).collect()}
    for (i, t), n in zip(given, want):
        assert table[i].n_tokens == n and len(table[i].steps) == 2 * len(t)
        assert tc.longest_prefix(table[i].steps, 512) == rows[i].limit_chars
        cut = t[: rows[i].limit_chars]
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 512


def test_counts_of_odd_rows(odd, odd_rows, empty, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(odd, BYTES).collect())
    want = Counter()
    for i, t, _, _ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert tc.token_counts(empty, BYTES).count() == 0 and tc.prefix_table(empty, BYTES).count() == 0


def test_files_round_trip(odd, odd_rows, empty, given, given_docs, tmp_path):
    for docs, rows in ((given_docs, given), (odd, [(i, t) for i, t, _, _ in odd_rows])):
        rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        at, want = 0, Counter()
        for i, t in rows:
            ids = np.array([*_library(WORDS).encode(t, add_special_tokens=False).ids, 1], "<u4")
            want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
            at += len(ids)
        assert Counter(map(tuple, tf.token_files(docs, WORDS).collect())) == want
    assert tf.token_files(empty, WORDS).count() == 0


def test_files_hold_the_ids_in_order(spark, given, given_docs, tmp_path):
    folder = str(tmp_path / "ids")
    manifest = tf.write_ids(given_docs, WORDS, folder).orderBy("base").collect()
    flat = np.concatenate([tf.read_file(folder, r.file)[2] for r in manifest])
    want = [x for e in _library(WORDS).encode_batch([t for _, t in given], add_special_tokens=False) for x in [*e.ids, 1]]
    assert flat.tolist() == want and [r.base for r in manifest] == np.cumsum([0, *(r.n_tokens for r in manifest)])[:-1].tolist()
    with pytest.raises(Exception, match="ids do not fit"):
        tf.write_ids(given_docs, WORDS, folder, dtype="<u1").collect()
