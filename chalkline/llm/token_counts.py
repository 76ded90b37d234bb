"""Exact token counts at every prefix (operator 1).

A byte-pair encoding ends, for every prefix of a word, in exactly one token that may follow the last token of the
shorter prefix before it. Going through a word once from left to right therefore gives the count of every prefix:
`count[i] = count[j] + 1`, where `word[j:i]` is that token. Texts are split into words as the tokenizer's pattern
does; a table of counts per prefix then answers "how many tokens has this prefix" and "how far does a budget reach"
by lookup, with no text encoded again.

Results for odd input: null text counts as empty (0 tokens); null and repeated ids are rows like others; an empty
table gives no rows; other columns are ignored; strings of special tokens inside a text are one token each, as is
the library's default; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow
from chalkline.llm.common import text_of

#: The split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern with the classes of Latin letters spelled out, for texts below U+0250; checked against the above by a test.
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN_PATTERN = (
    f"'(?:[stmd]|re|ve|ll)| ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+| ?[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+"
    f"|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")
#: Characters that the pattern library and the tokenizer's own splitter are tested to class alike; other texts use the latter.
ALIKE = "\x00-\u0530\u0590-\u0880\u2000-\u2060\u3040-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
#: Words and token pairs remembered by one worker.
REMEMBERED = 500_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class PrefixCounter:
    """Counts for one vocabulary file; made once in each worker."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = [raw(t) for t in spec["model"]["vocab"]]
        self.tokens = {t: i for i, t in enumerate(self.bytes_of)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.tokens))
        self.file = file
        self._own = None
        self.words = regex.compile(PATTERN)
        self.latin_words, self.beyond_latin = re.compile(LATIN_PATTERN), re.compile("[^\x00-\u024f]")
        self.unlike = regex.compile(f"[^{ALIKE}]")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.space = regex.compile(r"\s+")
        self._follows: dict[int, bool] = {}
        self.total = _Totals(self)

    def _merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _pair(self, key: int) -> bool:
        """Whether one token can come right after another: encoding both together gives the two again."""
        if len(self._follows) >= REMEMBERED:
            self._follows.clear()
        a, b = self.bytes_of[key >> 32], self.bytes_of[key & 0xFFFFFFFF]
        known = self._follows[key] = self._merged(a + b) == [a, b]
        return known

    def word_prefixes(self, word: bytes) -> list[int]:
        """Token counts of all byte prefixes of one word, from the empty one to the whole."""
        n, longest, get, known = len(word), self.longest, self.tokens.get, self._follows.get
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = get(word[j:i])
                if t is None:
                    continue
                if j:
                    key = last[j] << 32 | t
                    ok = known(key)
                    if not (self._pair(key) if ok is None else ok):
                        continue
                counts[i], last[i] = counts[j] + 1, t
                break
        return counts

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not self.beyond_latin.search(text):
            return self.latin_words.findall(text)
        if not self.unlike.search(text):
            return self.words.findall(text)
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.file).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._own.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens; True marks those."""
        if self.special is None or "<" not in text and not self.special.search(text):
            return [(text, False)]
        return [(p, i % 2 == 1) for i, p in enumerate(self.special.split(text)) if p]

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self.total.__getitem__, self.split(p))) for p, special in self.pieces(text))

    def _chars(self, word: str) -> list[int]:
        """Counts of all character prefixes of one word, the empty one left out."""
        by_byte, at, out = self.word_prefixes(word.encode()), 0, []
        for c in word:
            at += len(c.encode())
            out.append(by_byte[at])
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """counts[i] = tokens of text[:i], for every i from 0 to len(text)."""
        out, base = [0], 0
        done = ""
        for piece, special in self.pieces(text):
            if special:
                # A cut inside the special string leaves ordinary letters behind what came before.
                out += [base - self.count(done) + self.count(done + piece[:k]) for k in range(1, len(piece))] + [base + 1]
                base, done = base + 1, ""
                continue
            at, counts = 0, []
            for w in self.split(piece):
                c = self._chars(w)
                if len(w) == 3 and w in ("'re", "'ve", "'ll"):
                    c[1] = 2  # cut after two characters it is a quote and a letter
                counts += [base + x for x in c]
                base += c[-1]
                at += len(w)
            starts = [0]  # tokens of the whole words before each character
            for w in self.split(piece):
                starts += [starts[-1]] * (len(w) - 1) + [starts[-1] + self.total[w]]
            first = base - starts[-1]
            for m in self.space.finditer(piece):  # white space at the end of a text is one word
                counts[m.start() : m.end()] = [first + starts[m.start()] + x for x in self._chars(m.group())]
            out += counts
            done = piece
        return np.asarray(out, dtype=np.int32)

    def reach(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the whole text, characters of its longest prefix with no more than `budget` tokens)."""
        pieces = self.pieces(text)
        if len(pieces) > 1 or pieces[0][1]:
            counts = self.prefixes(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
        words = self.split(text)
        sums = np.cumsum(np.fromiter(map(self.total.__getitem__, words), dtype=np.int64, count=len(words)))
        if not len(words) or sums[-1] <= budget:
            return int(sums[-1]) if len(words) else 0, len(text)
        # Only words whose own start is below the budget can hold the cut; a few words on either side decide white space.
        k = int(np.searchsorted(sums, budget, side="left"))
        low = max(0, k - 1)
        while low > 0 and words[low][:1].isspace():
            low -= 1
        high = k + 2
        while high < len(words) and words[high - 1].isspace():
            high += 1
        base, chars = (int(sums[low - 1]) if low else 0), sum(map(len, words[:low]))
        local = self.prefixes("".join(words[low:high]))
        return int(sums[-1]), chars + int(np.flatnonzero(local <= budget - base)[-1])


class _Totals(dict):
    """word -> tokens of the whole word: the last cell of its prefix counts."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.counter.word_prefixes(word.encode())[-1]
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def token_counts(docs: DataFrame, file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, limit_chars (how many characters the limit reaches)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file)
        for b in batches:
            both = [c.reach(t.as_py(), limit) for t in b.column("text")]
            n = np.array([x[0] for x in both], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit), pa.array([x[1] for x in both], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_table(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and `steps`, the change of the count from each character prefix to the next (int16, little-endian)."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file)
        for b in batches:
            counts = [c.prefixes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([int(x[-1]) for x in counts], pa.int64()), pa.array([np.diff(x).astype("<i2").tobytes() for x in counts], pa.binary())],
                names=["doc_id", "n_tokens", "steps"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(rows, table, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, steps binary")


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix with no more than `budget` tokens, from a row of `prefix_table`."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype="<i2"), dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1])
