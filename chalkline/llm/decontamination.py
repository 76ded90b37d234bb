"""Benchmark decontamination by latent semantic retrieval (operator 10).

Benchmark items are cut into passages. Document frequencies of their terms are counted over all documents, and the
passages become TF-IDF rows of a matrix. Its leading right singular vectors come from a randomised SVD by subspace
iteration: each round, tasks multiply their rows by the current basis and back, and the products are added up. Documents
are read in windows of several widths. A window whose weight lies mostly outside the benchmark's terms cannot be
close to a passage (its projection is no longer than its part inside) and is passed over. As the projection is linear,
each term has one row of products with all projected passages; rows are added up over cells of four words, and wider
windows by adding their halves, so that a word is looked up once for all widths. Passages within the cosine bound are
candidates. The rank follows the block: it grows until every passage keeps KEEP of its norm, and cosines are taken with
the projected passage. Passages that share three words in a row with a
document, and enough of their words for a leak, are candidates whatever their cosine, so no verbatim passage is missed.
For candidates the longest common subsequence of words decides, with a check for the passage's answer where the
subsequence alone leaves doubt. All of it happens in the pass that reads the documents; no text is shuffled.

Terms are lower-case words without outer punctuation. A document is a leak of an item if, for one of the item's
passages, the subsequence covers LCS_SURE of its words, or LCS_DOUBT and the answer stands there in one piece (the
answer column's words, else the passage's last words). The benchmark is the query set: its terms and passages go to
the tasks in blocks of about BLOCK_PASSAGES passages, fewer where passages times terms, and with it the basis at full
rank, would pass BLOCK_CELLS. Only a single item of more passages makes a larger block.

Results for odd input: null text counts as empty; null or empty items, and passages of under MIN_WORDS words, match
nothing; passages under SHORT words count only in one piece; repeated rows each give their own results; an empty
table or benchmark gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow, slices
from chalkline.llm.common import text_of
from chalkline.llm.shingles import GOLDEN, mixed

PASSAGE, ROUNDS = 64, 3
#: Passages that the driver reads at a time, passages and passages x terms of a block.
READ_PASSAGES, BLOCK_PASSAGES, BLOCK_CELLS = 20_000, 1000, 1 << 24
#: First rank, and the share of its norm that every passage keeps.
RANK, KEEP = 256, 0.9
WIDTHS = (8, 16, 32, 64)
#: The cosine that makes a candidate; a window with less than its square of squared weight inside the benchmark's terms has none.
COSINE = 0.35
LCS_SURE, LCS_DOUBT, ANSWER_WORDS, SHORT, MIN_WORDS = 0.8, 0.6, 4, 8, 3
#: Document frequencies count as this share at least, so that weights do not grow with the number of documents. Other
#: terms than the block's are counted by hash (never too low), in so many places.
RAREST, OTHERS = 1e-3, 1 << 16
STRIP = string.punctuation + "¡¿«»“”„‘’…–—"
#: Bytes of text that a task compares at a time.
SLICE = 1 << 21
RESULT = "item_id long, cosine double, lcs int, passage_words int, answer boolean, first_word int, last_word int"


def terms_of(words: pa.Array) -> pa.Array:
    """The terms of words (strings): lower case, without outer punctuation; bytes that are no text become replacement signs."""
    try:
        return pc.utf8_trim(pc.utf8_lower(words), characters=STRIP)
    except pa.ArrowInvalid:
        return terms_of(pa.array([w.decode(errors="replace") for w in words.view(pa.binary()).to_pylist()], pa.string()))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words of all texts, their places for the words one after the other, words of each text)."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    words = lists.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.diff(lists.offsets.to_numpy())


@dataclass
class Passages:
    """One block of benchmark passages: terms, weights and latent vectors."""

    vocab: dict[str, int]
    items: list
    rows: list[np.ndarray]  # term numbers in order
    answers: list[np.ndarray]
    idf: np.ndarray = None
    others: np.ndarray = None  # weights of other terms by hash
    basis: np.ndarray = None  # [term, rank]
    latent: np.ndarray = None  # [rank, passage], divided by the projected passage's norm
    products: np.ndarray = None  # [term, passage] of weighted terms and latent passages; the last row, of no term, is 0
    anchors: tuple = None

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Term numbers; -10 and below for the hash of other terms, -2 for words that are punctuation alone."""
        terms = terms_of(words)
        known = pc.index_in(terms, value_set=pa.array(list(self.vocab), pa.string()))
        out = pc.fill_null(known, -2).to_numpy(zero_copy_only=False).astype(np.int64)
        other = np.flatnonzero((out < 0) & (pc.binary_length(terms).to_numpy(zero_copy_only=False) > 0))
        hashed = map(zlib.crc32, terms.take(pa.array(other)).view(pa.binary()).to_numpy(zero_copy_only=False))
        out[other] = -10 - np.fromiter(hashed, np.int64, len(other)) % OTHERS
        return out

    def __getstate__(self):
        """What tasks need: the products take the place of the vectors that they come from."""
        return self.__dict__ | ({"basis": None, "latent": None} if self.products is not None else {})

    def multiply(self) -> None:
        self.products = np.zeros((len(self.vocab) + 1, len(self.rows)), np.float32)
        np.matmul(self.basis * self.idf[:, None].astype(np.float32), self.latent, out=self.products[:-1])

    def matrix(self, rows: list[int]) -> np.ndarray:
        """TF-IDF rows, each of length 1."""
        out = np.zeros((len(rows), len(self.vocab)))
        for i, r in enumerate(rows):
            np.add.at(out[i], self.rows[r], 1.0)
        out *= self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def anchor(self) -> None:
        """Three words in a row of every passage, by their key; of a short passage, which counts in one piece, the first three."""
        sizes = np.array([len(r) for r in self.rows])
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(self.rows)
        count = np.where(sizes < SHORT, 1, sizes - 2)
        passage = np.repeat(np.arange(len(sizes)), count)
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        key = trigrams(flat, starts[passage] + offset)
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        marks = np.zeros(1 << 20, bool)
        marks[keys >> np.uint64(44)] = True
        self.anchors = keys, np.append(first, len(key)), passage[order], offset[order], marks, flat, starts, sizes


def trigrams(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of the three terms from each place."""
    a, b, c = (ids[at + k].astype(np.uint64) for k in range(3))
    return mixed((a * GOLDEN + b) * GOLDEN + c)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> Iterator[Passages]:
    """The benchmark in blocks of bounded size."""
    answer = text_of(answer_col) if answer_col else F.lit("")
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text"), answer.alias("answer"))
    size = rows.agg(F.sum(F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+")) / (PASSAGE // 2)))).first()[0] or 0
    n = max(1, math.ceil(size / READ_PASSAGES))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        vocab, items, terms, answers = {}, [], [], []
        for r in got:
            if len(items) >= BLOCK_PASSAGES or len(items) * len(vocab) > BLOCK_CELLS:
                yield Passages(vocab, items, terms, answers)
                vocab, items, terms, answers = {}, [], [], []
            words, own = ([t for t in terms_of(pa.array(r[c].split(), pa.string())).to_pylist() if t] for c in ("text", "answer"))
            for at in range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2):
                piece = words[at : at + PASSAGE]
                if len(piece) < MIN_WORDS or r["item"] is None:
                    continue
                items.append(r["item"])
                terms.append(np.array([vocab.setdefault(t, len(vocab)) for t in piece]))
                answers.append(np.array([vocab.setdefault(t, len(vocab)) for t in (own or piece[-ANSWER_WORDS:])]))
        if items:
            yield Passages(vocab, items, terms, answers)


def weigh(p: Passages, docs: DataFrame, text_col: str) -> None:
    """Inverse document frequencies over all documents, by the share of documents; the block's terms each, others by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, other, n = np.zeros(len(p.vocab), np.int64), np.zeros(OTHERS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for a, z in slices(b.column("body"), most=SLICE):
                words, at, sizes = split(b.column("body")[a:z])
                ids = p.numbers(words)[at]
                row = np.repeat(np.arange(z - a), sizes)
                other += np.bincount(np.unique(row[ids <= -10] * OTHERS - 10 - ids[ids <= -10]) % OTHERS, minlength=OTHERS)
                row = row[ids >= 0]
                ids = ids[ids >= 0]
                if (z - a) * len(p.vocab) <= 1 << 24:  # a small table of marks, else sorting
                    marks = np.zeros((z - a, len(p.vocab)), bool)
                    marks[row, ids] = True
                    seen += marks.sum(axis=0)
                else:
                    seen += np.bincount(np.unique(row * len(p.vocab) + ids) % len(p.vocab), minlength=len(p.vocab))
        at, by = np.flatnonzero(seen), np.flatnonzero(other)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1], -10 - by])), pa.array(np.concatenate([seen[at], [n], other[by]]))], names=["term", "n"])

    parts = map_arrow(docs.select(text_of(text_col).cast("binary").alias("body")), count, "term long, n long")
    totals = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist()}  # one row a term of the block, and a hash
    n = totals.get(-1, 0)
    df = np.array([totals.get(i, 0) for i in range(len(p.vocab))])
    other = np.array([totals.get(-10 - i, 0) for i in range(OTHERS)])
    p.idf, p.others = (np.minimum(np.log((1 + n) / (1 + x)), -math.log(RAREST)) + 0.1 for x in (df, other))


def decompose(p: Passages, docs: DataFrame) -> None:
    """Leading right singular vectors of the passages' matrix by distributed subspace iteration, as many as the passages need."""
    spark, v = docs.sparkSession, len(p.vocab)
    full = min(v, len(p.rows))
    rank = min(RANK, full)
    rows = spark.range(0, len(p.rows), 1, max(1, min(32, len(p.rows) // 500)))

    def product(batches: Iterator[pa.RecordBatch], z: np.ndarray, gram: bool) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank) if gram else (v, rank))
        for b in batches:
            ids = b.column("id").to_pylist()
            for at in range(0, len(ids), 256):
                a = p.matrix(ids[at : at + 256])
                y = a @ z
                total += y.T @ y if gram else a.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def summed(z: np.ndarray, gram: bool) -> np.ndarray:
        parts = map_arrow(rows, lambda it: product(it, z, gram), "part binary").collect()  # at most 32 matrices of the block's terms by rank
        return sum(np.frombuffer(bytes(r["part"])) for r in parts).reshape((rank, rank) if gram else (v, rank))

    while True:
        basis = np.linalg.qr(np.random.default_rng(5).normal(size=(v, rank)))[0]
        for _ in range(ROUNDS):
            basis = np.linalg.qr(summed(basis, False))[0]
        values, turn = np.linalg.eigh(summed(basis, True))
        basis = basis @ turn[:, np.argsort(values)[::-1]]
        latent = np.concatenate([(p.matrix(list(range(a, min(a + 256, len(p.rows))))) @ basis).astype(np.float32) for a in range(0, len(p.rows), 256)])
        kept = np.linalg.norm(latent, axis=1, keepdims=True)  # of 1
        if rank == full or kept.min() >= KEEP:
            break
        rank = min(full, max(2 * rank, int(rank * (KEEP / max(float(kept.min()), 0.01)) ** 2)))
    p.basis, p.latent = basis.astype(np.float32), (latent / np.maximum(kept, 1e-9)).T


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a sequence of n words whose places are given as bits of each word."""
    full = (1 << n) - 1
    row = full
    for places in filter(None, map(masks.get, words)):  # other words change nothing
        u = row & places
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _holds(words: list[int], piece: list[int]) -> bool:
    k = len(piece)
    return any(words[i : i + k] == piece for i in range(len(words) - k + 1)) if k else False


def is_leak(n: int, found: tuple) -> bool:
    """Whether (longest common subsequence, answer found, ...) makes a leak of a passage of n words."""
    return found[0] == n if n < SHORT else found[0] >= LCS_SURE * n or found[0] >= LCS_DOUBT * n and found[1]


def verdict(p: Passages, j: int, ids: list[int], a: int, z: int) -> tuple[int, bool, int, int]:
    """(longest common subsequence of passage j near words a..z of a document, answer found, first and last word of the place)."""
    piece = p.rows[j].tolist()
    n = len(piece)
    masks: dict[int, int] = {}
    for i, w in enumerate(piece):
        masks[w] = masks.get(w, 0) | 1 << i
    width, lo, hi = math.ceil(1.3 * n), max(0, a - n), min(len(ids), z + n)
    answer = p.answers[j].tolist()
    if n < SHORT:
        for i in range(lo, hi - n + 1):
            if ids[i : i + n] == piece:
                return n, True, i, i + n
        return 0, False, a, z
    if lcs(masks, n, ids[lo:hi]) < LCS_DOUBT * n:
        return 0, False, a, z
    best, last, k = (0, False, a, z), max(lo, hi - width), len(answer)
    # The last words of the stretch have a window too, and so has every place of the answer, as its end and as its start.
    starts = {last, *range(lo, last, max(1, n // 8))}
    starts |= {min(last, max(lo, x)) for i in range(lo, hi - k + 1) if ids[i : i + k] == answer for x in (i + k - width, i)} if k else set()
    for i in sorted(starts):
        # The answer may adjoin the window.
        found = lcs(masks, n, ids[i : i + width]), _holds(ids[max(0, i - k) : i + width + k], answer), i, min(len(ids), i + width)
        best = max(best, found, key=lambda x: (is_leak(n, x), x[:2]))
    return best


def repeats(ids: np.ndarray) -> np.ndarray:
    """How often a word's term stands in as many words up to it as the widest window has.

    In a window, a term that stands tf times there has tf squared, the sum of the first tf odd numbers, of its squared
    weight. As the k-th of them counts k or more here, sums of 2 * repeats - 1 are never too small.
    """
    n = len(ids)
    key = np.sort((ids - ids.min()) * (n + WIDTHS[-1]) + np.arange(n))
    out = np.empty(n, np.int64)
    out[key % (n + WIDTHS[-1])] = np.arange(n) - np.searchsorted(key, key - (WIDTHS[-1] - 1)) + 1
    return out


def matches(p: Passages, texts) -> list[tuple]:
    """(text number, item, cosine, lcs, passage words, answer, first word, last word) of every leak."""
    if p.products is None:
        p.multiply()
    words, at, sizes = split(pa.array(texts, pa.binary()))
    ids = p.numbers(words)[at]
    row, plain = np.repeat(np.arange(len(texts)), sizes), ids != -2
    ids, row = ids[plain], row[plain]
    n = len(ids)
    if not n:
        return []
    known = ids >= 0
    weight = np.where(known, p.idf[np.maximum(ids, 0)], p.others[np.where(known, 0, -10 - ids)])
    inside, outside = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(known, (2 * repeats(ids) - 1) * weight**2, 0), np.where(known, 0, weight**2)))
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    near: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    windows = []
    for width in WIDTHS:
        length = np.diff(first)
        count = np.where(length <= width, (length > 0).astype(np.int64) * (width == WIDTHS[0]), -(-(length - width) // (width // 2)) + 1)
        count = np.where((length > 0) & (length <= width) & (width != WIDTHS[0]) & (length > width // 2), 1, count)
        text = np.repeat(np.arange(len(texts)), count)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        a = first[text] + step * (width // 2)
        z = np.minimum(a + width, first[text + 1])
        part = inside[z] - inside[a]
        keep = (part > 0) & (part * (1 + 1e-9) >= COSINE**2 * (part + outside[z] - outside[a]))
        windows.append((a[keep], z[keep], text[keep]))
    for a, z, text, j, product in _close(p, ids, weight, first, windows):
        cosine = product / np.maximum(_norms(p, ids, weight, a, z), 1e-9)
        for c, t, k, x, y in zip(*(v[cosine >= COSINE].tolist() for v in (cosine, text, j, a, z))):
            near.setdefault((t, k), []).append((c, x, y))
    _anchored(p, ids, row, first, near)
    out = []
    for (t, j), places in near.items():
        own = ids[first[t] : first[t + 1]].tolist()
        best, cosine, k = (0, False, 0, 0), 0.0, len(p.rows[j])
        done = -1
        for c, a, z in sorted(places, key=lambda x: x[1]):
            cosine = max(cosine, c)
            if z - int(first[t]) <= done:  # wholly inside a stretch that was compared already
                continue
            found = verdict(p, j, own, a - int(first[t]), z - int(first[t]))
            best = max(best, found, key=lambda x: (is_leak(k, x), x[:2]))
            done = z - int(first[t])
        if is_leak(k, best):
            if not cosine:  # found by its words
                a, z = first[t] + np.array([[best[2]], [best[3]]])
                own = ids[a[0] : z[0]]
                cosine = float(p.products[own[own >= 0], j].sum() / max(_norms(p, ids, weight, a, z)[0], 1e-9))
            out.append((t, p.items[j], cosine, best[0], k, best[1], best[2], best[3]))
    # Of an item's passages the best stands for it.
    once: dict[tuple, tuple] = {}
    for r in sorted(out, key=lambda r: (r[3] / r[4], r[2])):
        once[r[0], r[1]] = r
    return [once[k] for k in sorted(once)]


def _norms(p: Passages, ids, weight, a, z) -> np.ndarray:
    """The length of the weights of the words a..z of each window."""
    window, back = np.unique(a * (len(ids) + 1) + z, return_inverse=True)
    a, z = window // (len(ids) + 1), window % (len(ids) + 1)
    n = z - a
    win = np.repeat(np.arange(len(a)), n)
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    term_of, w = ids[at], weight[at]
    other = np.bincount(win[term_of < 0], weights=w[term_of < 0] ** 2, minlength=len(a))
    v = len(p.vocab)
    key, tf = np.unique(win[term_of >= 0] * v + term_of[term_of >= 0], return_counts=True)
    x = tf * p.idf[key % v]
    return np.sqrt(np.bincount(key // v, weights=x * x, minlength=len(a)) + other)[back]


def _close(p: Passages, ids, weight, first, windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(first word, end, text, passage, product) of windows that may be within the cosine; windows has three arrays a width.

    Half the widest window is a span of eight cells. Spans with windows to compare lie one after the other, with an
    empty span wherever the next one does not follow in the text. A window's norm is no less than if each of its words
    stood alone in it; only what passes that bound is returned.
    """
    cell, span = WIDTHS[0] // 2, WIDTHS[-1] // 2
    spans = -(-np.diff(first) // span)
    base = np.cumsum(spans) - spans
    text_of_span = np.repeat(np.arange(len(spans)), spans)
    begin = first[text_of_span] + (np.arange(len(text_of_span)) - base[text_of_span]) * span
    needed = np.zeros(len(begin) + 1, bool)
    where = []
    for a, z, text in windows:
        s = base[text] + (a - first[text]) // span
        needed[s] = True
        needed[s[z > begin[s] + span] + 1] = True
        where.append(s)
    used = np.flatnonzero(needed[:-1])
    if not len(used):
        return
    last = np.append((np.diff(used) > 1) | (np.diff(text_of_span[used]) > 0), True)
    row_of = np.zeros(len(begin), np.int64)
    row_of[used] = np.arange(len(used)) + np.cumsum(last) - last
    total = len(used) + int(last.sum())
    place = begin[used][:, None] + np.arange(span)
    own = place < first[text_of_span[used] + 1][:, None]
    words = np.full((total, span // cell, cell), len(p.vocab), np.int64)
    got = ids[np.where(own, place, 0)]
    words[row_of[used]] = np.where(own & (got >= 0), got, len(p.vocab)).reshape(-1, span // cell, cell)
    squares = np.concatenate([[0.0], np.cumsum(weight**2)])
    bounds, numbers = [], []
    for (a, z, text), s, width in zip(windows, where, WIDTHS):
        slot = row_of[s], (a - begin[s]) // (width // 2)
        bound = np.full((total, 2 * span // width), np.inf, np.float32)
        bound[slot] = COSINE * (1 - 1e-4) * np.sqrt(squares[z] - squares[a])
        number = np.zeros(bound.shape, np.int64)
        number[slot] = np.arange(len(a))
        bounds.append(bound)
        numbers.append(number)
    most = max(1, (1 << 19) // (span // cell * len(p.rows)))  # spans at a time, for 2 MB of products
    for at in range(0, total - 1, most):
        here = words[at : at + most + 1]  # with the span that follows
        n = len(here) - 1
        sums = p.products[here[:, :, 0]]
        for k in range(1, cell):
            sums += p.products[here[:, :, k]]
        sums = sums.reshape(-1, len(p.rows))
        for width, (a, z, text), bound, number in zip(WIDTHS, windows, bounds, numbers):
            sums = sums[:-1] + sums[1:] if width == WIDTHS[0] else sums[:-2:2] + sums[2::2]
            limit = bound[at : at + n].reshape(-1)
            high = np.flatnonzero(sums[: len(limit)].max(axis=1) >= limit)
            if len(high):
                w, j = np.nonzero(sums[high] >= limit[high, None])
                k = number[at : at + n].reshape(-1)[high[w]]
                yield a[k], z[k], text[k], j, sums[high[w], j]


def _anchored(p: Passages, ids, row, first, near) -> None:
    """Passages with three words in a row of a text, and as many of their words in it as a leak has."""
    keys, starts, passage, offset, marks, flat, begin, sizes = p.anchors
    at = np.flatnonzero((ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0) & (row[:-2] == row[2:]))
    key = trigrams(ids, at)
    maybe = marks[key >> np.uint64(44)]
    at, key = at[maybe], key[maybe]
    slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    at, slot = at[keys[slot] == key], slot[keys[slot] == key]
    has = np.zeros(len(p.vocab), bool)
    for t in np.unique(row[at]):
        a, z = np.searchsorted(at, first[t]), np.searchsorted(at, first[t + 1])
        count = starts[slot[a:z] + 1] - starts[slot[a:z]]
        post = np.repeat(starts[slot[a:z]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        j, from_ = passage[post], np.repeat(at[a:z], count) - offset[post]
        own = ids[first[t] : first[t + 1]]
        has[own[own >= 0]] = True
        which, back = np.unique(j, return_inverse=True)
        n = sizes[which]
        words = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        there = np.add.reduceat(has[flat[words]].astype(np.int64), np.cumsum(n) - n)
        has[own[own >= 0]] = False
        enough = (there >= np.where(n < SHORT, n, LCS_DOUBT * n))[back]
        for k, x in {(int(k), int(x)) for k, x in zip(j[enough], from_[enough])}:
            near.setdefault((int(t), k), []).append((0.0, max(x, int(first[t])), min(x + int(sizes[k]), int(first[t + 1]))))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
) -> DataFrame:
    """One row per leaking document and item: doc_id, item_id, cosine, lcs, passage_words, answer, first_word, last_word, text64 (hash of the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text64"), text_of(text_col).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
    names = ["item_id", "cosine", "lcs", "passage_words", "answer", "first_word", "last_word"]
    out = None
    for p in blocks(benchmark, item_col, item_text_col, answer_col):
        weigh(p, docs, text_col)
        decompose(p, docs)
        p.multiply()
        p.anchor()

        def search(batches: Iterator[pa.RecordBatch], p: Passages = p) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, z in slices(b.column("body"), most=SLICE):
                    found = matches(p, b.column("body")[a:z])
                    if found:
                        cols = list(zip(*found))
                        pick = pa.array([a + t for t in cols[0]])
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(pick), b.column("text64").take(pick), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=["doc_id", "text64", *names])

        part = map_arrow(rows, search, f"doc_id {kind}, text64 long, {RESULT}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, text64 long, {RESULT}")
