"""Phrase collocations by Rabin-Karp fingerprints (operator 12).

Words get 64-bit hashes. Over the words of a run of texts, prefix polynomials with an odd base (modulo 2^64, where the
base has an inverse) give the fingerprint of every n-gram from one cumulative sum; a second polynomial gives 32 check
bits. Within a run each occurrence is compared with the words of the first one of its fingerprint, and differing ones
stay apart. A run gives one row per different n-gram: fingerprint, check, count and a pointer to a document that holds
it. A shuffle adds up the rows. Texts are read three times:

1. Words and pairs are counted. The frequent ones are marked in a bit field of fixed size (FIELD_BITS, 8 MB), in which
   nothing frequent is missing.
2. Longer n-grams are counted, only those whose pairs are all marked (any other cannot be frequent).
3. The documents that the pointers of frequent phrases name are read; a phrase becomes text where its words have the
   fingerprint. Only frequent phrases are ever materialised.

Sums over runs trust 96 bits of fingerprint. The bit field only saves shuffling: in a corpus with so many frequent
phrases that it fills up, results are the same. Phrases are compared per language, which is part of the fingerprint;
no sum or join is over a language alone, and the last ranking keeps the first rows of each before it shuffles.

Results for odd input: a null text counts as empty, a null language as `und`; a null id is a value like others, and
repeated rows count as often as they stand there; words are taken as they are, of any length; a piece is held whole by
a task, longer texts are cut between pieces; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow, slices
from chalkline.llm.common import staged, text_of

#: Words of a phrase at most.
LONGEST = 4
#: Ends of pieces, or words.
TOKEN = re.compile(r"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
STOP = re.compile(r"[.,;:!?\x0A-\x0D]")
#: Bytes of text taken in at once, words of a run, and characters after which a long text is cut at the next end of a piece.
SLICE_BYTES, RUN_WORDS, CUT_CHARS = 4 << 20, 1_500_000, 4 << 20
#: Odd bases of the two polynomials.
BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Size of the bit field of frequent fingerprints, and the bits that one of its pieces holds.
FIELD_BITS, PIECE_BITS = 26, 15
GRAMS = "print long, check int, n int, doc long"
PHRASES = "lang string, words int, phrase string, print long, check int, inner array<struct<at:int,words:int,print:bigint,check:int>>"


def stretches(text: str) -> Iterator[str]:
    """The text in stretches that end between pieces."""
    start = 0
    while len(text) - start > CUT_CHARS:
        stop = STOP.search(text, start + CUT_CHARS)
        if not stop:
            break
        yield text[start : stop.end()]
        start = stop.end()
    yield text[start:] if start else text


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def fingerprints(hashes: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """The fingerprint of each n-gram of a sequence of word hashes, from prefix polynomials."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, size), dtype=np.uint64)])
    return (prefix[n:] - prefix[:-n]) * powers(pow(base, -1, 1 << 64), size - n + 1)


class Printer:
    """Fingerprints of one language: its name and the length of a phrase are part of them."""

    def __init__(self, lang: str, mask: int):
        self.salts, self.mask = [np.uint64(xxhash.xxh64_intdigest(f"{k} {lang}")) for k in range(LONGEST + 1)], np.uint64(mask)

    def prints(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (fingerprints(hashes, k) ^ self.salts[k]) & self.mask

    def checks(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((fingerprints(hashes, k, CHECK_BASE) ^ (self.salts[k] << np.uint64(32))) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


class Run:
    """Texts of one language as numbers: words, the pieces they stand in and their documents."""

    def __init__(self, lang: str, mask: int):
        self.printer = Printer(lang, mask)
        self.empty()

    def empty(self) -> None:
        self.words: dict[str, int] = {}
        self.hashes, self.stops = [], []
        self.codes, self.pieces, self.docs, self.size, self.piece = [], [], [], 0, 0

    def add(self, texts: list[str], keys: np.ndarray) -> Iterator[None]:
        """Take texts in; stops where the run is full, and goes on when it is emptied."""
        tokens: list[str] = []
        sizes, docs, size = [], [], 0
        for text, key in zip(texts, keys):
            for part in stretches(text):
                found = TOKEN.findall(part)
                tokens += found
                sizes.append(len(found))
                docs.append(key)
                size += len(part)
                if size > SLICE_BYTES:
                    self._take(tokens, sizes, docs)
                    tokens, sizes, docs, size = [], [], [], 0
                    if self.size > RUN_WORDS:
                        yield
        self._take(tokens, sizes, docs)
        if self.size > RUN_WORDS:
            yield

    def _take(self, tokens: list[str], sizes: list[int], docs: list) -> None:
        if not tokens:
            return
        codes, words = pd.factorize(np.array(tokens, dtype=object))
        own = np.empty(len(words), np.int32)
        for i, w in enumerate(words):
            code = self.words.get(w)
            if code is None:
                code = self.words[w] = len(self.words)
                self.hashes.append(word_hash(w))
                self.stops.append(bool(STOP.match(w)))
            own[i] = code
        codes = own[codes]
        stop = np.array(self.stops, bool)[codes]
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        # A piece ends with a stop, or with its stretch.
        piece = np.cumsum(stop) + stretch + self.piece
        self.piece = int(piece[-1]) + 1
        self.codes.append(codes[~stop])
        self.pieces.append(piece[~stop].astype(np.int32))
        self.docs.append(np.array(docs, np.int64)[stretch[~stop]])
        self.size += int((~stop).sum())

    def grams(self, sizes: tuple[int, ...], field: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
        """print, check, n, doc: a row per different n-gram of these lengths; of longer ones only where all pairs are marked."""
        if not self.size:
            return
        codes, piece, doc = (np.concatenate(c) for c in (self.codes, self.pieces, self.docs))
        hashes = np.array(self.hashes, np.uint64)[codes]
        if field is not None:
            pair = np.append(marked(field, self.printer.prints(hashes, 2)), False) if len(codes) > 1 else np.zeros(1, bool)
        for k in sizes:
            if len(codes) < k:
                break
            at = np.flatnonzero(piece[: len(piece) - k + 1] == piece[k - 1 :])
            if field is not None:
                at = at[np.all([pair[at + i] for i in range(k - 1)], axis=0)]
            if len(at):
                prints = self.printer.prints(hashes, k)
                first, n = _folded(prints[at], at, codes, k)
                # In the order of the documents: equal pointers stand together.
                order = np.argsort(first)
                first, n = first[order], n[order]
                yield {"print": prints[first].view(np.int64), "check": self.printer.checks(hashes, k)[first], "n": n.astype(np.int32), "doc": doc[first]}


def _folded(prints: np.ndarray, starts: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence, count) of every different k-gram: equal fingerprints whose words differ stay apart."""
    order = np.argsort(prints)
    p, s = prints[order], starts[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    first = np.flatnonzero(new)
    of = s[first][np.cumsum(new) - 1]
    if not all((codes[s + i] == codes[of + i]).all() for i in range(k)):
        grams = np.stack([codes[s + i] for i in range(k)], axis=1)
        order = np.lexsort((s, *grams.T[::-1], p))
        p, s, grams = p[order], s[order], grams[order]
        new[1:] = (p[1:] != p[:-1]) | (grams[1:] != grams[:-1]).any(axis=1)
        first = np.flatnonzero(new)
    return s[first], np.diff(np.append(first, len(p)))


def marked(field: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set."""
    bit = prints >> np.uint64(64 - FIELD_BITS)
    return (field[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(mask: int, sizes: tuple[int, ...], field=None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if field is None else np.frombuffer(field.value, np.uint8)
        runs: dict[str, Run] = {}

        def rows(run: Run) -> Iterator[pa.RecordBatch]:
            for found in run.grams(sizes, bits):
                for k in range(0, len(found["n"]), 1 << 16):
                    yield pa.RecordBatch.from_pydict({c: v[k : k + (1 << 16)] for c, v in found.items()})
            run.empty()

        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                langs, keys = b.column("lang")[lo:hi].dictionary_encode(), b.column("doc")[lo:hi].to_numpy()
                texts = b.column("text")[lo:hi]
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    here = np.flatnonzero(langs.indices.to_numpy() == code)
                    run = runs.setdefault(lang, Run(lang, mask))
                    for _ in run.add(texts.take(pa.array(here)).to_pylist(), keys[here]):
                        yield from rows(run)
                # All languages together are held to the bound.
                if sum(r.size for r in runs.values()) > RUN_WORDS:
                    for run in runs.values():
                        yield from rows(run)
        for run in runs.values():
            yield from rows(run)

    return count


def _read(mask: int):
    """The phrases of a document that pointers name, with the fingerprints of all shorter ones inside."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("print", pa.int64()), ("check", pa.int32()),
                            ("inner", pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("print", pa.int64()), ("check", pa.int32())])))])
        for b in batches:
            out = []
            for lang, text, spots in zip(b.column("lang").to_pylist(), b.column("text"), b.column("spots")):
                wanted, printer = {(s["print"], s["check"]) for s in spots.as_py()}, Printer(lang, mask)
                sought = np.array([p for p, _ in wanted], np.int64)
                for part in stretches(text.as_py()):
                    tokens = TOKEN.findall(part)
                    stop = np.array([bool(STOP.match(t)) for t in tokens], bool)
                    words, piece = [t for t, s in zip(tokens, stop) if not s], np.cumsum(stop)[~stop]
                    hashes = np.array([word_hash(w) for w in words], np.uint64)
                    prints = {k: printer.prints(hashes, k).view(np.int64) for k in range(1, LONGEST + 1)}
                    checks = {k: printer.checks(hashes, k) for k in range(1, LONGEST + 1)}
                    for k in range(2, LONGEST + 1):
                        if len(words) < k:
                            break
                        for i in np.flatnonzero((piece[: len(piece) - k + 1] == piece[k - 1 :]) & np.isin(prints[k], sought)):
                            name = (int(prints[k][i]), int(checks[k][i]))
                            if name in wanted:
                                wanted.discard(name)
                                inner = [{"at": j, "words": m, "print": int(prints[m][i + j]), "check": int(checks[m][i + j])} for m in range(1, k) for j in range(k - m + 1)]
                                out.append({"lang": lang, "words": k, "phrase": " ".join(words[i : i + k]), "print": name[0], "check": name[1], "inner": inner})
            for k in range(0, len(out), 1 << 12):
                yield pa.RecordBatch.from_pylist(out[k : k + (1 << 12)], schema)

    return read


def _field(prints: DataFrame) -> bytes:
    """A bit for the upper FIELD_BITS bits of every fingerprint; built by the executors in pieces of PIECE_BITS bits, 8 MB in all."""
    bit = prints.select(F.shiftrightunsigned("print", 64 - FIELD_BITS).alias("bit"))
    pieces = bit.groupBy(F.shiftright("bit", PIECE_BITS).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << PIECE_BITS) - 1)).alias("bits"))
    field, size = bytearray(1 << (FIELD_BITS - 3)), 1 << (PIECE_BITS - 3)
    for r in pieces.collect():
        field[r.piece * size : (r.piece + 1) * size] = r.bits
    return bytes(field)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(rows: DataFrame) -> DataFrame:
    """(lang, n): all words of each language, counted without leaving the engine."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))
    return rows.groupBy("lang").agg(F.sum(words.cast("long")).alias("n")).where(F.col("n") > 0)


def frequent_grams(docs: DataFrame, least: int = 30, mask: int = (1 << 64) - 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, phrases, totals).

    counts: print, check, f of all frequent n-grams; phrases: PHRASES and f of those with two words and more; totals: lang, n.
    """
    text = _lower(text_of(text_col))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    rows = rows.select("lang", F.xxhash64("id", "lang", "text").alias("doc"), "text")

    def frequent(sizes: tuple[int, ...], field=None) -> DataFrame:
        # Runs have added up their own rows, so nothing is left to combine before this shuffle.
        grams = map_arrow(rows, _counted(mask, sizes, field), GRAMS).repartition("print", "check")
        found = grams.groupBy("print", "check").agg(F.sum("n").alias("f"), F.min("doc").alias("doc")).where(F.col("f") >= least)
        return staged(found, "frequent-grams")

    short = frequent((1, 2))
    field = rows.sparkSession.sparkContext.broadcast(_field(short))
    counts = short.unionByName(frequent(tuple(range(3, LONGEST + 1)), field))
    spots = counts.groupBy("doc").agg(F.collect_list(F.struct("print", "check")).alias("spots"))  # at most the n-grams of one document
    # Rows that repeat everything are read once; the length tells apart documents whose keys collide.
    texts = rows.withColumn("size", F.length("text")).dropDuplicates(["doc", "size"])
    read = map_arrow(texts.join(spots, "doc").select("lang", "text", "spots"), _read(mask), PHRASES)
    phrases = staged(read.join(counts.select("print", "check", "f"), ["print", "check"]).dropDuplicates(["print", "check"]), "phrases")
    return counts.select("print", "check", "f"), phrases, _words(rows)


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases with the cut that scores lowest: print, check, lang, phrase, a, l, r, score, inner."""
    # A cut has a left part that begins the phrase and a right part that takes the rest.
    part = phrases.select("print", "check", F.col("f").alias("a"), "words", F.explode("inner").alias("i"))
    begins, ends = F.col("i.at") == 0, F.col("i.at") + F.col("i.words") == F.col("words")
    part = part.where(begins | ends).select("print", "check", "a", F.when(begins, F.col("i.words")).otherwise(F.col("i.at")).alias("k"), begins.alias("left"), F.col("i.print").alias("p"), F.col("i.check").alias("c"))
    both = part.join(counts.select(F.col("print").alias("p"), F.col("check").alias("c"), "f"), ["p", "c"])
    cuts = both.groupBy("print", "check", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("print", "check").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return phrases.join(lowest, ["print", "check"]).select("print", "check", "lang", "words", "phrase", F.col("f").alias("a"), "m.l", "m.r", "m.score", "inner")


def without_fragments(phrases: DataFrame, share: int = 80) -> DataFrame:
    """Phrases that no longer one with `share` hundredths of their count or more contains."""
    inner = phrases.where("words > 2").select(F.col("a").alias("b"), F.explode("inner").alias("i")).where("i.words > 1")
    most = inner.groupBy(F.col("i.print").alias("print"), F.col("i.check").alias("check")).agg(F.max("b").alias("b"))
    held = F.expr(f"cast(b as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {share}")
    return phrases.join(most, ["print", "check"], "left").where(F.col("b").isNull() | ~held).drop("b")


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, share: int = 80, mask: int = (1 << 64) - 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `first` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    counts, phrases, totals = frequent_grams(docs, least, mask, id_col, text_col, lang_col)
    kept = without_fragments(scored(phrases, counts), share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", rank).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
