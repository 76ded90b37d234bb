"""Substring dedup by compressed FM-indexes (operator 4).

A window is `window` consecutive words. A document loses every word that lies in a window which also starts in a
document with a smaller id; windows are judged on the input.

1. Rows with the same words are one text; only the row with the smallest id stands for it. Of the others every word
   goes, if they have a window at all.
2. Each window of a text names one of its half-length word sequences, the one with the least hash (the first of
   equals). Windows with the same words name the same sequence, so windows of two texts can only agree where both name
   it; all other parts of a text are left out from here on.
3. Runs of windows with one name are cut out as segments. Equal segments fold together, keeping the least id.
4. Segments are dealt to shards by name, so equal windows meet in one shard. Each shard builds an FM-index of its
   segments and streams them through it: backward search over the wavelet matrix gives matching statistics, and where a
   match reaches the window length its interval tells the least id. A name with very many different segments is dealt
   by window instead, one window to a segment and each different window once.
5. Window starts whose least id is below the own id come back to the texts, and the covered words go.

Words are compared as 64-bit hashes; a window is equal when all its words' hashes are.

Results for odd input: null text has no words; null ids count as larger than every id, and no smaller than each
other; rows that repeat an id are not smaller than each other; texts shorter than a window stay whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow, slices
from chalkline.llm.common import join_on, staged, staged_for_now, text_of
from chalkline.llm.fm_index import FMIndex
from chalkline.llm.shingles import GOLDEN, mixed, word_hashes

WINDOW = 50
#: Words of a shard's index, and different segments of one name above which it is dealt by window.
SHARD_WORDS, NAME_SEGMENTS = 250_000, 10_000
NO_ID = (1 << 63) - 1
SEGMENT = "name long, digest binary, sub int, start int, owner long, tid binary, words binary"


def window_names(flat: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start within all words, place of the named sequence, its hash) of every window, in order."""
    k = window // 2
    span = window - k + 1
    count = np.maximum(sizes - window + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), count)
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(total)
    # Polynomial hashes of all sequences of k words: differences of prefix sums, shifted back by the inverse powers.
    power = np.full(len(flat), GOLDEN)
    power[0] = 1
    back = np.full(len(flat), np.uint64(pow(int(GOLDEN), -1, 1 << 64)))
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * np.cumprod(power), dtype=np.uint64)])
    grams = mixed((sums[k:] - sums[:-k]) * np.cumprod(back)[: len(flat) - k + 1])
    # The first least place among `span` neighbours, by doubling.
    best, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        width += step
    place = best[at]
    return text, at, place, grams[place]


def described(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text64 (hash of the raw text), tid (digest of the words), n_words, whole_sha256, names (different ones)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text64"), text_of(text_col).cast("binary").alias("body"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body"), most=1 << 20):
                texts = b.column("body")[a:z].to_pylist()
                flat, sizes, digests = word_hashes(texts)
                text, _, _, name = window_names(flat, sizes, window)
                pair = np.unique(np.stack([text.astype(np.uint64), name], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.uint64)
                offsets = np.searchsorted(pair[:, 0], np.arange(z - a + 1)).astype(np.int32)
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[a:z], b.column("text64")[a:z], pa.array(digests, pa.binary()), pa.array(sizes), pa.array(sha),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)))],
                    names=["doc_id", "text64", "tid", "n_words", "whole_sha256", "names"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return map_arrow(base, describe, f"doc_id {kind}, text64 long, tid binary, n_words long, whole_sha256 string, names array<long>")


def segments(texts: DataFrame, window: int) -> DataFrame:
    """Runs of windows with a shared name; texts has tid, owner, shared (names), body."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body"), most=1 << 20):
                flat, sizes, _ = word_hashes(b.column("body")[a:z].to_pylist())
                text, at, place, name = window_names(flat, sizes, window)
                wanted = np.unique(b.column("shared")[a:z].flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                keep = np.isin(name, wanted)
                text, at, place, name = text[keep], at[keep], place[keep], name[keep]
                if not len(text):
                    continue
                new = np.ones(len(text), bool)
                new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(text))) + window - 1
                begin = at[first]
                gather = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
                raw = flat[gather].tobytes()
                cuts = np.concatenate([[0], np.cumsum(n)]) * 8
                words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
                digests = [xxhash.xxh3_128_digest(raw[cuts[i] : cuts[i + 1]]) for i in range(len(first))]
                starts = begin - (np.cumsum(sizes) - sizes)[text[first]]
                pick = pa.array(text[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[first].view(np.int64)), pa.array(digests, pa.binary()), pa.array(np.zeros(len(first), np.int32)), pa.array(starts.astype(np.int32)),
                     b.column("owner")[a:z].take(pick), b.column("tid")[a:z].take(pick), words],
                    names=["name", "digest", "sub", "start", "owner", "tid", "words"])

    return map_arrow(texts.select("tid", "owner", "shared", "body"), cut, SEGMENT)


def _by_window(rows: DataFrame, window: int) -> DataFrame:
    """Each window of a segment as a segment of its own, dealt by its words; `sub` is its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, digest, owner, words in zip(*(b.column(c).to_pylist() for c in ("name", "digest", "owner", "words"))):
                for i in range(len(words) // 8 - window + 1):
                    w = words[8 * i : 8 * (i + window)]
                    out.append((xxhash.xxh3_64_intdigest(w) - (1 << 63), name, digest, i, owner, w))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["place", "name", "digest", "sub", "owner", "words"])

    return map_arrow(rows.select("name", "digest", "owner", "words"), cut, "place long, name long, digest binary, sub int, owner long, words binary")


def searched(rows: DataFrame, window: int, shards: int, shard_words: int) -> DataFrame:
    """Per segment the least id for each of its windows; rows has place (deals the shards), name, digest, sub, owner, words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_shard(batches, shard_words):
            words = [np.frombuffer(w, "<u8") for w in group["words"]]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.concatenate(words)
            index = FMIndex(flat, sizes, np.array(group["owner"]), window)
            _, least = index.statistics(flat, sizes)
            starts = np.cumsum(sizes) - sizes
            out = [least[s : s + n - window + 1] for s, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group["name"], pa.int64()), pa.array(group["digest"], pa.binary()), pa.array(group["sub"], pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                names=["name", "digest", "sub", "least"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    return map_arrow(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place"), search, "name long, digest binary, sub int, least array<long>")


def _by_shard(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[dict[str, list]]:
    """Rows of one shard after the other, cut between places where a shard holds more than its words."""
    cols = ["name", "digest", "sub", "owner", "words"]
    held, size, last = {c: [] for c in cols}, 0, None
    for b in batches:
        for shard, place, *values in zip(*(b.column(c).to_pylist() for c in ["shard", "place", *cols])):
            if last is not None and ((shard != last[0]) or (size > shard_words and place != last[1])):
                yield held
                held, size = {c: [] for c in cols}, 0
            last = (shard, place)
            for c, v in zip(cols, values):
                held[c].append(v)
            size += len(values[-1]) // 8
    if held["name"]:
        yield held


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    shard_words: int = SHARD_WORDS, name_segments: int = NAME_SEGMENTS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing or everything went), intervals."""
    rows = staged(described(docs, window, id_col, text_col).withColumn("owner", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), "substr-rows")
    texts = rows.where(F.col("n_words") >= window).groupBy("tid").agg(F.min(F.struct("owner", "text64", "names")).alias("f"))
    texts = staged(texts.select("tid", "f.*"), "substr-texts")

    spread = texts.select("tid", F.explode("names").alias("name"))
    common = spread.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    shared = spread.join(common, "name").groupBy("tid").agg(F.collect_list("name").alias("shared"))  # no longer than the text
    wanted = texts.drop("names").join(shared, "tid")
    bodies = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("owner"), F.xxhash64(text_of(text_col)).alias("text64"), text_of(text_col).cast("binary").alias("body"))
    # Rows that repeat id and text go before the join, so that it gives one row per text and the texts are shuffled once.
    bodies = bodies.dropDuplicates(["owner", "text64"])
    candidates = staged(bodies.join(wanted, ["owner", "text64"]).select("tid", "owner", "shared", "body"), "substr-candidates")

    # The words of the segments are most of what is stored: they go as soon as the next table holds what it needs of them.
    cut, drop_cut = staged_for_now(segments(candidates, window), "substr-segments")
    single = cut.groupBy("name", "digest").agg(F.min(F.struct("owner", "words")).alias("s")).select("name", "digest", "s.*")
    single, drop_single = staged_for_now(single, "substr-single")
    parts = staged(cut.drop("sub", "words"), "substr-places")
    drop_cut()
    size = single.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(1, int(-(-size // shard_words)))
    # Stored, the few names that are dealt by window have a size known to the planner: the words stay where they are for the next joins.
    often = staged(single.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > name_segments).select("name"), "substr-often")
    few = single.join(often, "name", "left_anti").select(F.col("name").alias("place"), "name", "digest", F.lit(0).alias("sub"), "owner", "words")
    many = _by_window(single.join(often, "name", "left_semi"), window)
    # A different window enters an index once, with its least id (`sub` -1); what is found goes back to all its places.
    once = many.groupBy("place", "words").agg(F.min("owner").alias("owner"))
    once = once.select("place", F.col("place").alias("name"), F.unhex(F.md5("words")).alias("digest"), F.lit(-1).alias("sub"), "owner", "words")
    results = staged(searched(few.unionByName(once), window, shards, shard_words), "substr-found")
    least = results.where("sub < 0").select(F.col("name").alias("place"), F.col("digest").alias("window"), "least")
    back = many.select("place", F.unhex(F.md5("words")).alias("window"), "name", "digest", "sub").join(least, ["place", "window"])
    found = results.where("sub >= 0").unionByName(staged(back.select("name", "digest", "sub", "least"), "substr-back"))
    drop_single()

    # Starts of the windows that a smaller id has, back at the texts.
    at = parts.join(found, ["name", "digest"])
    starts = at.select("tid", F.expr("transform(filter(sequence(0, size(least) - 1), i -> least[i] < owner), i -> start + sub + i)").alias("at")).where(F.size("at") > 0)
    starts = starts.groupBy("tid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))  # no longer than the text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tid, body, at in zip(b.column("tid").to_pylist(), b.column("body").to_pylist(), b.column("at").to_pylist()):
                words = body.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.asarray(at) + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                text = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((tid, int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode(), turn.reshape(-1, 2).tolist()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32()))])],
                names=["tid", "removed", "sha", "kept_text", "intervals"])

    changed = map_arrow(candidates.select("tid", "body").join(starts, "tid"), remove, "tid binary, removed long, sha string, kept_text string, intervals array<array<int>>")
    heads = texts.select("tid", F.col("owner").alias("head")).join(changed, "tid", "left")
    joined = rows.drop("names").join(heads, "tid", "left")
    # A row that only repeats a smaller id's words loses them all; a row of the head's own id is treated as the head.
    copy = F.col("head").isNotNull() & (F.col("owner") > F.col("head"))
    return joined.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"),
        F.when(copy, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).otherwise(F.col("intervals")).alias("intervals"))
