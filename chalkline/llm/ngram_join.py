"""N-gram Jaccard join (operator 3): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash banding. Band and row counts follow from the target recall at the threshold. Rows with the same words are one
text; every text is put into one bucket per band by a shuffle on the band hash. Buckets with the same members count
once. Texts that buckets connect form a candidate group; a group of bounded size is verified whole in one place, on
full shingle sets. Larger groups are verified bucket by bucket, each bucket cut into blocks of bounded size and each
pair of blocks worked on by itself; a pair of texts counts in the first bucket the two share. Pairs are counted where
they are found and never written: what leaves a task is one row per text with its number of links, and a spanning
forest of the links, from which the classes follow.

Results for odd input: null text counts as empty; texts without words link with nothing, and are one class like other
rows with equal words; texts of one to four words have one shingle, all of their words; null ids sort last, and of rows
that repeat id and text one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import TEXT_ROWS, map_arrow, slices
from chalkline.llm.common import join_on, staged, text_of
from chalkline.llm.components import components
from chalkline.llm.shingles import band_hashes, bands_and_rows, shingle_hashes, word_hashes

THRESHOLD, RECALL, N = (4, 5), 0.9999, 5
#: Texts and shingles that are verified in one place; a larger candidate group is cut into blocks of half as much.
UNIT_TEXTS, UNIT_SHINGLES = 2048, 2_000_000


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: row_no, doc_id, text64 (hash of the raw text), tid (digest of the words), n_shingles, bands."""
    base = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text64"), text_of(text_col).cast("binary").alias("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body"), most=1 << 20):
                flat, sizes, digests = word_hashes(b.column("body")[a:z].to_pylist())
                shingles, count = shingle_hashes(flat, sizes, n)
                values = band_hashes(shingles, count, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c)[a:z] for c in ("row_no", "doc_id", "text64")), pa.array(digests, pa.binary()), pa.array(count),
                     pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * bands), pa.array(values.ravel()))],
                    names=["row_no", "doc_id", "text64", "tid", "n_shingles", "bands"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return map_arrow(base, sign, f"row_no long, doc_id {kind}, text64 long, tid binary, n_shingles long, bands array<long>", TEXT_ROWS)


def buckets(texts: DataFrame) -> DataFrame:
    """(tid, band, bucket) of the buckets with two members or more; of buckets with the same members the first band's stays."""
    spread = texts.where(F.col("n_shingles") > 0).select("tid", F.posexplode("bands").alias("band", "bucket"))
    filled = spread.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("y")).where("n > 1")
    once = filled.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket")
    return spread.join(once, ["band", "bucket"])


def _unit(shingles: list[np.ndarray], copies: np.ndarray, threshold: tuple[int, int], owned=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each text, documents behind them, root of each text in the forest of links).

    `owned(i)`, where given, masks the texts whose pair with text i is counted here.
    """
    m, (num, den) = len(shingles), threshold
    sizes = np.fromiter(map(len, shingles), np.int64, m)
    flat = np.concatenate(shingles) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    sorted_owner, sorted_flat = owner[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = sorted_flat[1:] != sorted_flat[:-1]
    group = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(flat))
    place = np.empty(len(flat), np.int64)
    place[order] = group
    lo, length = first[place], np.diff(first)[place]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, docs, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m):
        common = np.zeros(m, np.int64)
        s, e = bounds[i], bounds[i + 1]
        while s < e:  # postings of the text's shingles, a bounded run at a time
            upto = np.cumsum(length[s:e])
            k = max(1, int(np.searchsorted(upto, 4_000_000, side="right")))
            n, total = length[s : s + k], int(upto[min(k, e - s) - 1])
            at = np.repeat(lo[s : s + k] - (np.cumsum(n) - n), n) + np.arange(total)
            common += np.bincount(sorted_owner[at], minlength=m)
            s += k
        similar = common * den >= num * (sizes + sizes[i] - common)
        similar &= common > 0
        similar[i] = False
        if owned is not None:
            similar &= owned(i)
        partners = np.flatnonzero(similar)
        links[i], docs[i] = len(partners), copies[partners].sum()
        for j in partners[partners > i]:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return links, docs, np.array([top(i) for i in range(m)])


def _out(tids: list[bytes], links, docs, root) -> pa.RecordBatch:
    n = len(tids)
    return pa.RecordBatch.from_arrays(
        [pa.array(tids, pa.binary()), pa.array([tids[r] if r != i else None for i, r in enumerate(root)], pa.binary()), pa.array(links, pa.int64()), pa.array(docs, pa.int64())],
        names=["tid", "other", "links", "link_docs"]) if n else None


LINKS = "tid binary, other binary, links long, link_docs long"


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """Rows of one key after the other; the input is sorted by it."""
    held, last = [], None
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in key)
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(r)
    if held:
        yield held


def verified(texts: DataFrame, threshold: tuple[int, int], unit_texts: int, unit_shingles: int) -> DataFrame:
    """Links found in candidate groups of bounded size; texts has group, tid, copies, shingles."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(rows: list[dict]) -> pa.RecordBatch:
            return _out([r["tid"] for r in rows], *_unit([np.frombuffer(r["shingles"], "<u8") for r in rows], np.array([r["copies"] for r in rows]), threshold))

        size = 0
        for g in _groups(batches, ["grp"]):  # small groups share a unit: other groups' texts just have nothing in common
            n = sum(len(r["shingles"]) // 8 for r in g)
            if held and (len(held) + len(g) > unit_texts // 4 or size + n > unit_shingles // 4):
                yield done(held)
                held, size = [], 0
            held += g
            size += n
        if held:
            yield done(held)

    dealt = texts.select("grp", "tid", "copies", "shingles").repartition("grp").sortWithinPartitions("grp")
    return map_arrow(dealt, verify, LINKS, TEXT_ROWS)


def verified_by_bucket(texts: DataFrame, members: DataFrame, threshold: tuple[int, int], unit_texts: int, unit_shingles: int) -> DataFrame:
    """The same for larger groups: pairs of blocks of each bucket; a pair counts in the first bucket that both texts share."""
    member = members.join(texts.select("tid", "n_set"), "tid")
    size = member.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("n_set").alias("s"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("n") * 2 / unit_texts), F.ceil(F.col("s") * 2 / unit_shingles)).cast("int")).drop("n", "s")
    own = member.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("own"))  # one per band at most
    rows = member.join(size, ["band", "bucket"]).join(own, "tid").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "tid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tid", "band", "bucket", "block", "own", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    rows = rows.join(texts.select("tid", "copies", "shingles"), "tid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["band", "bucket", "i", "j"]):
            here = (g[0]["band"], g[0]["bucket"])
            earlier: list[dict] = [{o["band"]: o["bucket"] for o in r["own"] if (o["band"], o["bucket"]) < here} for r in g]
            bands = sorted({b for e in earlier for b in e})
            sig = np.array([[e.get(b, 0) for b in bands] for e in earlier], np.int64).reshape(len(g), len(bands))
            has = np.array([[b in e for b in bands] for e in earlier], bool).reshape(len(g), len(bands))
            block = np.array([r["block"] for r in g])
            apart = g[0]["i"] != g[0]["j"]

            def owned(i: int) -> np.ndarray:
                mask = ~((sig == sig[i]) & has & has[i]).any(axis=1)
                return mask & (block != block[i]) if apart else mask

            yield _out([r["tid"] for r in g], *_unit([np.frombuffer(r["shingles"], "<u8") for r in g], np.array([r["copies"] for r in g]), threshold, owned))

    keys = ["band", "bucket", "i", "j"]
    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), verify, LINKS, TEXT_ROWS)


def near_duplicates(
    docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text",
    unit_texts: int = UNIT_TEXTS, unit_shingles: int = UNIT_SHINGLES,
) -> DataFrame:
    """Per row: row_no, doc_id, text64, text_id (smallest id with the same words), class_id (smallest id of the class), class_size,
    n_links (other documents that are similar, copies included), n_text_links (different texts that are similar), kept.

    `threshold` is a fraction, numerator and denominator, so that the comparison is exact.
    """
    bands, rows_per_band = bands_and_rows(threshold[0] / threshold[1], recall)
    rows = staged(signatures(docs, bands, rows_per_band, n, id_col, text_col), "join-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no", "text64", "n_shingles", "bands")).alias("f")
    texts = staged(rows.groupBy("tid").agg(F.count("*").alias("copies"), first).select("tid", "copies", "f.*"), "join-texts")
    members = staged(buckets(texts), "join-buckets")
    groups = components(members.join(members.groupBy("band", "bucket").agg(F.min("tid").alias("b")), ["band", "bucket"]).select(F.col("tid").alias("a"), "b"))

    # Full shingle sets, for candidates alone, from the row that stands for each text.
    wanted = groups.join(texts.select("tid", "copies", "doc_id", "text64"), groups["node"] == texts["tid"]).drop("node").withColumnRenamed("label", "grp")
    bodies = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text64"), text_of(text_col).cast("binary").alias("body"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body"), most=1 << 20):
                flat, sizes, _ = word_hashes(b.column("body")[a:z].to_pylist())
                shingles, count = shingle_hashes(flat, sizes, n)
                cut = np.concatenate([[0], np.cumsum(count)])
                each = [np.unique(shingles[cut[i] : cut[i + 1]]) for i in range(z - a)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c)[a:z] for c in ("grp", "tid", "copies")), pa.array([len(x) for x in each], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in each], pa.binary())],
                    names=["grp", "tid", "copies", "n_set", "shingles"])

    found = join_on(bodies, wanted, ["doc_id", "text64"], "inner").select("grp", "tid", "copies", "body")
    full = staged(map_arrow(found, sets, "grp binary, tid binary, copies long, n_set long, shingles binary", TEXT_ROWS).dropDuplicates(["tid"]), "join-sets")
    size = full.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_set").alias("s"))
    large = size.where((F.col("n") > unit_texts) | (F.col("s") > unit_shingles)).select("grp")
    small = verified(full.join(large, "grp", "left_anti"), threshold, unit_texts, unit_shingles)
    big = full.join(large, "grp", "left_semi")
    links = staged(small.unionByName(verified_by_bucket(big, members, threshold, unit_texts, unit_shingles)), "join-links")

    counted = links.groupBy("tid").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
    classes = components(links.where("other IS NOT NULL").select(F.col("tid").alias("a"), F.col("other").alias("b")))
    known = texts.join(counted, "tid", "left").join(classes.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    known = staged(known.drop("bands"), "join-classes")
    heads = known.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "row_no")).alias("head"), F.sum("copies").alias("class_size"))
    by_text = known.join(heads, "label").select(
        "tid", F.col("doc_id").alias("text_id"), F.col("head.doc_id").alias("class_id"), F.col("head.row_no").alias("head_row"), "class_size",
        (F.coalesce("link_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"))
    return rows.select("row_no", "doc_id", "text64", "tid").join(by_text, "tid").select(
        "row_no", "doc_id", "text64", "text_id", "class_id", "class_size", "n_links", "n_text_links", (F.col("row_no") == F.col("head_row")).alias("kept"))
