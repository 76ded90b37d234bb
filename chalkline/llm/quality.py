"""Quality scores by a factorisation machine (operator 9).

Features of a text: its words, hashed; statistics of its structure (shares of capitals, digits, symbols and white
space, mean word length, shares of different words and lines, share of the most frequent word), each as a place among
the training sample's quantiles; and its length as metadata. The machine adds to a linear score all pairwise
interactions, each a product of two low-rank vectors; their sum is half of (sum of vectors) squared less the sum of
squares, so a text is scored in time linear in its features.

Fitted on at most about TRAIN_PER_LABEL rows of each label, chosen by a hash of the id, with the true shares of the
labels put back; scoring reads whole texts of all rows.

Results for odd input: null text counts as empty and gets a score; null labels teach nothing, of several labels of
one id the majority counts (a tie is 1); without labels every score is 0.5; an empty table gives no rows; null ids
count as the empty text in the fold rule; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import held_out, labelled_sample, map_arrow, slices
from chalkline.llm.common import text_of

#: Hashed words, rank of the interactions, quantile bins of a statistic, training rows of a label (the bound of the sample).
WORDS, RANK, BINS, TRAIN_PER_LABEL = 1 << 14, 8, 8, 2000
STATS = ["log_bytes", "capitals", "digits", "symbols", "spaces", "beyond_ascii", "word_length", "words_different", "lines_different", "top_word", "words_without_letter"]
EPOCHS, RATE, DECAY = 60, 0.05, 1e-4
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b in (9, 10, 11, 12, 13, 32) else 5 if b >= 128 else 0 if 97 <= b <= 122 else 3 for b in range(256)], np.uint8)


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        # Case and the symbols around a word do not tell words apart here; a word of symbols alone is a bucket of its own.
        h = self[word] = xxhash.xxh32_intdigest(word.lower().strip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")) % WORDS
        return h


_buckets = _Buckets()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word bucket, value) of each different bucket of each text, values of a text having length 1; [text, stat]."""
    n = len(texts)
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter((_buckets[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    key, count = np.unique(np.repeat(np.arange(n), sizes) * WORDS + ids, return_counts=True)
    row, bucket, value = key // WORDS, key % WORDS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    stats = np.zeros((n, len(STATS)))
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    for i, (t, ws) in enumerate(zip(texts, words)):
        kinds = np.bincount(_KIND[np.frombuffer(t, np.uint8)], minlength=6) / max(1, len(t))
        lines = t.split(b"\n")
        k = max(1, len(ws))
        plain = len(t) - kinds[4] * len(t)
        stats[i] = [np.log1p(len(t)), *kinds[1:6], plain / k, len(set(ws)) / k, len(set(lines)) / len(lines), top[i] / k, sum(w.isalpha() is False and not any(c > 64 for c in w) for w in ws) / k]
    return row, bucket, value / np.maximum(norm, 1e-9)[row], stats


@dataclass
class Model:
    edges: np.ndarray  # [stat, BINS - 1]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and statistics as one list of (row, feature, value), in row order."""
        n, k = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(k)], axis=1)
        rows = np.concatenate([row, np.repeat(np.arange(n), k)])
        feats = np.concatenate([bucket, (WORDS + np.arange(k) * BINS + bins).ravel()])
        vals = np.concatenate([value, np.full(n * k, 1 / np.sqrt(k))])
        order = np.argsort(rows, kind="stable")
        return rows[order], feats[order], vals[order]

    def margin(self, rows: np.ndarray, feats: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of vectors."""
        x = vals[:, None] * self.v[feats]
        starts = np.searchsorted(rows, np.arange(n))
        s, q = np.add.reduceat(x, starts, axis=0), np.add.reduceat(x * x, starts, axis=0)
        return self.bias + np.bincount(rows, self.w[feats] * vals, minlength=n) + 0.5 * (s * s - q).sum(axis=1), s

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.margin(*self.inputs(*features(texts)), len(texts))[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Logistic loss with Adam over the whole sample; `share` is the true share of label 1."""
    n = len(y)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    size = WORDS + stats.shape[1] * BINS
    rng = np.random.default_rng(11)
    m = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    rows, feats, vals = m.inputs(row, bucket, value, stats)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    by_feat = np.argsort(feats, kind="stable")
    used, first = np.unique(feats[by_feat], return_index=True)
    state = [np.zeros_like(x) for x in (m.w, m.w, m.v, m.v)]
    for step in range(1, EPOCHS + 1):
        z, s = m.margin(rows, feats, vals, n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gv = DECAY * m.w, DECAY * m.v
        gx = g[rows] * vals
        gw[used] += np.add.reduceat(gx[by_feat], first)
        x = vals[:, None] * m.v[feats]
        gv[used] += np.add.reduceat((gx[:, None] * (s[rows] - x))[by_feat], first, axis=0)
        m.bias -= RATE * g.sum()
        for p, gp, a, b in ((m.w, gw, state[0], state[1]), (m.v, gv, state[2], state[3])):
            a += 0.1 * (gp - a)
            b += 0.01 * (gp * gp - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    share = min(max(share, 1e-3), 1 - 1e-3)
    m.bias += float(np.log(share / (1 - share)))
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = TRAIN_PER_LABEL) -> Model | None:
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("label_id").isNotNull())
    known = known.where(~held_out("label_id")).groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample, counts = labelled_sample(known, "y", "label_id", per_label)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("body"))
    # The sample has at most 4 * per_label rows of two numbers.
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["label_id"]).select("doc_id", "y", "body")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body")):
                row, bucket, value, stats = features(b.column("body")[a:z].to_pylist())
                cuts = np.searchsorted(row, np.arange(z - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[a:z], b.column("y")[a:z], *(pa.array([x[cuts[i] : cuts[i + 1]].astype(k).tobytes() for i in range(z - a)], pa.binary()) for x, k in ((bucket, "<u2"), (value, "<f4"))), pa.array([x.tobytes() for x in stats], pa.binary())],
                    names=["doc_id", "y", "bucket", "value", "stats"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = sorted(map_arrow(rows, extract, f"doc_id {kind}, y int, bucket binary, value binary, stats binary").collect(), key=lambda r: (r["doc_id"], bytes(r["stats"])))
    y = np.array([r["y"] for r in found])
    if not len(y) or counts.get(1, 0) == 0 or counts.get(0, 0) == 0 or len(set(y.tolist())) < 2:
        return None
    buckets = [np.frombuffer(bytes(r["bucket"]), "<u2") for r in found]
    row = np.repeat(np.arange(len(found)), [len(x) for x in buckets])
    value = np.concatenate([np.frombuffer(bytes(r["value"]), "<f4") for r in found])
    stats = np.stack([np.frombuffer(bytes(r["stats"])) for r in found])
    return fit(row, np.concatenate(buckets).astype(np.int64), value, stats, y, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).cast("binary").alias("body"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.score(b.column("body")[a:z].to_pylist()) if model else np.full(z - a, 0.5) for a, z in slices(b.column("body"), most=2 << 20)]
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, scores, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
