"""Language identification by string kernels (operator 7).

Kernel: blended spectrum with presence, that is the share of byte n-grams (1 to 4, letters only, lower case) that two
texts have in common. n-grams are hashed to WIDTH bits. The kernel is approximated on a few landmark texts of each
language (Nyström), and one ridge regression for each language against the rest is fitted on those features. A batch
of texts is scored with two matrix products: presence bits by landmarks, kernel values by coefficients.

Training uses at most about TRAIN_PER_LANG rows of each language, chosen by a hash of the id; scoring reads whole texts.

Results for odd input: null text, and text without a letter, is `und` with score 0; null languages teach nothing; with
nothing to learn from every text is `und`; an empty table gives no rows; null ids count as the empty text in the fold
rule; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.batches import TEXT_ROWS, held_out, labelled_sample, map_arrow, slices
from chalkline.llm.common import text_of

#: Hashed n-grams, longest n-gram, landmarks of a language, and training rows of a language (the bound of the sample).
WIDTH, LONGEST, LANDMARKS_PER_LANG, TRAIN_PER_LANG = 8192, 4, 32, 300
RIDGE, SHARPNESS = 1e-2, 6.0
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def presence(texts: list[bytes]) -> np.ndarray:
    """[text, WIDTH] 0/1: which hashed n-grams occur in each lower-case text. Runs of other characters are one space."""
    flat = _LETTERS[np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    flat = flat[: len(owner) + 1]
    space = flat == 32
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep = keep[: len(owner)]
    flat, owner = flat[: len(owner)][keep], owner[keep]
    out = np.zeros(len(texts) * WIDTH, dtype=np.uint8)
    row = owner.astype(np.int64) * WIDTH
    code = flat.astype(np.uint32)
    shift = np.uint32(32 - int(WIDTH).bit_length() + 1)
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = code[:-1] << np.uint32(8) | flat[n - 1 :]
        if not len(code):
            break
        at = row[: len(code)] + ((code * _MIX[n - 1]) >> shift)
        inside = owner[: len(code)] == owner[n - 1 :]
        out[at[inside]] = 1
    return out.reshape(len(texts), WIDTH)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # [landmark, language]

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_unpacked"):
            self._unpacked = np.unpackbits(self.landmarks, axis=1).astype(np.float32).T
            self._norm = 1 / np.sqrt(np.maximum(self._unpacked.sum(axis=0), 1))
        x = bits.astype(np.float32)
        return (x @ self._unpacked) * self._norm / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("languages", "landmarks", "weights")}  # each task unpacks the landmarks itself

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """[text, language] shares that sum to 1."""
        s = SHARPNESS * (self.kernel(bits) @ self.weights)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(bits: np.ndarray, labels: list[str]) -> Model:
    """Nyström features on the first landmarks of each language, then ridge regression, one against the rest."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    chosen = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS_PER_LANG] for k in range(len(languages))])
    model = Model(languages, np.packbits(bits[chosen], axis=1), np.zeros((len(chosen), len(languages)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(bits[chosen]).astype(np.float64))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = model.kernel(bits) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language counts the same, however many rows it has.
    weight = (1 / np.bincount(y, minlength=len(languages)))[y][:, None] * len(y) / len(languages)
    beta = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ (weight * target))
    model.weights = (root @ beta).astype(np.float32)
    return model


def _bits_of(rows: DataFrame, label: str) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("body"), most=1 << 20, rows=256):
                bits = np.packbits(presence(b.column("body")[a:z].to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(label)[a:z], b.column("place")[a:z], pa.array([x.tobytes() for x in bits], pa.binary())], names=[label, "place", "bits"])

    return map_arrow(rows, packed, f"{label} string, place long, bits binary", TEXT_ROWS)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model | None:
    rows = docs.where(F.col(lang_col).isNotNull() & text_of(text_col).rlike(r"\p{L}") & ~held_out(id_col)).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.lower(text_of(text_col)).cast("binary").alias("body"))
    sample, _ = labelled_sample(rows, "lang", "doc_id", per_lang)
    found = _bits_of(sample.withColumn("place", F.xxhash64("doc_id", "body")), "lang").collect()  # 1 KB a row, bounded above
    found.sort(key=lambda r: (r["lang"], r["place"]))
    kept, seen = [], {}
    for r in found:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_lang:
            kept.append(r)
    if not kept:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), -1), axis=1)
    return fit(bits, [r["lang"] for r in kept])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with two more columns, __lang and __score."""
    fields = docs.schema.fieldNames()
    rows = docs.withColumn("__body", F.lower(F.when(text_of(text_col).rlike(r"\p{L}"), text_of(text_col))).cast("binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(b.num_columns - 1)
            lang, share = [], []
            for a, z in slices(body.fill_null(b""), most=1 << 20, rows=256):
                texts = body[a:z].to_pylist()
                if model is None:
                    lang += ["und"] * len(texts)
                    share += [0.0] * len(texts)
                    continue
                p = model.scores(presence([t or b"" for t in texts]))
                best = p.argmax(axis=1)
                lang += ["und" if t is None else model.languages[k] for t, k in zip(texts, best)]
                share += [0.0 if t is None else float(x) for t, x in zip(texts, p.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(share, pa.float64())], names=[*fields, "__lang", "__score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return map_arrow(rows, score, schema, TEXT_ROWS)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col)
    rows = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
