"""Token ids as binary files (operator 6).

Documents are range-partitioned and sorted by id; each task encodes its range and writes one flat file of unsigned
integers and one of 64-bit offsets. Where a file starts in the whole sequence is the prefix sum of the token counts of
the files before it, added when the offsets are read. Readers map the files into memory.

A task writes under a name of its own attempt and reports it in its row; the rows are written by Spark's own commit, so
of repeated attempts only the reported file counts. Files go through the file system that the folder's address names.

Results for odd input: null text counts as empty (the end id alone); null ids come first, repeated ids follow each
other; an empty table gives no rows; other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow, slices
from chalkline.llm.common import new_folder, staged, text_of
from chalkline.llm.token_counts import LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE

#: Pieces remembered by one worker, and bytes above which a piece is encoded without being remembered.
REMEMBERED, LONG_PIECE = 700_000, 100
#: The split pattern of the vocabulary for Latin text (below U+0180, where composing changes nothing); a test holds it against the library.
PIECES = re.compile("'(?:[stmd]|re|ve|ll)|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(L=LATIN_LETTER, N=LATIN_NUMBER, S=LATIN_SPACE))
BEYOND = re.compile("[^\x00-\u017f]|<\\|")
#: Stands before words that the library splits itself; no piece of Latin text holds it together with letters.
WHOLE, WORD_END, JOINED = "\ufdd0", "</w>", 256


class WordEncoder:
    """Encodes texts piece by piece with the library; a vocabulary that drops white space gives the same ids as whole texts.

    New pieces go to the library many in one text, where the tokens that end a word show which piece they belong to.
    Texts with other than Latin letters, or with special tokens, are cut at ASCII white space only and their words are
    encoded one by one.
    """

    def __init__(self, file: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(file), end_id
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str | None, int] = {None: 0}  # None stands for the end of a document
        self.starts, self.lengths, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 1
        self.ids[0], self.lengths[0] = self.end_id, 1

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each)."""
        joined = [" ".join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)]
        ids = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(lengths) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, lengths

    def _learn(self, keys: list[str]) -> None:
        latin = [k for k in keys if not k.startswith(WHOLE)]
        ids, lengths = self._encoded(latin)
        whole = [k for k in keys if k.startswith(WHOLE)]
        if whole:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([k[1:] for k in whole], add_special_tokens=False)]
            ids = np.concatenate([ids, np.fromiter((x for v in lists for x in v), np.int64)])
            lengths = np.concatenate([lengths, np.fromiter(map(len, lists), np.int64, len(lists))])
        n, first = len(ids), len(self.slots)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        self.lengths[first : first + len(keys)] = lengths
        self.starts[first : first + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + n] = ids
        self.used += n
        self.slots.update(zip([*latin, *whole], range(first, first + len(keys))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; number of ids of each text)."""
        pieces: list[str | None] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            text = t.decode()
            pieces += [WHOLE + w.decode() for w in t.split()] if BEYOND.search(text) else PIECES.findall(text.lower())
            pieces.append(None)
            ends[i] = len(pieces)
        if len(self.slots) > REMEMBERED:
            self._forget()
        slots = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = list(dict.fromkeys(pieces[k] for k in missing))
            self._learn(new)
            slots[missing] = np.fromiter((self.slots[pieces[k]] for k in missing), np.int64, len(missing))
        lengths = self.lengths[slots]
        before = np.cumsum(lengths) - lengths
        ids = self.ids[np.arange(lengths.sum()) + np.repeat(self.starts[slots] - before, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
        if len(missing) and max(map(len, new)) > LONG_PIECE:
            self._forget()
        return ids, np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def encoder(file: str, end_id: int) -> WordEncoder:
    return WordEncoder(file, end_id)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_ids(docs: DataFrame, file: str, folder: str, end_id: int = 1, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below `folder` and return the manifest, one row per file: path, n_docs, n_tokens, first_doc, base."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}"
        enc, counts, ids_of_docs, first = encoder(file, end_id), [], [], None
        with files.open_output_stream(f"{name}.ids") as out:
            for b in batches:
                texts = b.column("text")
                for a, z in slices(texts):
                    ids, n = enc.encode(texts[a:z].to_pylist())
                    if ids.max(initial=0) > np.iinfo(dtype).max:
                        raise ValueError(f"ids do not fit {dtype}")
                    out.write(ids.astype(dtype).tobytes())
                    counts.append(n)
                ids_of_docs.append(b.column("doc_id"))
        if not counts:
            files.delete_file(f"{name}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<u8")
        with files.open_output_stream(f"{name}.offsets") as out:
            out.write(offsets.tobytes())
        docs_of_file = pa.chunked_array(ids_of_docs).combine_chunks()
        with files.open_output_stream(f"{name}.docs") as out, pa.ipc.new_stream(out, pa.schema([("doc_id", docs_of_file.type)])) as w:
            w.write_table(pa.table({"doc_id": docs_of_file}))
        first = docs_of_file[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([pa_partition()], pa.int64()), pa.array([name.rsplit("/", 1)[1]]), pa.array([len(offsets) - 1], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([first], docs_of_file.type)],
            names=["file_no", "file", "n_docs", "n_tokens", "first_doc"])

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = staged(map_arrow(ordered, write, f"file_no long, file string, n_docs long, n_tokens long, first_doc {kind}"), "token-manifest")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return found.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))


def pa_partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_file(folder: str, name: str, dtype: str = "<u2") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, offsets, ids) of one file, mapped into memory where the file system is local."""
    files, root = _files(folder)
    if isinstance(files, pafs.LocalFileSystem):
        offsets, ids = np.memmap(f"{root}/{name}.offsets", "<u8", "r"), f"{root}/{name}.ids"
        ids = np.memmap(ids, dtype, "r") if len(offsets) > 1 and offsets[-1] else np.zeros(0, dtype)
    else:
        whole = lambda p: files.open_input_file(p).read_buffer()
        offsets, ids = np.frombuffer(whole(f"{root}/{name}.offsets"), "<u8"), np.frombuffer(whole(f"{root}/{name}.ids"), dtype)
    with files.open_input_stream(f"{root}/{name}.docs") as src:
        table = pa.ipc.open_stream(src).read_all()
    return table.column("doc_id").combine_chunks(), offsets, ids


def read_back(manifest: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = manifest.schema["first_doc"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                docs, offsets, ids = read_file(folder, name, dtype)
                at = offsets.astype(np.int64)
                for lo in range(0, len(at) - 1, 4096):
                    hi = min(lo + 4096, len(at) - 1)
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [docs[lo:hi], pa.array(at[lo:hi] + base), pa.array(np.diff(at[lo : hi + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "base", "first_doc").repartition(F.col("file"))
    return map_arrow(files.select("file", "base"), read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, file: str, folder: str | None = None, end_id: int = 1, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back and return a row per document."""
    folder = folder or new_folder(docs.sparkSession, "token-files")
    return read_back(staged(write_ids(docs, file, folder, end_id, dtype, id_col, text_col), "token-bases"), folder, dtype)
