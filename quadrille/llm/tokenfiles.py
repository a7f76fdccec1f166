"""Operator 10: token ids as flat unsigned files with 64-bit document offsets, memory-mapped when read."""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import plus, remove_at_exit, shared_dir

END_ID = 2
#: Entries of each table of known units; those seen once only are not entered.
KEEP = 500_000
_SEEN_BITS = 22
#: White space other than the blank and the line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_SIGN = "!-&(-/:-@\\[-`{-~"
#: Chunks whose tokens are plain: words with signs after them (no apostrophe, no digit), single line feeds between.
_PLAIN = re.compile(f"[{_LETTER}]+[{_SIGN}]*(?:\n[{_LETTER}]+[{_SIGN}]*)*")
_WORD_SIGNS = re.compile(f"([{_LETTER}]+)([{_SIGN}]*)")
_PLAIN_PIECE = re.compile(f"[{_LETTER}]+|[{_SIGN}]+|\n")


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others
    follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(others)}


class _Known(dict):
    """A bounded table of what make() returns, filled on the second miss; emptied when full."""

    def __init__(self, make) -> None:
        self.make, self.seen = make, bytearray(1 << _SEEN_BITS)

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        at = hash(key) & ((1 << _SEEN_BITS) - 1)
        if not self.seen[at]:
            self.seen[at] = 1
        elif len(key) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library: its pre-tokenizer and its model, each asked once for what recurs.

    A blank with no white space beside it always starts a token of the byte-level pre-tokenizer, whose tokens never
    look back, so a text's ids are those of its units (each with its leading blank) one after the other. Units beside
    longer white space are joined to one. A text that holds an added token of the file, such as an end marker, goes to the
    library whole, which gives the token's id there, as encode(text, add_special_tokens=False) does by itself.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("a byte-level tokenizer without normalizer and prefix blank is needed")
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        pre, model, form = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize, f"<{'H' if self.kind.itemsize == 2 else 'I'}"
        pieces = _Known(lambda piece: b"".join([struct.pack(form, t.id) for t in model(piece)]))
        self.unit = lambda text: b"".join([pieces[p] for p, _ in pre(text)])
        self.after_blank = _Known(self._after_blank)
        self._pieces, self._letters = pieces, _byte_letters()

    def _after_blank(self, chunk: str) -> bytes:
        if m := _WORD_SIGNS.fullmatch(chunk):
            word, signs = m.groups()
            found = self._pieces["\u0120" + (word if word.isascii() else self._shown(word))]
            return found + self._pieces[signs] if signs else found
        if not _PLAIN.fullmatch(chunk):
            return self.unit(" " + chunk)
        first, *rest = _PLAIN_PIECE.findall(chunk)
        return self._pieces["\u0120" + self._shown(first)] + b"".join([self._pieces[self._shown(x)] for x in rest])

    def _shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self._letters)

    def __call__(self, text: str | None) -> bytes:
        """The ids of the text and the end id, as little-endian bytes. A null counts as empty."""
        if not text:
            return self.end
        if any(a in text for a in self.added):
            return self.whole(text) + self.end
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text):
            return b"".join(map(self.unit, self.joined(text))) + self.end
        first, *rest = text.split(" ")
        return self.unit(first) + b"".join(map(self.after_blank.__getitem__, rest)) + self.end

    @staticmethod
    def joined(text: str) -> list[str]:
        """Units of a text with longer white space."""
        out = [[]]
        space = True
        for i, chunk in enumerate(text.split(" ")):
            if i and not space and chunk and not chunk[0].isspace():
                out.append([])
            out[-1].append(f" {chunk}" if i else chunk)
            space = not chunk or chunk[-1].isspace()
        return ["".join(x) for x in out]


@functools.cache
def encoder_of(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process: what it has learned about units serves all tasks that the process runs."""
    return Encoder(path, end_id)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}" if not folder.startswith("file:") else "file://" + folder[5:])


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes docs in ascending id order; returns the manifest (part, n_docs, n_tokens, base), one row for each part.

    part-N.bin holds the ids, flat; part-N.idx the 64-bit offsets of its documents in it, one more than there are
    documents; part-N.ids the documents' ids, 64 bits. base is the number of ids in all parts before: prefix sums over
    the manifest, which has a row for each part only. A part is written under a name of its attempt and then renamed,
    so a task that runs again leaves a whole file. Null ids come first and are marked as -2**63; texts order ties, and rows
    of one id can fall on several parts.
    """
    spark = docs.sparkSession
    spark.range(1).write.mode("ignore").parquet(f"{folder}/_made")  # the folder, by Spark's own file system

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (store, top) = encoder_of(tokenizer_path, end_id), _open(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{top}/attempt-{attempt}.bin")
            ids.append(batch.column(0).fill_null(-(2**63)).cast(pa.int64()).to_numpy())
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 64):
                found = [encoder(t) for t in texts.slice(i, 64).to_pylist()]
                out.write(b"".join(found))
                sizes += [len(x) // encoder.kind.itemsize for x in found]
        if out is None:
            return
        out.close()
        for name, values in (("idx", np.concatenate(([0], np.cumsum(sizes))).astype("<i8")), ("ids", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{top}/attempt-{attempt}.{name}") as f:
                f.write(values.tobytes())
        for name in ("bin", "idx", "ids"):
            store.move(f"{top}/attempt-{attempt}.{name}", f"{top}/part-{part:06d}.{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(sizes)]), pa.array([sum(sizes)])], names=["part", "n_docs", "n_tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    parts = sorted(ordered.mapInArrow(run, "part long, n_docs long, n_tokens long").collect())
    bases = np.concatenate(([0], np.cumsum([r.n_tokens for r in parts]))).tolist()
    rows = [(r.part, r.n_docs, r.n_tokens, b) for r, b in zip(parts, bases, strict=False)]
    return spark.createDataFrame(rows, "part long, n_docs long, n_tokens long, base long").repartition(max(1, len(rows)), "part")


def read(manifest: DataFrame, folder: str, itemsize: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents
    before it, ids_crc32 is over its ids as unsigned 32-bit. Local files are memory-mapped, others read as streams."""
    kind = np.dtype(f"<u{itemsize}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)

        def opened(name: str, dtype: np.dtype) -> Callable[[int, int], np.ndarray]:
            """What gives the values from one place to another of a file, without reading the others."""
            if isinstance(store, fs.LocalFileSystem):
                values = np.memmap(f"{top}/{name}", dtype, "r")
                return lambda a, b: values[a:b]
            file = store.open_input_file(f"{top}/{name}")
            return lambda a, b: np.frombuffer(file.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)

        for batch in batches:
            for part, base, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, at, docs = (opened(f"part-{part:06d}.{n}", np.dtype(d)) for n, d in (("bin", kind), ("idx", "<i8"), ("ids", "<i8")))
                for i in range(0, n_docs, 1000):
                    to = min(n_docs, i + 1000)
                    ends, names = at(i, to + 1), docs(i, to)
                    sums = [zlib.crc32(ids(a, b).astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == -(2**63)), pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.select("part", "base", "n_docs").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, read back from the files that were written."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remove_at_exit(docs, folder)
    return read(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
