"""Token-ID output: fixed-width bit packing with block offsets.

Every document is encoded, ends with an end id, and its ids are stored in the fewest bits that hold every id of the
vocabulary (16 for 49,408 ids).  Ids stand in blocks of ``BLOCK_IDS``; within a block, 64 ids of ``width`` bits
fill ``width`` 64-bit words, so packing and unpacking are shifts of whole numpy columns.  The footer holds
the offset of every block and the end of every document: any range of ids is read from its own blocks only.

1. Order.  Texts are dealt out by ranges of (id, text key, row number) and sorted there: one id, or one id and text,
   that a third of all rows hold is still split over tasks.
2. Files.  Each task encodes its range in order and streams blocks into files of about ``FILE_IDS`` ids below the
   folder (a shared one).  A file's name is new in every attempt of a task, and only the files that the attempts
   which Spark committed report make up the manifest: a lost executor leaves at most a file that nobody reads.
3. Reading.  The manifest gives each file's first id, so files are read apart from each other, a few blocks at a
   time.

Words are encoded once per worker process and remembered (``WORDS_HELD`` of them): the tokenizer's pieces never reach
over ASCII white space, so a text's ids are those of its words in order.  ``by_words=False`` encodes whole texts
instead, for tokenizers whose pieces do.

Defined results: NULL and empty texts have the end id only; repeated ids and rows each keep their ids, NULL ids
come last; a document of any length lies in one file, which may exceed ``FILE_IDS`` by it; an empty table gives a
manifest without rows; ids may be of any type that can be sorted; other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import io
import itertools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fs import _arrow_fs, is_uri, join, strip_file_scheme
from .tables import KEY, shuffle_partitions, with_key
from .words import SLICE_BYTES, row_slices, utf8

BLOCK_IDS = 1 << 16
#: ids of one file, about
FILE_IDS = 1 << 26
#: blocks that a reader holds at once
READ_BLOCKS = 32
#: words and their pieces whose ids a worker process remembers
WORDS_HELD = 500_000
PIECES_HELD = 400_000

_MAGIC = b"TMIDS\x00\x00\x01"
#: width, ids of a block, ids, blocks, place and length of the document index, checksum of the footer
_TAIL = struct.Struct("<IIQQQQI8s")
_U = np.uint64


def bits_for(largest: int) -> int:
    """The fewest bits that hold every id up to ``largest``."""
    return max(1, int(largest).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, in groups of 64 (the last one filled up with zeros)."""
    groups = -(-len(ids) // 64)
    v = np.zeros(groups * 64, np.uint64)
    v[: len(ids)] = ids
    if len(ids) and int(v.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    v, out = v.reshape(groups, 64), np.zeros((groups, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << _U(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> _U(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_ids(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as little-endian 32-bit numbers."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), 64), "<u4"), _U((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[:, word] >> _U(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << _U(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


def _open_write(path: str):
    if is_uri(path):
        fs, p, _ = _arrow_fs(path)
        return fs.open_output_stream(p)
    p = strip_file_scheme(path)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    return open(p, "wb")


def _open_random(path: str):
    if is_uri(path):
        fs, p, _ = _arrow_fs(path)
        return fs.open_input_file(p)
    return open(strip_file_scheme(path), "rb")


class TokenFileWriter:
    """Streams documents into one file; ``close`` writes the footer."""

    def __init__(self, path: str, width: int, block_ids: int = BLOCK_IDS):
        self.path, self.width, self.block_ids = path, width, block_ids
        self.out = _open_write(path)
        self.out.write(_MAGIC)
        self.at, self.offsets = len(_MAGIC), []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.doc_ids: list[pa.Array] = []
        self.ends: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in order: their ids one after the other, and how many each has."""
        self.doc_ids.append(doc_ids)
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.n_ids += len(ids)
        self.n_docs += len(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._blocks(self.n_held // self.block_ids * self.block_ids)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for lo in range(0, n, self.block_ids):
            data = pack_ids(ids[lo : min(lo + self.block_ids, n)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held = [ids[n:].copy()]
        self.n_held = len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._blocks(self.n_held)
        offsets = np.array([*self.offsets, self.at], "<u8").tobytes()
        sink = io.BytesIO()
        index = pa.table({"doc_id": pa.chunked_array(self.doc_ids), "end": pa.array(np.concatenate(self.ends), pa.int64())}) if self.ends else pa.table({"end": pa.array([], pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        footer = offsets + sink.getvalue()
        self.out.write(footer)
        self.out.write(_TAIL.pack(self.width, self.block_ids, self.n_ids, len(self.offsets), self.at, len(footer), zlib.crc32(footer), _MAGIC))
        self.out.close()


class TokenFile:
    """Random access to one file: ids by place, documents by number."""

    def __init__(self, path: str):
        self.path = path
        self.file = _open_random(path)
        size = self.file.seek(0, 2) or self.file.tell()
        if size < len(_MAGIC) + _TAIL.size:
            raise ValueError(f"{path}: cut off")
        self.file.seek(size - _TAIL.size)
        self.width, self.block_ids, self.n_ids, n_blocks, at, length, check, magic = _TAIL.unpack(self.file.read(_TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{path}: not a token file, or cut off")
        self.file.seek(at)
        footer = self.file.read(length)
        if zlib.crc32(footer) != check:
            raise ValueError(f"{path}: damaged footer")
        cut = 8 * (n_blocks + 1)
        self.offsets = np.frombuffer(footer[:cut], "<u8").astype(np.int64)
        self.index = pa.ipc.open_stream(footer[cut:]).read_all()
        self.ends = self.index.column("end").to_numpy()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, read from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            lo, hi = (int(self.offsets[k] - self.offsets[first]) for k in (b, b + 1))
            parts.append(unpack_ids(data[lo:hi], self.width, min(self.block_ids, self.n_ids - b * self.block_ids)))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def runs(self, blocks: int = READ_BLOCKS) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of the whole file, some blocks at a time."""
        step = blocks * self.block_ids
        for at in range(0, self.n_ids, step):
            yield at, self.ids(at, at + step)

    def close(self) -> None:
        self.file.close()


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


# fixed values: a normaliser and a pre-tokenizer, as tokenizer files state them, under which letters and punctuation are pieces
_FOLDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Latin letters that stay one letter in lower case and in NFC, whatever stands beside them
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250" and unicodedata.normalize("NFC", c) == c)
#: a run of them, and punctuation that ends a word
_PLAIN = re.compile(rf"([{_LETTERS}]*)([.,;:!?%&*$#()]*)")


class _Encoder:
    """Flat ids of many texts, each followed by the end id.

    Words of letters with punctuation at the end are, for a tokenizer that folds case and separates both, two pieces
    that its model encodes; other words go through the whole tokenizer, many of them together."""

    #: stands between words that are encoded together; words that hold it are encoded apart
    MARK = "\x02"
    #: words encoded together
    TOGETHER = 1000

    def __init__(self, tokenizer_json: str, end_id: int, by_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.end_id, self.by_words = end_id, by_words
        self.pieces: dict[str, tuple[int, ...]] = {"": ()}
        alone, a, ab = (self._ids([x])[0].tolist() for x in (self.MARK, "a", f"a {self.MARK} a"))
        self.mark = alone[0] if len(alone) == 1 and ab == [*a, *alone, *a] else None
        parts = json.loads(tokenizer_json)
        self.plain = parts["normalizer"] == _FOLDS and parts["pre_tokenizer"] == _SPLITS
        if self.plain:  # the model's spelling of each character
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.spelling = str.maketrans({c: "".join(p for p, _ in spell(c)) for c in {*_LETTERS, *".,;:!?%&*$#()"}})
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.number = _Numbers({None: 0})
        self.number.new = []
        self.first, self.ids = np.array([0, 1]), np.array([self.end_id], "<u4")
        if len(self.pieces) > PIECES_HELD:
            self.pieces = {"": ()}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = tuple([t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelling))])
        return ids

    def _learn(self) -> None:
        """The ids of the words numbered last."""
        words = self.number.new
        self.number.new = []
        each: list = [None] * len(words)
        if self.plain:
            for k, w in enumerate(words):
                m = _PLAIN.fullmatch(w)
                if m:
                    each[k] = self._piece(m[1].lower()) + self._piece(m[2])
        rest = [k for k, e in enumerate(each) if e is None]
        apart = [k for k in rest if self.mark is None or self.MARK in words[k]]
        for k, ids in zip(apart, self._ids([words[k] for k in apart])):
            each[k] = ids
        rest = [k for k in rest if each[k] is None]
        groups = [rest[k : k + self.TOGETHER] for k in range(0, len(rest), self.TOGETHER)]
        for group, ids in zip(groups, self._ids([f" {self.MARK} ".join(words[k] for k in g) + f" {self.MARK}" for g in groups])):
            marks = np.flatnonzero(ids == self.mark)
            for k, i, j in zip(group, [0, *(marks + 1).tolist()], marks.tolist()):
                each[k] = ids[i:j]
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(e) for e in each])])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(each), np.dtype("<u4"))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            each = [np.append(ids, np.array([self.end_id], "<u4")) for ids in self._ids(texts.to_pylist())]
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        if len(self.number) > WORDS_HELD:
            self._forget()
        words = pc.ascii_split_whitespace(texts)  # leaves empty words at the ends, which have no ids
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.number.new:
            self._learn()
        at = number[coded.indices.to_numpy()]
        # the end id is a last word of each text, number 0
        ends = np.cumsum(n_words + 1)
        every = np.zeros(len(at) + len(ends), np.int64)
        is_word = np.ones(len(every), bool)
        is_word[ends - 1] = False
        every[is_word] = at
        first = self.first[every]
        size = self.first[every + 1] - first
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(first - to[:-1], size)
        source += np.arange(len(source))
        return self.ids[source], np.diff(np.concatenate([[0], to[ends]]))


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_json: str, end_id: int, by_words: bool) -> _Encoder:
    """One encoder for all tasks of a worker process."""
    return _Encoder(tokenizer_json, end_id, by_words)


def _write_files(tokenizer_json, folder: str, width: int, end_id: int, by_words: bool, file_ids: int, block_ids: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        encoder, writer, done = None, None, []

        def finish():
            nonlocal writer
            if writer is not None:
                writer.close()
                done.append((part, len(done), writer.path, writer.n_docs, writer.n_ids))
                writer = None

        for batch in batches:
            encoder = encoder or _encoder(tokenizer_json.value, end_id, by_words)
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in row_slices(utf8(column)[1], min(4 * SLICE_BYTES, file_ids)):
                flat, counts = encoder.encode(column.slice(lo, hi - lo))
                if writer is not None and writer.n_ids + len(flat) > file_ids:
                    finish()
                if writer is None:
                    writer = TokenFileWriter(join(folder, f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin"), width, block_ids)
                writer.add(ids.slice(lo, hi - lo), flat, counts)
        finish()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["part", "number", "path", "n_docs", "n_ids"])

    return run


_MANIFEST = "part int, number int, path string, n_docs long, n_ids long"


def write_token_ids(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True,
    file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Writes the ids of all documents in ascending order of ``id_col`` below ``folder`` (shared by all executors) and
    returns the manifest (part, number, path, n_docs, n_ids), which also lies in ``folder/manifest``.

    ``tokenizer``: a tokenizer file of the tokenizers library, read on the driver and sent to the tasks."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    width = bits_for(max(Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True) - 1, end_id))
    sent = spark.sparkContext.broadcast(content)
    rows = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    order = [F.col("id").asc_nulls_last(), *KEY, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    done = dealt.select("id", "text").mapInArrow(_write_files(sent, folder, width, end_id, by_words, file_ids, block_ids), _MANIFEST)
    done.write.parquet(join(folder, "manifest"))
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(join(folder, "manifest"))


def _digests(batches):
    """(id, start, n_tokens, ids_crc32) of every document of each file, read some blocks at a time."""
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = TokenFile(path)
            starts = np.concatenate([[0], f.ends[:-1]])
            sums, doc = np.zeros(len(f.ends), np.int64), 0
            for at, ids in f.runs():
                view, stop = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), at + len(ids)
                while doc < len(f.ends):
                    lo, hi = max(int(starts[doc]), at), min(int(f.ends[doc]), stop)
                    sums[doc] = zlib.crc32(view[4 * (lo - at) : 4 * (hi - at)], int(sums[doc]))
                    if f.ends[doc] > stop:
                        break
                    doc += 1
            f.close()
            ids = f.index.column("doc_id").combine_chunks()
            for lo in range(0, len(sums), 10_000):
                s = slice(lo, lo + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 10_000), pa.array(base + starts[s], pa.int64()), pa.array(np.diff(np.append(starts[s], f.ends[s][-1])), pa.int64()), pa.array(sums[s], pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )


def _placed_files(manifest: DataFrame) -> DataFrame:
    """(path, base): each file with the number of ids before it.  The manifest has a row per file."""
    rows = sorted((r["part"], r["number"], r["path"], r["n_ids"]) for r in manifest.select("part", "number", "path", "n_ids").collect())
    base = np.concatenate([[0], np.cumsum([r[3] for r in rows])])
    spark = manifest.sparkSession
    files = spark.createDataFrame([(r[2], int(b)) for r, b in zip(rows, base)], "path string, base long")
    return files.repartitionByRange(max(1, len(rows)), "base")


def read_documents(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files of ``manifest``: id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit numbers)."""
    out = _placed_files(manifest).mapInArrow(_digests, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def _slices(wanted, base, f):
    for start, stop in wanted:
        lo, hi = max(start - base, 0), min(stop - base, f.n_ids)
        if lo < hi:
            yield start, base + lo, f.ids(lo, hi)


def read_ranges(manifest: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """(start, at, ids): the ids of some ranges of places (end excluded), in the pieces that lie in one file each; only
    the blocks that hold them are read."""
    wanted = sorted(ranges)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path)
                found = list(_slices(wanted, base, f))
                f.close()
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].astype(np.int64).tolist() for x in found], pa.list_(pa.int64()))],
                        names=["start", "at", "ids"],
                    )

    return _placed_files(manifest).mapInArrow(run, "start long, at long, ids array<bigint>")
