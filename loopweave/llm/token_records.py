"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of records, each framed like this (little-endian)::

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload
    payload = int64 doc_id | uint8 flags | ids

Flags: the low bits are the bytes of an id (2 for vocabularies up to 65,536, else
4), bit 7 marks a null doc_id. The checksum is CRC-32, rotated by 15 bits and
shifted by a constant, so that a checksum of data that holds checksums stays
sound. Documents are range-partitioned and sorted by id; each partition is one
file. The index is a Parquet table of (doc_id, shard, file, offset, size,
n_tokens, local_start): shuffled reads seek by it, and ``file`` names only the
files of tasks that were committed, whatever a lost executor left behind.

Defined cases: a null text is empty; an empty text is the end id alone; rows that
repeat an id are records of their own, in the order of their texts' hashes; a null id sorts first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.naming import unique_name
from loopweave.session import scratch_path, staged
from loopweave.sources.stores import store

END_ID = 2
CACHED_PIECES = 600_000  # of one generation of a worker's memory of pieces, about 120 MB

_HEAD, _META, _TAIL = "<QI", "<qB", "<I"
_MASK = 0xA282EAD8

#: Fixed values of byte-level vocabularies: how their text splits into words before the merges,
#: and the sign that stands for each byte (printable Latin-1 for itself, the rest from U+0100 on).
BYTE_LEVEL_WORDS = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_SPACE = BYTE_SIGNS[32]
PUNCTUATION = ".,;:!?%$#&*|-_/()[]"
#: From here on, libraries may differ in what they call a letter; the tokenizer decides alone.
FIRST_RARE = "\u0250"
#: The signs of the bytes of each character before that.
SIGNS = ["".join(BYTE_SIGNS.get(b, chr(b)) for b in chr(c).encode())
         for c in range(ord(FIRST_RARE))]

_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(_TAIL, masked(length)), payload,
                     struct.pack(_TAIL, masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; raises where a length or checksum is wrong."""
    length, check = struct.unpack_from(_HEAD, record)
    payload = record[struct.calcsize(_HEAD):-struct.calcsize(_TAIL)]
    if check != masked(record[:8]) or length != len(payload):
        raise ValueError("damaged record length")
    if struct.unpack(_TAIL, record[-struct.calcsize(_TAIL):])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


class Encoder(dict):
    """Ids of texts, with a bounded memory of pieces that were encoded before.

    The pre-tokenizer of a byte-level vocabulary never joins a character to a
    white-space character that follows it. So a text may be cut before every
    space that follows a non-space, and its ids are those of the pieces.
    """

    def __init__(self, vocabulary: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.code = {2: "H", 4: "I"}[self.width]  # little-endian, as the machines are
        self.merge = self.tokenizer.model.tokenize
        self.end = np.array([end_id], self.kind).tobytes()
        before = self.tokenizer.pre_tokenizer
        self.cuttable = (type(before).__name__ == "ByteLevel" and before.use_regex
                         and not before.add_prefix_space and self.tokenizer.normalizer is None
                         and type(self.tokenizer.model).__name__ == "BPE")

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def merged(self, words: list[str]) -> bytes:
        """Ids of pre-tokens, given in the signs of their bytes."""
        return array(self.code, [t.id for w in words for t in self.merge(w)]).tobytes()

    def __missing__(self, key: str | tuple[str]) -> bytes:
        """Keys are pieces without their first space, or tuples of a piece without one."""
        known = self.older.get(key)
        if len(self) >= CACHED_PIECES:  # pieces that were not used for a generation go
            self.older = dict(self)
            self.clear()
        if known is None:
            if type(key) is str and key.isalpha() and key.isascii():  # a single pre-token
                known = array(self.code, [t.id for t in self.merge(_SPACE + key)]).tobytes()
            else:
                known = self.made(key[0] if type(key) is tuple else " " + key)
        self[key] = known
        return known

    def made(self, piece: str) -> bytes:
        # The same two steps as in the library, without its bookkeeping of places. A
        # space and letters are one pre-token, and so is the punctuation behind them.
        word = piece.rstrip(PUNCTUATION)
        simple = word[:1] == " " and word[1:].isalpha()
        if simple and word != piece:
            return self[word[1:]] + self[(piece[len(word):],)]
        if simple and word.isascii():
            return self.merged([_SPACE + word[1:]])
        if piece and (piece.isascii() or max(piece) < FIRST_RARE):
            words = [piece] if simple else BYTE_LEVEL_WORDS.findall(piece)
            return self.merged([w.translate(SIGNS) for w in words])
        return self.plain(piece)

    def encode(self, text: str) -> bytes:
        if not self.cuttable or any(s in text for s in self.specials):
            return self.plain(text) + self.end
        if _SPACE_RUN.search(text):
            keys = [p[1:] if p[:1] == " " else (p,) for p in _CUT.split(text)]
        else:
            # Cut at the spaces themselves, so the keys need no strings but those of the cut.
            keys = text.split(" ")
            keys[0] = (keys[0],)
        return b"".join(map(self.__getitem__, keys)) + self.end


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """The encoder of a Python worker, kept for its next tasks with all it remembers."""
    # Code that travels by value has globals of its own in every task; a module has not.
    kept = sys.modules.setdefault("loopweave_kept_encoders", ModuleType("kept")).__dict__
    key = f"{end_id}-{hashlib.sha256(vocabulary.encode()).hexdigest()}"
    if key not in kept:
        for other in [k for k in kept if k[0].isdigit()]:
            del kept[other]  # one vocabulary at a time
        kept[key] = Encoder(vocabulary, end_id)
    return kept[key]


def write_records(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id",
                  text: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all documents in ascending id order below ``path``; returns the index."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or scratch_path(spark, "llm-records")
    # The vocabulary is one file of fixed size.
    vocabulary = spark.sparkContext.broadcast(Tokenizer.from_file(tokenizer_path).to_str())
    kind = ("doc_id long, shard long, file string, offset long, size long, n_tokens long, "
            "local_start long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(vocabulary.value, end_id), TaskContext.get().partitionId()
        files, folder = store(path)
        out, name, offset, start = None, None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(folder, recursive=True)
                name = unique_name(f"shard-{shard:06d}", ".rec")
                out = files.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
            rows = []
            for at in range(batch.num_rows):
                doc, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                ids = encoder.encode(content or "")
                flags = encoder.width | (128 if doc is None else 0)
                record = frame(struct.pack(_META, doc or 0, flags) + ids)
                out.write(record)
                n = len(ids) // encoder.width
                rows.append((doc, shard, name, offset, len(record), n, start))
                offset, start = offset + len(record), start + n
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "shard", "file", "offset", "size", "n_tokens", "local_start"])
        if out is not None:
            out.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(text, F.lit("")).alias("text"))
    # Rows that share an id, or have none, spread over ranges by the hash of their text.
    keyed = rows.withColumn("_hash", F.xxhash64("text")).withColumn(
        "_at", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "_at"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "text")
    index = staged(ordered.mapInArrow(write, kind), "index")
    index.records_at = path
    return index


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, shard, n_tokens, local_start, ids_crc32), from the files themselves.

    Length and both checksums of every record are checked. ``ids_crc32`` covers
    the ids as little-endian unsigned 32-bit integers.
    """
    kind = "doc_id long, shard long, n_tokens long, local_start long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        name, data = None, None
        for batch in batches:
            rows = []
            for file, offset, size, shard, start in zip(
                    *(batch.column(c).to_pylist() for c in (
                        "file", "offset", "size", "shard", "local_start"))):
                if file != name:
                    name, data = file, files.open_input_file(f"{folder}/{file}")
                payload = unframe(data.read_at(size, offset))
                doc, flags = struct.unpack_from(_META, payload)
                ids = np.frombuffer(payload, f"<u{flags & 127}", offset=struct.calcsize(_META))
                rows.append((None if flags & 128 else doc, shard, len(ids), start,
                             zlib.crc32(ids.astype("<u4").tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "shard", "n_tokens", "local_start", "ids_crc32"])

    return index.select("file", "offset", "size", "shard", "local_start").mapInArrow(read, kind)


def tokenized(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id",
              text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the records, read them back: doc_id, start, n_tokens, ids_crc32."""
    index = write_records(docs, tokenizer_path, doc_id, text, end_id)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so the window's single task is as long as the list of files.
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read_records(index, index.records_at).join(shards, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
