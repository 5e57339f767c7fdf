"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A shard file holds, in ascending document order,

* frames, each a zstandard frame of its own with a content checksum, of the ids of whole documents
  as little-endian unsigned 32-bit numbers; a frame is closed once it holds ``FRAME_IDS`` ids;
* a skippable frame with the document index: for each document its id, whether it has one, its
  frame, its first id within the frame and its number of ids (a compressed block of five arrays);
* a skippable frame with the seek table of the public seekable format: compressed size,
  decompressed size and the low 32 bits of XXH64 of the decompressed bytes per frame, then the
  number of frames, a descriptor and the magic number.

A reader fetches the seek table and the index from the end of a file and then only the frames it
needs, and verifies their checksums. ``manifest`` is a Parquet table of the shards with the number
of ids before each. Shards are written under a name of the task attempt and moved into place, so
a task that runs again after a lost executor replaces its own shard by an equal one.

Documents are dealt to shards by ranges of ids; rows with equal ids keep together and are ordered by
text. A null id sorts first and is read back as null; a null text counts as empty.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memo import per_worker

FRAME_IDS = 1 << 16
LEVEL = 3
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
WORDS_HELD = 250_000   # words of one generation; two are held
ROWS = 384
# Latin-1 characters by what the tokenizer's pattern sees: letters and numbers, blanks, and marks as full stops.
MARKS = bytes(ord("a") if chr(c).isalpha() or unicodedata.category(chr(c))[0] == "N" else ord(" ") if chr(c) in " \t\n\v\f\r\x85\xa0" else ord(".") for c in range(256))


class WordIds:
    """Ids of texts by a tokenizers file whose words never cross a blank.

    The library encodes each different word once. To it, a letter next to a mark is the border of two
    units and case does not count; so in a text of Latin-1 characters without two marks in a row, full
    stops and commas are set apart and letters folded first, which leaves fewer different words.
    """

    def __init__(self, path: str):
        # Spark deals the work to tasks; threads of the library's own would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library_ids(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(words, add_special_tokens=False)]

    def _letter_ids(self, words: list[str]) -> Iterator[bytes]:
        """Many words of letters in one call; the library tells which word an id belongs to."""
        for at in range(0, len(words), 2048):
            part = words[at:at + 2048]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(found.word_ids, np.int64)
            if owner[-1] != len(part) - 1:   # some letter is more than one unit when normalized
                yield from self._library_ids(part)
            else:
                cuts = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
                raw = np.array(found.ids, "<u4").tobytes()
                yield from (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))

    def _learn(self, words: set[str]) -> None:
        held = self.held
        new = [w for w in words if w not in held]
        if not new:
            return
        if len(held) + len(new) > WORDS_HELD:   # the young generation becomes the old one; words met again move back
            self.old, self.held = held, {}
            held, new = self.held, list(words)
        old = self.old
        held.update((w, old[w]) for w in new if w in old)
        held[""] = b""
        new = [w for w in new if w not in held]
        letters = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        held.update(zip(letters, self._letter_ids(letters), strict=True))
        held.update(zip(other, self._library_ids(other), strict=True))

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:
            if b".." not in text.encode("latin-1").translate(MARKS):
                text = text.lower().replace(".", " . ").replace(",", " , ")
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        words = [self.words(x) for x in texts]
        different: set[str] = set()
        for x in words:
            different.update(x)
        self._learn(different)
        get = self.held.__getitem__
        return [b"".join(map(get, x)) + end for x in words]


class ShardWriter:
    """Writes one shard to an open binary stream."""

    def __init__(self, stream):
        self.stream, self.parts, self.size, self.frames = stream, [], 0, []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.ids, self.known, self.frame, self.first, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.frame.append(len(self.frames))
        self.first.append(self.size // 4)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.parts)
        packed = self.compressor.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.size = [], 0

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.parts:
            self._close_frame()
        arrays = (np.array(self.ids, "<i8"), np.array(self.known, "u1"), np.array(self.frame, "<u4"), np.array(self.first, "<u8"), np.array(self.counts, "<u8"))
        index = struct.pack("<Q", len(self.ids)) + self.compressor.compress(b"".join(a.tobytes() for a in arrays))
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*x) for x in self.frames) + FOOTER.pack(len(self.frames), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return len(self.ids), sum(self.counts)


class ShardReader:
    """Random access to one shard through a seekable binary file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        footer = self._at(size - FOOTER.size, FOOTER.size)
        frames, descriptor, magic = FOOTER.unpack(footer)
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        table = self._at(size - FOOTER.size - frames * ENTRY.size, frames * ENTRY.size)
        self.frames = [ENTRY.unpack_from(table, i * ENTRY.size) for i in range(frames)]
        self.begin = np.concatenate([[0], np.cumsum([x[0] for x in self.frames])]).astype(np.int64)
        index = self._at(int(self.begin[-2]) + 8, self.frames[-1][0] - 8)
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != self.frames[-1][2]:
            raise ValueError("checksum of the document index")
        (n,) = struct.unpack_from("<Q", index)
        raw, at = zstandard.ZstdDecompressor().decompress(index[8:]), 0
        columns = []
        for kind in ("<i8", "u1", "<u4", "<u8", "<u8"):
            columns.append(np.frombuffer(raw, kind, n, at))
            at += columns[-1].nbytes
        self.ids, self.known, self.frame, self.first, self.counts = columns

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def read_frame(self, k: int) -> bytes:
        packed_size, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed_size), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {k}")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """Id, first id of the document within the shard and its ids; only frames that are needed are read."""
        starts = np.cumsum(self.counts) - self.counts
        held, raw = -1, b""
        for i in range(len(self.ids)):
            doc = int(self.ids[i]) if self.known[i] else None
            if wanted is not None and doc not in wanted:
                continue
            if self.frame[i] != held:
                held = int(self.frame[i])
                raw = self.read_frame(held)
            a = 4 * int(self.first[i])
            yield doc, int(starts[i]), raw[a:a + 4 * int(self.counts[i])]


def _place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write shards and ``manifest`` into ``folder``, which all executors share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    shards = max(rows.rdd.getNumPartitions(), 1)
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        gc.disable()   # nothing here is cyclic, and the collector walks all lists of words again and again
        try:
            yield from shard(batches)
        finally:
            gc.enable()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}.tokens"
        own = f"{base}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        encoder, end = per_worker("words", tokenizer, lambda: WordIds(tokenizer)), np.array([end_id], "<u4").tobytes()
        with system.open_output_stream(own) as stream:
            writer = ShardWriter(stream)
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    part = whole.slice(at, ROWS)
                    for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end), strict=True):
                        writer.add(doc, ids)
            n_docs, n_ids = writer.close()
        system.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    written = rows.mapInArrow(write, "shard long, file string, n_docs long, n_ids long")
    written.write.parquet(f"{folder}/_written")
    # One row per shard, far fewer than documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = spark.read.parquet(f"{folder}/_written")
    listed.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian bytes).

    ``wanted`` is a stated list of document ids; frames without any of them are not decompressed.
    """
    listed = spark.read.parquet(f"{folder}/manifest")
    listed = listed.repartition(max(1, listed.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        asked = None if wanted is None else set(wanted)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}") as file:
                    out, size = [], 0
                    for doc, start, ids in ShardReader(file).documents(asked):
                        out.append((doc, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return listed.select("file", "ids_before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
