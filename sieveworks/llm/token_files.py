"""Token ids in seekable zstandard files: a frame for each document, and a seek table at the end.

A file is a run of zstandard frames, so any zstandard reader can read it through:

    a frame for each document: its ids, little-endian, two bytes each where all ids of the
        document fit and four otherwise, with zstandard's own checksum
    a skippable frame (magic 0x184D2A50): place of the file among all, width of each frame's ids,
        documents' ids
    a skippable frame (magic 0x184D2A5E), the seek table of the public "seekable format": for each
        frame its compressed size, its size and the low half of the XXH64 of its content; then the
        number of frames, a descriptor (0x80: with checksums) and the magic 0x8F92EAB1

A reader goes to the end of a file, learns where each document's frame begins, and decompresses
the frames that are asked for.  The seek table counts the document frames alone, and they come
first, so the sum of sizes gives a frame's place.  A frame is checked against the seek table before
its ids are used.  A document with ids of 2 GB or more has no place in this format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import segments as S
from .shared import written

END_ID = 2
FILE_BYTES = 16 << 20
# The magic numbers of skippable frames and of the seek table.
DIRECTORY_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CACHE = 600_000
#: file rows and frame numbers that are broadcast at most; beyond, files' contents are shuffled to them
MOST_FILES, MOST_FRAMES = 100_000, 2_000_000
_TAIL = struct.Struct("<IBI")
_HEAD = struct.Struct("<qqI")

FILE = pa.schema([("roll", pa.int32()), ("value", pa.binary())])
INDEX = pa.schema([("file", pa.string()), ("part", pa.int64()), ("roll", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
INDEX_DDL = "file string, part bigint, roll bigint, n_docs bigint, n_ids bigint"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
READ_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"


class Encoder:
    """Encodes blocks of texts; the segments that a worker has met are kept, up to a bound."""

    def __init__(self, path: str):
        self.bpe = S.load_bpe(path, plain_specials=False)
        entries = S.byte_level(self.bpe.get_vocab(with_added_tokens=False))
        self.table = S.cut_table(list(entries.values()))
        self.specials = [t.content.encode() for t in self.bpe.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, block: B.Block) -> list[np.ndarray]:
        """The ids of each text, without an end id.

        Segments are cut where pre-tokens can't go over; each distinct one is encoded once.  A text with
        the string of a special token is encoded as it is, since that string is found before pre-tokens are."""
        starts = S.cuts(block, self.table, marks=True)
        coded = S.strings(block, starts).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        new = [k for k in keys if k not in known]
        for k, ids in zip(new, self._whole([k.decode("utf-8", "replace") for k in new]), strict=True):
            known[k] = ids.tobytes()
        parts = [known[k] for k in keys]
        place = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=place[1:])
        flat = np.frombuffer(b"".join(parts), "<u4")
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(place)[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = flat[np.repeat(place[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        texts = ends[np.searchsorted(starts, block.off)]
        out = [ids[a:b] for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)]
        raw = block.buf.tobytes()
        if any(s in raw for s in self.specials):
            for k, (a, b) in enumerate(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)):
                if any(s in raw[a:b] for s in self.specials):
                    out[k] = self._whole([raw[a:b].decode("utf-8", "replace")])[0]
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's own encoder, which keeps what it has met from task to task."""
    return Encoder(path)


class FileWriter:
    """Collects frames; closed() gives the file's bytes but the last four, the seek table's magic."""

    def __init__(self, part: int, roll: int, level: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.part, self.roll, self.frames, self.rows, self.docs, self.size = part, roll, [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        content = ids.astype("<u4" if wide else "<u2").tobytes()
        frame = self.pack.compress(content)
        self.frames.append(frame)
        self.rows.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.docs.append((4 if wide else 2, doc_id is not None, doc_id or 0))
        self.size += len(frame)

    def closed(self) -> bytes:
        widths, known, ids = zip(*self.docs, strict=True)
        directory = _HEAD.pack(self.part, self.roll, len(ids)) + bytes(widths) + bytes(known) + np.array(ids, "<i8").tobytes()
        table = np.array(self.rows, "<u4").tobytes() + _TAIL.pack(len(self.rows), 0x80, SEEKABLE)
        both = [struct.pack("<II", magic, len(body)) + body for magic, body in ((DIRECTORY_MAGIC, directory), (TABLE_MAGIC, table))]
        return b"".join([*self.frames, *both])[:-4]


class DamagedFile(ValueError):
    """A file or frame that doesn't hold what its seek table says."""


class FileReader:
    """The seek table and directory of a file, and the ids of the frames that are asked for."""

    def __init__(self, data):
        self.data = data
        n, kind, magic = _TAIL.unpack(data[-9:]) if len(data) >= 9 else (0, 0, 0)
        begin = len(data) - 9 - 12 * n
        if magic != SEEKABLE or kind != 0x80 or begin < 8 or struct.unpack("<II", data[begin - 8 : begin]) != (TABLE_MAGIC, 12 * n + 9):
            raise DamagedFile("no seek table at the end")
        rows = np.frombuffer(data, "<u4", 3 * n, begin).reshape(n, 3).astype(np.int64)
        self.ends = np.cumsum(rows[:, 0])
        self.sizes, self.sums = rows[:, 1], rows[:, 2]
        at = int(self.ends[-1]) if n else 0
        size = _HEAD.size + 10 * n
        if at + 8 + size != begin - 8 or struct.unpack("<II", data[at : at + 8]) != (DIRECTORY_MAGIC, size):
            raise DamagedFile("no directory before the seek table")
        self.part, self.roll, count = _HEAD.unpack(data[at + 8 : at + 8 + _HEAD.size])
        at += 8 + _HEAD.size
        self.widths = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        self.known = np.frombuffer(data, np.uint8, n, at + n).astype(bool)
        self.docs = np.frombuffer(data, "<i8", n, at + 2 * n)
        if count != n or not np.isin(self.widths, (2, 4)).all():
            raise DamagedFile("the directory doesn't fit the seek table")
        self.lengths = self.sizes // self.widths

    def ids(self, k: int) -> np.ndarray:
        """The ids of frame k; no other frame is touched."""
        import xxhash
        import zstandard

        end, size = int(self.ends[k]), int(self.sizes[k])
        begin = int(self.ends[k - 1]) if k else 0
        try:
            if zstandard.frame_content_size(self.data[begin:end]) != size:  # before memory is taken for it
                raise DamagedFile(f"frame {k}: size does not fit")
            content = zstandard.ZstdDecompressor().decompress(self.data[begin:end])
        except zstandard.ZstdError as e:
            raise DamagedFile(f"frame {k}: {e}") from e
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.sums[k]):
            raise DamagedFile(f"frame {k}: checksum does not fit")
        return np.frombuffer(content, "<u4" if self.widths[k] == 4 else "<u2").astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = S.BPE, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, level: int = 3) -> None:
    """Writes every text's ids in ascending order of ids (null first; equal ids by a hash of the text).

    Texts are whole; a null or empty text has the end id alone, or no ids.  Strings of special tokens
    become these tokens, as the library does by default.  Repeated rows are written again, and a
    repeated id of any number of rows is dealt to as many tasks as its texts and places need.  Other
    columns are ignored.  An empty table gives a folder without token files.  A task begins a new file
    after file_bytes of frames.  Spark's writer commits the files, so a task that is run again leaves one set.
    """

    def run(batches):
        encoder, part, roll = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        out = FileWriter(part, roll, level)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for rows, block in B.blocks(batches, limit=8 << 20):
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(block), strict=True):
                out.add(doc_id, np.concatenate([ids, tail]))
                if out.size >= file_bytes:
                    yield B.batch(FILE, [roll], [out.closed()])
                    roll += 1
                    out = FileWriter(part, roll, level)
        if out.docs:
            yield B.batch(FILE, [roll], [out.closed()])

    keyed = B.text_rows(docs, id_col, text_col).withColumns({"_of": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_of"), F.col("_row")]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = rows.mapInArrow(run, "roll int, value binary").select("roll", F.col("value").cast("string").alias("value"))
    # the text sink copies a string's bytes as they are and ends a row with the separator: the magic
    made.write.partitionBy("roll").option("lineSep", struct.pack("<I", SEEKABLE).decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return found.select("path", "content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, FileReader, int, pa.RecordBatch]]:
    for part in batches:
        for k in range(part.num_rows):
            yield part.column(0)[k].as_py(), FileReader(memoryview(part.column(1)[k].as_buffer())), k, part


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, from its seek table: documents, ids, and the ids of all files before it (`start`).

    Files of a task follow one another by `roll`, tasks by `part`; of the parts only one number each
    goes to the driver."""

    def run(batches):
        for name, found, _, _ in _contents(batches):
            yield B.batch(INDEX, [name], [found.part], [found.roll], [len(found.docs)], [int(found.lengths.sum())])

    index = written(_files(spark, path).mapInArrow(run, INDEX_DDL))
    sizes = sorted((r.part, r.n) for r in index.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    parts = spark.createDataFrame(rows, "part bigint, _before bigint")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("_inside", inside).join(F.broadcast(parts), "part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_token_files(spark: SparkSession, path: str, wanted: DataFrame | None = None, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row for each document of the files: id, place of its first id among all, count, CRC-32 and ids.

    wanted: a table of document ids (repeats and nulls in it are ignored); then only files that may
    hold one are joined with their part of the ids, and only those frames are decompressed.  A document
    that was written more than once comes as often.  A file whose seek table, directory or a wanted frame
    is damaged raises DamagedFile.  A folder without token files gives an empty result.
    """
    files = token_files(spark, path).select(F.col("file").alias("path"), "start")
    if wanted is None:
        chosen = files.withColumn("asked", F.lit(None).cast("array<int>"))
    else:
        chosen = written(_frames(spark, path, wanted, id_col).join(files, "path"))
    n_files, n_asked = chosen.agg(F.count("*"), F.sum(F.size("asked"))).first()
    small = n_files <= MOST_FILES and (n_asked or 0) <= MOST_FRAMES
    rows = _files(spark, path).join(chosen.hint("broadcast" if small else "merge"), "path").select("path", "content", "start", "asked")

    def run(batches):
        for _, found, k, part in _contents(batches):
            start, asked = part.column(2)[k].as_py(), part.column(3)[k].as_py()
            before = np.cumsum(found.lengths) - found.lengths + start
            picked, rows, size = sorted(asked) if asked is not None else range(len(found.docs)), [], 0
            for frame in picked:
                ids = found.ids(frame)
                rows.append((int(found.docs[frame]) if found.known[frame] else None, int(before[frame]), len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                size += 8 * len(ids) * with_ids + 64
                if size > B.BLOCK_BYTES:
                    yield B.batch(READ, *map(list, zip(*rows, strict=True)))
                    rows, size = [], 0
            if rows:
                yield B.batch(READ, *map(list, zip(*rows, strict=True)))

    return rows.mapInArrow(run, READ_DDL)


def _frames(spark: SparkSession, path: str, wanted: DataFrame, id_col: str) -> DataFrame:
    """(path, asked): the frames of wanted documents, by the files' directories."""
    schema = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("doc_id", pa.int64())])

    def run(batches):
        for name, found, _, _ in _contents(batches):
            at = np.flatnonzero(found.known)
            yield B.batch(schema, [name] * len(at), at.astype(np.int32), found.docs[at])

    held = _files(spark, path).mapInArrow(run, "path string, frame int, doc_id bigint")
    ids = wanted.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return held.join(ids, "doc_id").groupBy("path").agg(F.collect_list("frame").alias("asked"))
