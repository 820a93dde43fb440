"""Removal of repeated passages, byte for byte, by suffix sorting.

Each byte that a `size`-byte string covers which also starts earlier (in a document with a
smaller id, or further up) is removed.  Two equal strings have the same least hash among
their GRAM-byte pieces, so each string belongs to the anchor with that hash; an anchor's
strings lie in one stretch of text, its context.  Only anchors whose hash occurs twice go
on.  Equal contexts collapse to the first before anything meets by the anchor's hash alone, so
a passage that stands in a third of all documents is one row from there on; different contexts
of one hash are sorted together as suffixes (two stages, then adjacent common prefixes), and
runs of `size` or more are equal strings.  Contexts of a very common hash are dealt to several
tasks; the distinct strings that are left there meet once more by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import forget, keyed_join, written
from .suffixes import common_prefixes, suffix_order

SIZE = 100
GRAM = 32
#: contexts of one hash that are sorted in one task; more are dealt to several
TOGETHER = 4000
SORT_BYTES = 1 << 20
_BLOCK = 1 << 19
_SEPARATOR = np.uint8(0xFF)  # in no UTF-8 text
_TOP, _SIGN = (1 << 63) - 1, -(1 << 63)

COUNTED = pa.schema([("h", pa.int64()), ("c", pa.int64())])
ANCHORS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("n", pa.int32())])
ANCHORS_DDL = "h bigint, doc bigint, part bigint, a bigint, n int"
CONTEXTS = pa.schema([*ANCHORS, ("x", pa.int64()), ("bytes", pa.binary())])
CONTEXTS_DDL = f"{ANCHORS_DDL}, x bigint, bytes binary"
FOUND = pa.schema([("doc", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("w", pa.int64())])
FOUND_DDL = "doc bigint, part bigint, a bigint, n int, h bigint, w bigint"
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("clean_text", pa.string()),
])
RESULT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, clean_text string"


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) at each place, by doubling."""
    h = B._BYTE_CODES[buf]
    k = 1
    while k < gram and len(h) > k:
        h = h[:-k] * B.U64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        k *= 2
    return B.mix(h) if k == gram else h[:0]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    step, least = 1, keys
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(block: B.Block, size: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its hash, its document, its strings' first start in it, and their number."""
    hashes = gram_hashes(block.buf, gram)
    width = size - gram + 1
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    bits = B.U64(len(hashes).bit_length())
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=B.U64)
    owner = (sliding_least(keys, width) & ((B.U64(1) << bits) - B.U64(1))).astype(np.int64)
    count = len(owner)
    fits = np.zeros(count + 1, np.int8)  # begins and ends of the starts that are far enough from their document's end
    long = np.flatnonzero(np.diff(block.off) >= size)
    np.add.at(fits, block.off[long], 1)
    np.add.at(fits, block.off[long + 1] - size + 1, -1)
    fits = np.cumsum(fits[:count]) > 0
    new = fits.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~fits[:-1]
    starts = np.flatnonzero(new)
    ends = fits.copy()
    ends[:-1] &= (owner[1:] != owner[:-1]) | ~fits[1:]
    n = np.flatnonzero(ends) + 1 - starts
    doc = np.searchsorted(block.off, starts, "right") - 1
    return hashes[owner[starts]].view(np.int64), doc, starts - block.off[doc], n


def _slices(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some stretches, one after another, and their offsets."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    return buf[np.arange(off[-1]) + np.repeat(starts - off[:-1], sizes)], off


def _binary(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def _contexts(part: pa.RecordBatch, block: B.Block, size: int) -> pa.RecordBatch:
    """A row for each of the documents' listed anchors; equal contexts of a block carry their bytes once."""
    lists = part.column(3)
    items, per_row = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    h, a, n = (np.asarray(items.field(k)) for k in range(3))
    row = np.repeat(np.arange(len(block)), per_row)
    starts = block.off[row] + a
    x = block.hashes(starts, starts + n + size - 1).view(np.int64)
    _, one = np.unique(np.stack([h, x], 1), axis=0, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
    sizes = np.zeros(len(h), np.int64)
    sizes[one] = n[one] + size - 1
    buf, off = _slices(block.buf, starts, sizes)
    ids, parts = np.asarray(part.column(0)), np.asarray(part.column(2))
    return B.batch(CONTEXTS, h, ids[row], parts[row], a, n.astype(np.int32), x, _binary(buf, off))


def _equal_strings(rows: pa.Table, size: int) -> pa.RecordBatch:
    """Of some contexts: the starts of strings with an equal one before, as runs (h and w null);
    and, of hashes dealt to several tasks, each distinct string's first start, with its hash w."""
    rows = rows.take(np.lexsort([np.asarray(rows[c]) for c in ("a", "part", "doc")]))
    col = {c: rows[c].to_numpy() for c in ("h", "doc", "part", "a", "n", "salts")}
    data, where = B.of_strings(rows["bytes"].combine_chunks())
    lengths = np.diff(where)
    text = np.full(int(lengths.sum()) + len(rows), _SEPARATOR)
    begins = where[:-1] - where[0] + np.arange(len(rows))
    text[np.arange(lengths.sum()) + np.repeat(np.arange(len(rows)), lengths)] = data[where[0] : where[-1]]
    owned = np.zeros(len(text) + 1, np.int64)
    owned[begins] += 1
    owned[begins + col["n"]] -= 1
    owned = np.cumsum(owned)[:-1] > 0
    order = suffix_order(text, size)
    equal = common_prefixes(text, order, size) >= size
    keep = owned[order]
    group, places = np.cumsum(~equal)[keep], order[keep]
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    first = np.minimum.reduceat(places, edges) if len(edges) else places
    later = np.ones(len(text), bool)
    later[first] = False
    again = np.flatnonzero(later & owned)
    runs = np.flatnonzero((np.diff(again, prepend=-2) != 1) | np.isin(again, begins))
    at, n = again[runs], np.diff(np.append(runs, len(again)))
    row = np.searchsorted(begins, at, "right") - 1
    first = np.sort(first)
    of = np.searchsorted(begins, first, "right") - 1
    dealt = col["salts"][of] > 1
    first, of = first[dealt], of[dealt]
    w = B.Block(text, np.array([0, len(text)])).hashes(first, first + size).view(np.int64)
    both = np.concatenate([row, of])
    starts = col["a"][both] + np.concatenate([at, first]) - begins[both]
    none = pa.nulls(len(at), pa.int64())
    return B.batch(
        FOUND, col["doc"][both], col["part"][both], starts, np.concatenate([n, np.ones(len(first), n.dtype)]).astype(np.int32),
        pa.concat_arrays([none, pa.array(col["h"][of], pa.int64())]), pa.concat_arrays([none, pa.array(w, pa.int64())]),
    )


def _sorted_blocks(batches, limit: int = SORT_BYTES):
    """Tables of about `limit` bytes of contexts, cut only between different (h, salt)."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column("h")), np.asarray(batch.column("salt"))], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        _, off = B.of_strings(batch.column("bytes"))
        begin = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            if size >= limit and tuple(key[a]) != last:
                held += [batch.slice(begin, a - begin)] * (a > begin)
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, a
            size += int(off[b] - off[a])
            last = tuple(key[a])
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _cleaned(part: pa.RecordBatch, block: B.Block, size: int, with_text: bool) -> pa.RecordBatch:
    """The documents without the bytes that the listed starts' strings cover."""
    cover = np.zeros(len(block.buf) + 1, np.int64)
    lists = part.column(3)
    per_row = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    items = lists.flatten()
    if len(items):
        starts = np.repeat(block.off[:-1], per_row) + np.asarray(items.field(0))
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + np.asarray(items.field(1)) - 1 + size, -1)
    covered = np.cumsum(cover)[:-1] > 0
    raw, rows = block.buf.tobytes(), []
    for k, (a, b) in enumerate(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)):
        spans, rest, at = [], [], a
        if per_row[k]:
            edge = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)).tolist()
            for s, e in zip(edge[::2], edge[1::2], strict=True):
                spans.append({"start": s, "end": e})
                rest.append(raw[at : a + s])
                at = a + e
        kept = b"".join([*rest, raw[at:b]])
        rows.append((b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "ignore") if with_text else None))
    ids, parts = np.asarray(part.column(0)), np.asarray(part.column(2))
    return B.batch(RESULT, pa.array(ids, pa.int64(), mask=(ids == _TOP) & (parts >= 0)), *(list(c) for c in zip(*rows, strict=True)))


def repeated_passages(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: its UTF-8 bytes, those removed, their maximal runs (byte spans),
    the digest of the rest, and the rest (without characters that a span cuts).

    Strings never cross documents and are judged on the input.  Null text counts as empty.
    Rows with the same id and text are one document, each with its verdict; of rows with the
    same id and other texts, those with the smaller text hash come first; rows without an id
    come after all others.  Other columns are ignored; an empty table gives an empty result.
    """
    if size < 2 * GRAM:
        raise ValueError(f"size must be {2 * GRAM} at least")
    rows = B.text_rows(docs, id_col, text_col)
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count()
    # rows without an id come last: theirs is the largest id and a part that is not negative
    own = F.xxhash64("text")
    part = F.when(F.col("doc_id").isNull(), own.bitwiseAND(F.lit(_TOP))).otherwise(own.bitwiseOR(F.lit(_SIGN))) if odd else F.lit(-1).cast("bigint")
    rows = rows.select(F.coalesce("doc_id", F.lit(_TOP)).alias("doc"), "text", part.alias("part"))

    def count(batches):
        for _, block in B.blocks(batches, limit=_BLOCK):
            h, c = np.unique(anchors(block, size)[0], return_counts=True)
            yield B.batch(COUNTED, h, c)

    def list_(batches):
        for some, block in B.blocks(batches, limit=_BLOCK):
            h, doc, a, n = anchors(block, size)
            yield B.batch(ANCHORS, h, np.asarray(some.column(0))[doc], np.asarray(some.column(2))[doc], a, n.astype(np.int32))

    def cut(batches):
        for some, block in B.blocks(batches):
            yield _contexts(some, block, size)

    def sort(batches):
        for some in _sorted_blocks(batches):
            yield _equal_strings(some, size)

    def clean(batches):
        for some, block in B.blocks(batches):
            yield _cleaned(some, block, size, with_text)

    twice = written(rows.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"))
    hits = written(keyed_join(rows.mapInArrow(list_, ANCHORS_DDL), twice, ["h"], "c").drop("c"))
    forget(twice)
    listed = hits.groupBy("doc", "part").agg(F.collect_list(F.struct("h", "a", "n")).alias("list"))
    contexts = written(rows.join(listed.hint("merge"), ["doc", "part"]).select("doc", "text", "part", "list").mapInArrow(cut, CONTEXTS_DDL))
    forget(hits)
    start = F.struct("doc", "part", "a")
    one = written(contexts.groupBy("h", "x").agg(F.min(F.struct("doc", "part", "a", "n")).alias("first"), F.max("bytes").alias("bytes"), F.count("*").alias("c")))
    # all strings of a context that has an equal one before
    again = one.where("c > 1").select("h", "x", F.struct("first.doc", "first.part", "first.a").alias("first"), "c")
    copies = written(keyed_join(contexts.drop("bytes"), again, ["h", "x"], "c").where(start != F.col("first")).select("doc", "part", "a", "n"))
    forget(contexts)
    # different contexts of one hash
    several = written(one.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").withColumn("salts", F.ceil(F.col("k") / TOGETHER)))
    dealt = keyed_join(one.select("h", "x", "first", "bytes"), several, ["h"], "k").select("h", F.pmod("x", "salts").alias("salt"), "salts", "first.*", "bytes")
    found = written(dealt.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(sort, FOUND_DDL))
    forget(one, several)
    open_ = found.where("w is not null")
    # a string occurs once in each of its hash's tasks, so these groups are as small as their number
    best = open_.groupBy("h", "w").agg(F.min(start).alias("first"))
    later = open_.join(best.hint("merge"), ["h", "w"]).where(start != F.col("first")).select("doc", "part", "a", "n")
    removed = copies.union(found.where("w is null").select("doc", "part", "a", "n")).union(later)
    by_doc = removed.groupBy("doc", "part").agg(F.collect_list(F.struct("a", "n")).alias("list"))
    return rows.join(by_doc.hint("merge"), ["doc", "part"], "left").select("doc", "text", "part", "list").mapInArrow(clean, RESULT_DDL)
