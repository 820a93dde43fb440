"""Alignment of two tokenizers' tokens, with each distinct segment of the corpus tokenised once.

Texts are cut before runs of white space where neither vocabulary has an entry that goes over the
cut (`segments`), so a segment's tokens are the same wherever it stands.  Blocks of documents are
kept as a table: their distinct segments with counts, and each document as places in that list.
The distinct segments of all blocks are tokenised and aligned in a table of their own; the id
pairs' counts over the corpus follow from it and the segments' counts.  Both are joined back to
the blocks' lists, one row for a block and a distinct segment, and documents are composed block by
block.  A segment with a large share of all occurrences is one row in each block that has it.

Tokenizer A gets a blank and the text, tokenizer B puts that blank there itself.  A document whose
tokens' bytes differ from blank and text, as a null, empty or marked (U+2581) text's do, has no tokens
and counts nowhere.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import segments as S
from .shared import forget, keyed_join, written

PIECES = S.PATH + "piece_bpe_32k.model"
MARK = "▁"
#: bytes of texts whose segments are listed together; a longer text is a block of its own
BLOCK = 8 << 20
#: segments that are tokenised at a time
_AT_ONCE = 50_000

#: id pairs that are broadcast at most; beyond, the links meet their counts by a shuffle
MOST_PAIRS = 2_000_000
#: joined rows that a task packs by block at a time
_PACKED = 400_000

BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("spots", pa.binary()), ("segments", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
BLOCKS_DDL = "block bigint, doc_ids array<bigint>, ends array<bigint>, spots binary, segments array<string>, counts array<bigint>"
COUNTED = pa.schema([("segment", pa.string()), ("groups", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
COUNTED_DDL = "segment string, groups string, n_best bigint, count_sum bigint"
PACKED = pa.schema([("of_block", pa.int64()), *[(c, pa.binary()) for c in ("spots", "groups", "best", "sums")]])
PACKED_DDL = "of_block bigint, spots binary, groups binary, best binary, sums binary"
ALIGNED = pa.schema([
    ("segment_id", pa.int64()), ("segment", pa.string()), ("n", pa.int64()), ("groups", pa.string()), ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32())),
])
ALIGNED_DDL = "segment_id bigint, segment string, n bigint, groups string, link_a array<int>, link_b array<int>"
SPOILED = pa.schema([("segment", pa.string()), ("lost", pa.int64())])
COMPOSED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string()), ("groups", pa.string())])
COMPOSED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


class Pair:
    """Both tokenizers, their tokens' bytes, and the white space before which both allow a cut."""

    def __init__(self, bpe: str, pieces: str):
        import sentencepiece

        self.a = S.load_bpe(bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        entries = S.byte_level(self.a.get_vocab(with_added_tokens=True))
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        joined = [raw for i, raw in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.table = S.cut_table(self.a_bytes) & S.cut_table(joined)
        self.anchor = len(self.b.encode("a"))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B.  B puts a blank before a text: a segment gives its own first blank for it,
        and one that begins with other white space, or is a single blank, which would leave B an empty
        text without tokens, stands behind a letter, whose token is left out."""
        blank = [s.startswith(" ") and s != " " for s in segments]
        b = self.b.encode([s[1:] if own else "a" + s for s, own in zip(segments, blank, strict=True)], num_threads=1)
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, [ids if own else ids[self.anchor :] for ids, own in zip(b, blank, strict=True)]

    def align(self, segments: list[str]) -> tuple[list[str | None], list, list]:
        """For each segment: its groups as text (null if a tokenizer's tokens don't join to it), and the linked ids."""
        a, b = self.tokens(segments)
        raw = [s.encode() for s in segments]
        a_flat, b_flat = (np.fromiter((i for ids in t for i in ids), np.int64, sum(map(len, t))) for t in (a, b))
        whole = b"".join(raw)
        if any(b"".join([table[i] for i in flat.tolist()]) != whole for table, flat in ((self.a_bytes, a_flat), (self.b_bytes, b_flat))):
            valid = [b"".join([self.a_bytes[i] for i in x]) == s == b"".join([self.b_bytes[i] for i in y]) for x, y, s in zip(a, b, raw, strict=True)]
            if not all(valid):
                found = iter(zip(*self.align([s for s, good in zip(segments, valid, strict=True) if good]), strict=True))
                return tuple(zip(*(next(found) if good else (None, [], []) for good in valid), strict=True))
        a_ends, b_ends = np.cumsum(self.a_sizes[a_flat]), np.cumsum(self.b_sizes[b_flat])
        _, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        first = np.searchsorted(a_at, np.cumsum([0, *map(len, a)]))
        a_text, b_text = list(map(str, a_flat.tolist())), list(map(str, b_flat.tolist()))
        a_stops, b_stops = (a_at + 1).tolist(), (b_at + 1).tolist()
        groups = [",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m]) for i, j, k, m in zip([0, *a_stops[:-1]], a_stops, [0, *b_stops[:-1]], b_stops, strict=True)]
        cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        a_links, b_links = a_flat[a_at].tolist(), b_flat[b_at].tolist()
        return [";".join(groups[i:j]) for i, j in cuts], [a_links[i:j] for i, j in cuts], [b_links[i:j] for i, j in cuts]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on by their bytes' places, compressed; high bytes are mostly zero."""
    import zstandard

    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").reshape(-1)


@lru_cache(maxsize=2)
def pair_of(bpe: str, pieces: str) -> Pair:
    """A worker's own pair, read once."""
    return Pair(bpe, pieces)


def _listed(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """The blocks: ids, where each document's segments end, their places in the list of distinct ones."""

    def run(batches):
        base, k = TaskContext.get().partitionId() << 33, 0
        for part, block in B.blocks(batches, limit=BLOCK - (1 << 20)):
            spaced = _blank_before(block)
            starts = S.cuts(spaced, table)
            coded = S.strings(spaced, starts).dictionary_encode()
            spots = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.searchsorted(starts, spaced.off[1:])
            counts = np.bincount(spots, minlength=len(coded.dictionary))
            yield B.batch(BLOCKS, [base + k], [part.column(0).to_pylist()], [ends], [packed(spots)], pa.array([coded.dictionary.cast(pa.string()).to_pylist()], pa.list_(pa.string())), [counts])
            k += 1

    return docs.mapInArrow(run, BLOCKS_DDL)


def _blank_before(block: B.Block) -> B.Block:
    """The texts with a blank before each that isn't empty."""
    has = np.diff(block.off) > 0
    off = block.off + np.append(0, np.cumsum(has))
    buf = np.full(off[-1], 0x20, np.uint8)
    keep = np.ones(off[-1], bool)
    keep[off[:-1][has]] = False
    buf[keep] = block.buf
    return B.Block(buf, off)


def _lost(blocks: DataFrame, bad: DataFrame) -> DataFrame:
    """(segment, lost): how often segments stand in documents that hold a bad one."""

    def run(batches):
        for part in batches:
            for ends, spots, segments, marked in zip(*(part.column(k) for k in range(4)), strict=True):
                ends, spots = np.array(ends.values), unpacked(spots.as_py())
                wrong = np.isin(spots, np.array(marked.values))
                sums = np.append(0, np.cumsum(wrong))
                begins = np.append(0, ends[:-1])
                spoiled = np.repeat(sums[ends] > sums[begins], ends - begins)
                counts = np.bincount(spots[spoiled], minlength=len(segments))
                at = np.flatnonzero(counts)
                yield B.batch(SPOILED, segments.values.take(pa.array(at)), counts[at])

    met = blocks.select("block", F.posexplode("segments").alias("spot", "segment")).join(bad, "segment").groupBy("block").agg(F.collect_list("spot").alias("marked"))
    hit = blocks.select("block", "ends", "spots", "segments").join(met, "block").select("ends", "spots", "segments", "marked")
    return hit.mapInArrow(run, "segment string, lost bigint").groupBy("segment").agg(F.sum("lost").alias("lost"))


def _counted(aligned: DataFrame, counted: DataFrame) -> DataFrame:
    """(segment, groups, n_best, count_sum) of all segments; counted: valid ones, with their numbers in valid documents."""
    links = counted.select("segment_id", "n", F.explode(F.arrays_zip("link_a", "link_b")).alias("link")).select("segment_id", "n", F.col("link.link_a").alias("a"), F.col("link.link_b").alias("b"))
    counts = written(links.groupBy("a", "b").agg(F.sum("n").alias("pair_count"), F.count("*").alias("met")))
    best = counts.groupBy("b").agg(F.max("pair_count").alias("most"))  # a row for each B id at most: bounded by the vocabulary
    pairs = counts.join(F.broadcast(best), "b").select("a", "b", "met", "pair_count", (F.col("pair_count") == F.col("most")).cast("bigint").alias("best"))
    if counts.count() <= MOST_PAIRS:
        table = pairs.select(F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint")).alias("key"), "pair_count", "best").toArrow().sort_by("key")
        known = aligned.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("key", "pair_count", "best")])

        def run(batches):
            keys, sums, tops = known.value
            for part in batches:
                lists = part.column(2)
                off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                at = np.searchsorted(keys, np.asarray(lists.flatten()).astype(np.int64) << 32 | np.asarray(part.column(3).flatten()))
                by_link = (np.append(0, np.cumsum(x[at])) for x in (tops, sums))
                yield B.batch(COUNTED, part.column(0), part.column(1), *(x[off[1:]] - x[off[:-1]] for x in by_link))

        return aligned.select("segment", "groups", "link_a", "link_b").mapInArrow(run, COUNTED_DDL)
    sums = keyed_join(links.drop("n"), pairs, ["a", "b"], "met").groupBy("segment_id").agg(F.sum("best").alias("n_best"), F.sum("pair_count").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.join(sums, "segment_id", "left").select("segment", "groups", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def _by_block(batches):
    """Rows of a block's segments, packed together as far as a task meets them, so that few and dense rows are shuffled.

    A segment that isn't valid has no groups."""
    import zstandard

    def flushed(parts):
        table = pa.Table.from_batches(parts).sort_by([("of_block", "ascending"), ("spot", "ascending")]).combine_chunks()
        blocks, spots, best, sums = (table[c].to_numpy() for c in ("of_block", "spot", "n_best", "count_sum"))
        groups = pc.fill_null(table["groups"], "").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        texts = [zstandard.compress("\n".join(groups[i:j]).encode(), 3) for i, j in spans]
        return B.batch(PACKED, blocks[cuts[:-1]], [packed(np.diff(spots[i:j], prepend=0)) for i, j in spans], texts, *([packed(x[i:j]) for i, j in spans] for x in (best, sums)))

    held, n = [], 0
    for part in batches:
        if part.num_rows:
            held.append(part)
            n += part.num_rows
        if n > _PACKED:
            yield flushed(held)
            held, n = [], 0
    if held:
        yield flushed(held)


def _sides(groups: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A, tokens of B and groups of each text of groups."""
    text = np.frombuffer((";".join(groups) + ";").encode(), np.uint8)
    side = np.cumsum((text == 0x7C).astype(np.int8) - (text == 0x3B).astype(np.int8), dtype=np.int64)
    ends = np.cumsum(np.array([len(g) + 1 for g in groups], np.int64)) - 1
    comma = text == 0x2C

    def upto(mask):
        return np.diff(np.append(0, np.cumsum(mask)[ends]))

    n = upto(text == 0x3B)
    return upto(comma & (side == 0)) + n, upto(comma & (side == 1)) + n, n


def _composed(with_groups: bool):
    """Documents of a block from its list and the packed rows of its distinct segments."""
    import zstandard

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spot, groups, best, sums = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for one, texts, n, count in zip(*(right[c].to_pylist() for c in ("spots", "groups", "best", "sums")), strict=True):
            spot.append(np.cumsum(unpacked(one)))
            groups += zstandard.decompress(texts).decode().split("\n")
            best.append(unpacked(n))
            sums.append(unpacked(count))
        order = np.argsort(np.concatenate(spot))
        best, sums = np.concatenate(best)[order], np.concatenate(sums)[order]
        groups = [groups[k] for k in order.tolist()]
        bad = np.array([not g for g in groups], bool)
        n_a, n_b, n_groups = _sides([g or "|" for g in groups])  # one that isn't valid must not leave the others' sides off
        out = []
        for ids, ends, spots in zip(left["doc_ids"], left["ends"], left["spots"], strict=True):
            ends, spots = np.array(ends.values), unpacked(spots.as_py())
            begin = 0
            for doc_id, end in zip(ids.as_py(), ends.tolist(), strict=True):
                at = spots[begin:end]
                begin = end
                if not len(at) or bad[at].any():
                    out.append((doc_id, 0, 0, 0, 0, 0, 0, "", None if not with_groups else ""))
                    continue
                text = ";".join([groups[k] for k in at.tolist()])
                n = int(n_groups[at].sum())  # every group ends with one link
                out.append((doc_id, int(n_a[at].sum()), int(n_b[at].sum()), n, n, int(best[at].sum()), int(sums[at].sum()), hashlib.sha256(text.encode()).hexdigest(), text if with_groups else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COMPOSED, strict=True)], schema=COMPOSED) if out else COMPOSED.empty_table()

    return run


def align_tokens(docs: DataFrame, bpe: str = S.BPE, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """One row per document: tokens of both tokenizers, aligned groups, links and how common these are.

    A group ends at each byte where tokens of both end.  A link is a pair of tokens, one of each, whose
    byte ranges end together; an id pair's count is the number of its links in the corpus.  n_best are
    the links whose count is the highest of their B id, count_sum is the sum of the links' counts.
    groups has the ids as `a1,a2|b1;a3|b2,b3` (null unless with_groups), groups_sha256 its digest.

    Null and empty texts and such whose tokens don't join to blank and text have zeros and ''.  Repeated
    rows and ids are documents each by itself, and count as such.  Other columns are ignored.  An empty
    table gives an empty result.  A text without white space is one segment, however long.
    """
    blocks = written(_listed(B.text_rows(docs, id_col, text_col), pair_of(bpe, pieces).table))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("segments", "counts")).alias("spot", "one")).select("block", "spot", F.col("one.segments").alias("segment"), F.col("one.counts").alias("n"))

    def run(batches):
        own, base, k = pair_of(bpe, pieces), TaskContext.get().partitionId() << 33, 0
        for part in batches:
            for at in range(0, part.num_rows, _AT_ONCE):
                rows = part.slice(at, _AT_ONCE)
                yield B.batch(ALIGNED, np.arange(base + k, base + k + rows.num_rows), *rows.columns, *map(list, own.align(rows.column(0).to_pylist())))
                k += rows.num_rows

    distinct = listed.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = written(distinct.mapInArrow(run, ALIGNED_DDL))
    bad = aligned.where("groups is null").select("segment")
    counted = aligned.where("groups is not null")
    if not bad.isEmpty():
        counted = counted.join(_lost(blocks, bad), "segment", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost")
    # a segment has a row in each block that holds it, which is a small part of all rows for any segment
    back = listed.select(F.col("block").alias("of_block"), "spot", "segment").join(_counted(aligned, counted).hint("merge"), "segment").select("of_block", "spot", "groups", "n_best", "count_sum").mapInArrow(_by_block, PACKED_DDL)
    left = blocks.select("block", "doc_ids", "ends", "spots").groupBy("block")
    out = written(left.cogroup(back.groupBy("of_block")).applyInArrow(_composed(with_groups), COMPOSED_DDL))
    forget(blocks, aligned)
    return out
