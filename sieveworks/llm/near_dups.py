"""Near-duplicates by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash (Ertl, 2017) gives each element a permutation of the signature's places and
lowers the place at step j to at most j + a uniform number; steps stop as soon as they are
beyond the signature's largest entry.  The places' values are correlated, which lowers the
variance of their share of matches.

Documents with equal shingle sets collapse first.  Representatives meet in the buckets of
their bands; every member is compared with the pivot that meets the most others first.  Only members
of a bucket that are then still in different components, and at least one of them outside the bucket's
largest, are compared in a second round.  There, a block of open members stays in a task and the
bucket's others stream by: first their sketches, to find the rows that have a likely partner, then the
shingle sets of these.  So large groups of copies never expand into rows of pairs, and yet every pair
of a bucket is either compared or known to be connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .graphs import components
from .shared import forget, keyed_join, written

SHINGLE = 5
PERCENT = 75
PLACES = 512
#: 85 bands of 6 of the signature's places: a pair at the threshold is missed with a probability
#: of 5.8e-8; pairs that share half of their shingles meet in three quarters of the cases
BANDS, ROWS = 85, 6
#: four bits of each place make a sketch; it estimates a similarity of 0.75 with a deviation of
#: 0.0204, so that one at the threshold falls six of these below in one of a billion cases
SKETCH_SLACK = 0.123
#: open members of a bucket, and shingles of them, that one task holds; those of a larger bucket are dealt to several
TOGETHER, HELD_SHINGLES = 500, 4_000_000
_CHUNK = 1 << 14

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SIGNED_DDL = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"


def shingle_sets(block: B.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, as 64-bit hashes sorted within it, and where each
    document's begin.  With fewer words than `size`, the whole sequence is the one shingle."""
    low = block.lowered()
    starts, stops, firsts = low.runs(B.INK)
    words = low.hashes(starts, stops)
    n = np.diff(firsts)
    take = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    of = np.repeat(np.arange(len(n)), take)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take) + firsts[of]
    value = np.full(len(of), size, B.U64)
    for k in range(size):
        inside = begin + k < firsts[of + 1]
        value = B.mix(value + np.where(inside, words[np.minimum(begin + k, max(len(words) - 1, 0))], B.U64(k + 1))) if len(of) else value
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(n) + 1))


def super_minhash(elements: np.ndarray, firsts: np.ndarray, m: int = PLACES) -> np.ndarray:
    """A signature of m places for each set of elements; a set without elements has m in all."""
    sets = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    out = np.full((len(firsts) - 1, m), float(m))
    flat = out.reshape(-1)
    for a in range(0, len(elements), _CHUNK):
        seed, of = elements[a : a + _CHUNK], sets[a : a + _CHUNK]
        low, high = of[0], of[-1] + 1
        places = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(seed), m)).copy()
        for j in range(m):
            draw = B.mix(seed + B.U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            uniform = (draw >> B.U64(11)).astype(np.float64) * 2.0**-53
            k = j + (B.mix(draw) % B.U64(m - j)).astype(np.int64)
            row = np.arange(len(seed))
            chosen = places[row, k]
            places[row, k] = places[:, j]
            np.minimum.at(flat, of * m + chosen, j + uniform)
            going = out[low:high].max(axis=1)[of - low] >= j + 1
            if not going.all():
                seed, of, places = seed[going], of[going], places[going]
                if not len(seed):
                    break
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(np.uint64)[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS))
    for k in range(ROWS):
        key = B.mix(key + B.mix(bits[:, :, k]))
    return key


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of a hash of each place, sixteen places to a number."""
    bits = B.mix(np.ascontiguousarray(signatures).view(np.uint64)) & B.U64(15)
    shifts = (np.arange(bits.shape[1], dtype=np.uint64) % B.U64(16)) * B.U64(4)
    return np.bitwise_or.reduce((bits << shifts).reshape(len(bits), -1, 16), axis=2).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part, block in B.blocks(batches):
            elements, firsts = shingle_sets(block)
            n = np.diff(firsts)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(len(elements) + 1, B.U64)
                np.cumsum(B.mix(elements ^ B.U64(salt)), out=total[1:])
                sums.append((total[firsts[1:]] - total[firsts[:-1]]).view(np.int64))
            # equal sets of a block are signed once
            _, one, which = np.unique(np.stack([*sums, n], 1), axis=0, return_index=True, return_inverse=True)
            take = np.concatenate([np.zeros(0, np.int64), *(np.arange(firsts[k], firsts[k + 1]) for k in one)])
            signatures = super_minhash(elements[take], np.concatenate([[0], np.cumsum(n[one])]))
            keys, short = band_keys(signatures)[which.ravel()], sketches(signatures)[which.ravel()]
            off = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys[n > 0].reshape(-1).view(np.int64)))
            shorts = pa.ListArray.from_arrays(pa.array(off // BANDS * short.shape[1]), pa.array(short[n > 0].reshape(-1)))
            yield B.batch(SIGNED, part.column(0), n, *sums, lists, shorts)

    return docs.mapInArrow(run, SIGNED_DDL)


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            for part, a in B.blocks([batch], text_at=2):
                b = B.Block(*_column(part, 3))
                (x, xs), (y, ys) = shingle_sets(a), shingle_sets(b)
                good = []
                for k in range(len(a)):
                    own, other = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                    at = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
                    both = int((other[at] == own).sum()) if len(other) else 0
                    good.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], schema=LINKS)

    one = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    two = one.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return two.select("u", "v", "text_u", "text_v").mapInArrow(run, "u bigint, v bigint").distinct()


def _column(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = B.of_strings(part.column(k))
    return buf[off[0] : off[-1]], off - off[0]


LIKELY = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("deal", pa.int32()), ("side", pa.int32()), ("rep", pa.int64()), ("component", pa.int64()), ("main", pa.int64())])
LIKELY_DDL = "band int, bucket bigint, deal int, side int, rep bigint, component bigint, main bigint"


def _dealt(open_: DataFrame) -> DataFrame:
    """A bucket's members as blocks: those outside its largest component (side 0) dealt to one or several, and all members for each (side 1)."""
    deals = F.greatest(F.ceil(F.col("rest") / TOGETHER), F.ceil(F.col("s") / HELD_SHINGLES)).cast("int")
    columns = ["band", "bucket", "deal", "side", "rep", "component", "main", "n_shingles", "sketch", "bands"]
    held = open_.where("component <> main").withColumns({"deal": F.pmod(F.xxhash64("rep"), deals).cast("int"), "side": F.lit(0)})
    others = open_.withColumns({"deal": F.explode(F.sequence(F.lit(0), deals - 1)), "side": F.lit(1)})
    return held.select(*columns).unionByName(others.select(*columns))


def _in_blocks(rows: DataFrame, compare, ddl: str) -> DataFrame:
    """compare(held, some) for each block's held members and slices of its others, as they stream by."""

    def run(batches):
        key, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(k)) for k in range(4)], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                this, side, part = tuple(marks[a, :3]), marks[a, 3], batch.slice(a, b - a)
                if side == 0:
                    if this != key:
                        key, parts = this, []
                    parts.append(part)
                    held = None
                elif this == key:
                    if held is None:
                        held = Held(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                    for at in range(0, part.num_rows, 64):
                        yield from compare(held, part.slice(at, 64))

    return rows.repartition("band", "bucket", "deal").sortWithinPartitions("band", "bucket", "deal", "side", "rep").mapInArrow(run, ddl)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return np.asarray(column.flatten()).view(np.uint64).reshape(len(column), -1)


class Held:
    """A block's open members, and what is worked out for them once."""

    def __init__(self, part: pa.RecordBatch):
        self.part, self.told = part, np.zeros(part.num_rows, bool)
        self.rep, self.component = np.asarray(part.column("rep")), np.asarray(part.column("component"))
        if "shingles" in part.schema.names:
            lists = part.column("shingles")
            values, self.sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
            order = np.argsort(values, kind="stable")
            self.values, self.owners = values[order], np.repeat(np.arange(part.num_rows), self.sizes)[order]
        else:
            self.sizes, self.sketch, self.bands = np.asarray(part.column("n_shingles")), _matrix(part.column("sketch")), _matrix(part.column("bands"))

    def comparable(self, part: pa.RecordBatch) -> np.ndarray:
        """(held, other) pairs that are to be compared: of different components, and each once."""
        rep, component, main = (np.asarray(part.column(c)) for c in ("rep", "component", "main"))
        return (self.component[:, None] != component) & ((component == main) | (self.rep[:, None] < rep))


def _likely_rows(percent: int):
    """Rows that have a partner which their sketches don't rule out, in the first band that the two share."""
    most = int((1 - (percent / 100 - SKETCH_SLACK)) * PLACES * 15 / 16)

    def compare(held: Held, part: pa.RecordBatch):
        n = np.asarray(part.column("n_shingles"))
        small, large = np.minimum(held.sizes[:, None], n), np.maximum(held.sizes[:, None], n)
        x, y = np.nonzero(held.comparable(part) & (100 * small >= percent * large))
        if not len(x):
            return
        sketch, bands, band = _matrix(part.column("sketch")), _matrix(part.column("bands")), int(np.asarray(part.column("band"))[0])
        d = held.sketch[x] ^ sketch[y]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        good = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1) <= most
        good &= ~(held.bands[x, :band] == bands[y, :band]).any(1)
        mine = np.zeros(held.part.num_rows, bool)
        mine[x[good]] = True
        for rows, mask in ((held.part, mine & ~held.told), (part, np.isin(np.arange(part.num_rows), y[good]))):
            if mask.any():
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(mask)) for c in LIKELY.names], schema=LIKELY)
        held.told |= mine

    return compare


def _elements(batches):
    """The shingle set of each text."""
    for part, block in B.blocks(batches):
        elements, firsts = shingle_sets(block)
        lists = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(elements.view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "shingles"])


def _block_links(percent: int):
    """The pairs of a block whose full shingle sets are similar enough."""

    def compare(held: Held, part: pa.RecordBatch):
        wanted, lists = held.comparable(part), part.column("shingles")
        values, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
        rep, found = np.asarray(part.column("rep")), []
        low, high = np.searchsorted(held.values, values, "left"), np.searchsorted(held.values, values, "right")
        for y, end in enumerate(ends.tolist()):
            begin = int(ends[y - 1]) if y else 0
            n = high[begin:end] - low[begin:end]
            places = np.arange(n.sum()) + np.repeat(low[begin:end] - np.cumsum(n) + n, n)
            both = np.bincount(held.owners[places], minlength=len(held.rep))
            good = np.flatnonzero(wanted[:, y] & (both > 0) & (100 * both >= percent * (held.sizes + (end - begin) - both)))
            found += [(max(int(held.rep[x]), int(rep[y])), min(int(held.rep[x]), int(rep[y]))) for x in good]
        if found:
            yield B.batch(LINKS, *map(list, zip(*found, strict=True)))

    return compare


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set's size, the least id that it is linked with, and whether
    it is that one (kept).

    Links hold at 100 * intersection >= percent * union of the distinct shingles.  Null,
    empty and blank texts have no shingles and no links.  Rows that repeat an id are one
    document with several texts; a null id has a null component and is kept.  Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = B.text_rows(docs, id_col, text_col)
    signed = written(_signed(rows))
    key = ["n_shingles", "set_a", "set_b"]
    # documents with equal sets: one stands for all
    sets = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    )
    spread = written(sets.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket")))
    shared = written(spread.groupBy("band", "bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("size")).where("least <> most").select("band", "bucket", "size"))
    # members of buckets with two documents or more; a document that meets many others is a good pivot
    members = written(keyed_join(spread, shared, ["band", "bucket"], "size"))
    forget(spread, shared)
    scores = written(members.groupBy("rep").agg(F.sum("size").alias("score")))
    scored = written(members.join(scores.hint("merge"), "rep").select("rep", "n_shingles", "band", "bucket", F.struct("score", (-F.col("rep")).alias("minus")).alias("rank")))
    pivots = written(scored.groupBy("band", "bucket").agg(F.max("rank").alias("best"), F.count("*").alias("size")))
    wanted = keyed_join(scored, pivots, ["band", "bucket"], "size").groupBy("rep").agg(F.max("best").alias("best"), F.first("n_shingles").alias("n_shingles"))
    wanted = written(wanted.select("rep", "n_shingles", (-F.col("best.minus")).alias("pivot")))
    forget(scores, scored, pivots)
    texts = written(rows.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    tried = wanted.where("rep <> pivot").select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v")).distinct()
    first = written(_confirmed(tried, texts, percent))
    near = written(components(first))
    # second round: buckets that still hold several components
    placed = written(members.join(near.select(F.col("u").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("rep", "n_shingles", "band", "bucket", "component"))
    forget(first, members)
    mixed = written(placed.groupBy("band", "bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a <> b").select("band", "bucket", "size"))
    inside = written(keyed_join(placed, mixed, ["band", "bucket"], "size").drop("size"))
    forget(placed, mixed)
    sizes = inside.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = written(sizes.groupBy("band", "bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"), F.sum("s").alias("s"), F.sum("n").alias("size")))
    open_ = written(keyed_join(inside, main, ["band", "bucket"], "size").drop("size").join(sets.select("rep", "sketch", "bands").hint("merge"), "rep"))
    forget(inside, main)
    likely = written(_in_blocks(_dealt(open_), _likely_rows(percent), LIKELY_DDL))
    elements = written(texts.join(likely.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_elements, "rep bigint, shingles array<bigint>"))
    links = _in_blocks(likely.join(elements, "rep").select("band", "bucket", "deal", "side", "rep", "component", "main", "shingles"), _block_links(percent), "u bigint, v bigint").distinct()
    second = written(near.select("u", F.col("component").alias("v")).unionByName(links))
    forget(texts, wanted, open_, likely, elements, near)
    near = written(components(second))
    forget(second)
    whole = written(sets.select(*key, "rep", "copies").join(near.select(F.col("u").alias("rep"), "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"), "copies"))
    forget(near, sets)
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    own = keyed_join(signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", *key), whole, key, "copies").select("doc_id", "n_shingles", "component_id")
    return own.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
