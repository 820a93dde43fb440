"""Benchmark passages in training texts, found with an FM-index over each shard.

A shard is a few MB of a task's documents.  Its text is a sequence of benchmark word
numbers; words and word pairs that no benchmark item has cannot lie inside an occurrence
and become separators, so the index holds what is left between them.  All windows of the
benchmark are searched backwards at once through the ranks of a wavelet tree over the
Burrows-Wheeler transform, and occurrences are located by stepping to sampled suffix
positions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import forget, written

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 8 << 20
#: text bytes of the benchmark that are searched for in one pass over the documents
ITEM_BYTES = 8 << 20

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("clean_text", pa.string()),
])
#: what passes before the last one pass on: words hit so far, and items
STATE_DDL = ", `_hits` array<struct<a:bigint,b:bigint>>, `_items` array<string>"
STATE = pa.schema([("_hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("_items", pa.list_(pa.string()))])
DDL = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, clean_text string"


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class WaveletTree:
    """Ranks of any symbol in a sequence, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        first = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            r, f = bits.rank(at), bits.rank(first)
            at, first = np.where(one, zeros + r, at - r), np.where(one, zeros + f, first - f)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one, r = bits.get(at), bits.rank(at)
            out |= one.astype(at.dtype) << bit
            at = np.where(one, zeros + r, at - r)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length they are sorted by.  0 is a separator; each
    is smaller than all words and differs from every other one."""
    n = len(symbols)
    is_cut = symbols == 0
    rank = np.where(is_cut, np.cumsum(is_cut), symbols.astype(np.int64) + is_cut.sum())
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (max(int(rank.max()), int(second.max())) + 2) + second
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[1], key[order[1:]] != key[order[:-1]]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        if steps.all():
            return order
        k *= 2


class FMIndex:
    """Counts and places of word sequences in a text of word numbers, 0 between its parts."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        self.n = len(symbols)
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the first suffix follows the last symbol, a separator
        self.tree = WaveletTree(before.astype(np.int64), top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        known = (order % sample == 0) | (before == 0)  # a step never has to cross a separator
        self.known, self.places = Bits(known), order[known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row of patterns (0-padded on the left): its range of suffixes, [low, high)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = live[(patterns[live, column] > 0) & (low[live] < high[live])]
            c = patterns[live, column]
            low[live] = self.smaller[c] + self.tree.rank(c, low[live])
            high[live] = self.smaller[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to one with a sampled position."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.known.get(at)
            ends = open_[done]
            out[ends] = self.places[self.known.rank(at[done])] + steps[ends]
            open_ = open_[~done]
            at = at[~done]
            c = self.tree.symbol(at)
            rows[open_] = self.smaller[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return out


@dataclass
class Windows:
    """The windows of some benchmark items, over the words that these have."""

    words: np.ndarray  # sorted word hashes; a word's number is its place from 1
    pairs: np.ndarray  # sorted keys of adjacent words
    least: int  # words of the shortest window
    patterns: np.ndarray  # a window a row, 0-padded on the left
    lengths: np.ndarray
    first_item: np.ndarray  # where each window's items begin in items
    items: np.ndarray  # numbers of items, by window
    ids: list[str]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def windows_of(items: list[tuple[str, str | None]], size: int = WINDOW) -> Windows | None:
    """Every run of `size` words of each item; an item of fewer words is one window."""
    buf, off = B.of_strings(pa.array([t for _, t in items], pa.string()))
    block = B.Block(buf, off).lowered()
    starts, stops, firsts = block.runs(B.ALNUM)
    if not len(starts):
        return None
    hashes = block.hashes(starts, stops)
    words = np.unique(hashes)
    numbers = np.searchsorted(words, hashes) + 1
    pairs, rows, of = [np.zeros(0, np.int64)], [], []
    for k, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        if b == a:
            continue
        own = numbers[a:b]
        pairs.append(own[:-1] * (len(words) + 1) + own[1:])
        width = min(size, len(own))
        view = np.lib.stride_tricks.sliding_window_view(own, width)
        rows.append(np.pad(view, ((0, 0), (size - width, 0))))
        of.append(np.full(len(view), k))
    patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    owned = np.unique(np.stack([which.ravel(), np.concatenate(of)], 1), axis=0)
    first = np.searchsorted(owned[:, 0], np.arange(len(patterns) + 1))
    lengths = (patterns > 0).sum(1)
    return Windows(words, np.unique(np.concatenate(pairs)), int(lengths.min()), patterns, lengths, first, owned[:, 1], [i for i, _ in items])


def _chains(block: B.Block, firsts: np.ndarray, hashes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of words whose neighbours are neighbours in some item, long enough for
    a window: first words, lengths, and all words' numbers."""
    numbers = windows.numbers(hashes)
    n = len(numbers)
    linked = np.zeros(n + 1, bool)  # with the word before
    if n > 1 and len(windows.pairs):
        key = numbers[:-1] * (len(windows.words) + 1) + numbers[1:]
        at = np.minimum(np.searchsorted(windows.pairs, key), len(windows.pairs) - 1)
        linked[1:n] = (windows.pairs[at] == key) & (numbers[:-1] > 0) & (numbers[1:] > 0)
        linked[firsts[firsts < n]] = False
    starts = np.flatnonzero(~linked[:n])
    sizes = np.diff(np.append(starts, n))
    good = (sizes >= windows.least) & (numbers[starts] > 0) if n else np.zeros(0, bool)
    return starts[good], sizes[good], numbers


@dataclass
class _Pending:
    part: pa.RecordBatch
    block: B.Block
    starts: np.ndarray
    stops: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray


def _shard_hits(shard: list[_Pending], windows: Windows, hit: list[np.ndarray], items: list[dict[int, set]]) -> None:
    """Marks the words inside occurrences, and notes the items, of every document."""
    texts, where = [], []
    for k, p in enumerate(shard):
        starts, sizes, numbers = _chains(p.block, p.firsts, p.hashes, windows)
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            texts += [numbers[a : a + n], np.zeros(1, np.int64)]
            where.append((k, a, n + 1))
    if not where:
        return
    symbols = np.concatenate(texts)
    index = FMIndex(symbols, len(windows.words))
    low, high = index.search(windows.patterns)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    places = index.locate(rows)
    begins = np.cumsum([0] + [n for _, _, n in where])
    chain = np.searchsorted(begins, places, "right") - 1
    for w, c, place in zip(which.tolist(), chain.tolist(), places.tolist(), strict=True):
        k, a, _ = where[c]
        word = a + place - int(begins[c])
        hit[k][word : word + windows.lengths[w]] = True
        doc = int(np.searchsorted(shard[k].firsts, word, "right")) - 1
        items[k].setdefault(doc, set()).update(windows.items[windows.first_item[w] : windows.first_item[w + 1]].tolist())


_built: tuple[str, Windows | None] | None = None


def _windows(key: str, items: list[tuple[str, str]], size: int) -> Windows | None:
    """The windows of a pass's items, built once in each of Spark's Python workers."""
    global _built
    if _built is None or _built[0] != key:
        _built = key, windows_of(items, size)
    return _built[1]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _searched(shard: list[_Pending], windows: Windows | None, at: int | None) -> tuple[list[np.ndarray], list[dict[int, set]]]:
    """Each block's hit words and the items of each document; at: where the columns of a state begin."""
    hit = [np.zeros(len(p.starts), bool) for p in shard]
    names: list[dict[int, set]] = [{} for _ in shard]
    if at is not None:
        for p, h, name in zip(shard, hit, names, strict=True):
            for doc, (runs, items) in enumerate(zip(p.part.column(at).to_pylist(), p.part.column(at + 1).to_pylist(), strict=True)):
                for r in runs:
                    h[p.firsts[doc] + r["a"] : p.firsts[doc] + r["b"]] = True
                if items:
                    name[doc] = set(items)
    if windows is not None:
        numbers: list[dict[int, set]] = [{} for _ in shard]
        _shard_hits(shard, windows, hit, numbers)
        for name, by_doc in zip(names, numbers, strict=True):
            for doc, found in by_doc.items():
                name.setdefault(doc, set()).update(windows.ids[i] for i in found)
    return hit, names


def _states(shard: list[_Pending], windows: Windows | None, at: int | None, columns: int):
    for p, h, name in zip(shard, *_searched(shard, windows, at), strict=True):
        ends = zip(p.firsts[:-1].tolist(), p.firsts[1:].tolist(), strict=True)
        runs = [[{"a": i, "b": j} for i, j in _runs(h[a:b])] if h[a:b].any() else [] for a, b in ends]
        own = B.batch(STATE, runs, [sorted(name.get(doc, ())) for doc in range(len(runs))])
        names = [*p.part.schema.names[:columns], *STATE.names]
        yield pa.RecordBatch.from_arrays([*(p.part.column(k) for k in range(columns)), *own.columns], names=names)


def _results(shard: list[_Pending], windows: Windows | None, at: int | None, with_text: bool, carry: tuple[str, ...]):
    for p, h, name in zip(shard, *_searched(shard, windows, at), strict=True):
        raw = p.block.buf.tobytes() if with_text or h.any() else b""
        hits, spans, found, clean = [], [], [], []
        for doc, (a, b) in enumerate(zip(p.firsts[:-1].tolist(), p.firsts[1:].tolist(), strict=True)):
            own, base, end = h[a:b], int(p.block.off[doc]), int(p.block.off[doc + 1])
            hits.append(int(own.sum()))
            found.append(sorted(name.get(doc, ())))
            out, rest, last, chars = [], [], base, 0
            for i, j in _runs(own) if hits[-1] else ():
                s, e = int(p.starts[a + i]), int(p.stops[a + j - 1])
                rest.append(raw[last:s])
                chars += len(rest[-1].decode("utf-8", "replace"))
                n = len(raw[s:e].decode("utf-8", "replace"))
                out.append({"start": chars, "end": chars + n})
                chars, last = chars + n, e
            spans.append(out)
            clean.append(b"".join([*rest, raw[last:end]]).decode("utf-8", "replace") if with_text else None)
        yield B.carried(B.batch(SCHEMA, p.part.column(0), np.diff(p.firsts), hits, found, spans, clean), p.part, carry)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its words, those inside an occurrence of a benchmark window, the
    items that occur, the merged removal spans (code points), the text without them, and the
    columns named in `carry`.

    Null texts have no words, in either table; a null item id is called "null"; repeated
    documents are searched each by itself and repeated items count once; other columns are
    ignored; empty tables give an empty result, or documents without hits.

    The benchmark is dealt, by hash and its measured size, to parts of about ITEM_BYTES of text.
    Each part is one pass: its texts are broadcast, tasks build its windows and search their shards
    for them, and the words hit so far are written with the documents for the next pass (one part,
    as benchmarks usually are, writes nothing).  So driver and tasks hold one part at a time however
    many there are; documents are never shuffled.
    """
    known = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    rows = B.text_rows(docs, id_col, text_col, carry)
    columns, kept = 2 + len(carry), "doc_id bigint, text string" + B.carried_ddl(docs, carry)

    def one_pass(part, key: str, last: bool, at: int | None):
        def give(shard):
            windows = _windows(key, part.value, window)
            return _results(shard, windows, at, with_text, carry) if last else _states(shard, windows, at, columns)

        def run(batches):
            shard, held = [], 0
            for some, block in B.blocks(batches):
                low = block.lowered()
                starts, stops, firsts = low.runs(B.ALNUM)
                shard.append(_Pending(some, block, starts, stops, firsts, low.hashes(starts, stops)))
                held += len(block.buf)
                if held >= SHARD_BYTES:
                    yield from give(shard)
                    shard, held = [], 0
            if shard:
                yield from give(shard)

        return run

    before = None
    for k in range(n):
        some = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else known
        part = docs.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in some.collect()])
        last = k == n - 1
        out = rows.mapInArrow(one_pass(part, uuid.uuid4().hex, last, columns if k else None), DDL + B.carried_ddl(docs, carry) if last else kept + STATE_DDL)
        if last:
            return out
        rows = written(out)
        part.destroy()
        if before is not None:
            forget(before)
        before = rows
