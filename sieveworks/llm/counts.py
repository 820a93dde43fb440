"""Edit-aware token counts.

Each document has a segment tree over its pre-tokens: leaves hold the text, lengths and token
counts of up to LEAF pre-tokens, inner nodes their sums.  The leaves are kept as a table, one row
for each document, so what has been counted once is not counted again.  An edit opens the leaves
that it touches, re-encodes their pre-tokens from a little context before it up to the first
boundary after it where the new pre-tokens meet the old ones, and the sums above the changed
leaves follow; no other leaf is read, and none is encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: characters after a boundary that the pre-tokens before it can depend on
LOOKAHEAD = 3
_CACHE = 200_000

TREE = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
    ("leaves", pa.list_(pa.struct([("text", pa.string()), ("chars", pa.int64()), ("tokens", pa.int64()), ("pretokens", pa.int32()), ("packed", pa.binary())]))),
])
TREE_DDL = "doc_id bigint, n_tokens bigint, leaves array<struct<text:string,chars:bigint,tokens:bigint,pretokens:int,packed:binary>>"
EDITED = pa.schema([*TREE, ("n_edits", pa.int64()), ("n_tokens_before", pa.int64()), ("n_pretokens", pa.int64()), ("n_reencoded", pa.int64()), ("n_leaves_opened", pa.int64()), ("n_chars_after", pa.int64())])
EDITED_DDL = f"{TREE_DDL}, n_edits bigint, n_tokens_before bigint, n_pretokens bigint, n_reencoded bigint, n_leaves_opened bigint, n_chars_after bigint"


class TokenCounter:
    """Token counts of pre-tokens, kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        if len(self.known) > _CACHE:
            self.known = {}
        known, encode = self.known, self.encode
        for p in set(pretokens).difference(known):
            known[p] = len(encode(p))
        return [known[p] for p in pretokens]


def _packed(lengths: list[int], counts: list[int]) -> bytes:
    """Lengths, then counts, in a byte each if they fit, else in four; the first bytes tell which, by their number."""
    width, kind = (1, np.uint8) if max(lengths, default=0) < 256 and max(counts, default=0) < 256 else (4, np.int32)
    return bytes([width] * width) + np.array([lengths, counts], kind).tobytes()


class Leaf:
    """Some pre-tokens: their text, and their lengths and counts, which are unpacked when they are needed."""

    __slots__ = ("text", "chars", "tokens", "pretokens", "packed", "rows")

    def __init__(self, text: str, chars: int, tokens: int, pretokens: int, packed: bytes | None, rows: tuple[list[int], list[int]] | None = None):
        self.text, self.chars, self.tokens, self.pretokens, self.packed, self.rows = text, chars, tokens, pretokens, packed, rows

    @classmethod
    def of(cls, text: str, lengths: list[int], counts: list[int]) -> Leaf:
        return cls(text, len(text), sum(counts), len(lengths), None, (lengths, counts))

    def opened(self) -> tuple[list[int], list[int]]:
        if self.rows is None:
            both = np.frombuffer(self.packed, np.uint8 if self.packed[0] == 1 else np.int32, offset=self.packed[0]).reshape(2, -1).tolist()
            self.rows = both[0], both[1]
        return self.rows

    def as_row(self) -> dict:
        return {"text": self.text, "chars": self.chars, "tokens": self.tokens, "pretokens": self.pretokens, "packed": self.packed if self.packed is not None else _packed(*self.rows)}


class TokenTree:
    """A document's leaves under a segment tree of characters, tokens and pre-tokens."""

    def __init__(self, leaves: list[Leaf], counter: TokenCounter):
        self.counter, self.reencoded, self.touched = counter, 0, set()
        self._build(leaves)

    @classmethod
    def of_text(cls, text: str, counter: TokenCounter) -> TokenTree:
        tokens = counter.pattern.findall(text)
        return cls(list(_leaves(tokens, counter.counts(tokens))), counter)

    def _build(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves or [Leaf.of("", [], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.size)
        for k, leaf in enumerate(self.leaves):
            self.sums[self.size + k] = (leaf.chars, leaf.tokens, leaf.pretokens)
        for node in range(self.size - 1, 0, -1):
            self._add(node)

    def _add(self, node: int) -> None:
        a, b = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pretokens(self) -> int:
        return self.sums[1][2]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The last leaf that begins at or before a character, and where it begins."""
        node, at = 1, 0
        while node < self.size:
            node *= 2
            left = self.sums[node][0]
            if char - at >= left and self.sums[node + 1][0]:
                at, node = at + left, node + 1
        return node - self.size, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end), moved into the text, by new ones."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, at = self._leaf_at(max(0, start - LOOKAHEAD))
        lengths, counts = self.leaves[first].opened()
        keep = skipped = 0
        while keep < len(lengths) and at + skipped + lengths[keep] <= start - LOOKAHEAD:
            skipped += lengths[keep]
            keep += 1
        # the text from the first leaf on, of as many leaves as the edit and its context need
        last, old = first, self.leaves[first].text
        grow = 1
        while True:
            while len(old) < end - at + 1 and last + 1 < len(self.leaves):
                last += 1
                old += self.leaves[last].text
            now = old[skipped : start - at] + new + old[end - at :]
            found = self._meeting(now, first, keep, skipped, last, end - at, len(new) - (end - start), start - at - skipped + len(new))
            if found:
                break
            more = min(len(self.leaves) - 1, last + grow)
            old += "".join(leaf.text for leaf in self.leaves[last + 1 : more + 1])
            last, grow = more, 2 * grow
        tokens, stop, rest = found
        self.reencoded += len(tokens)
        tail = self.leaves[stop].opened()
        self.touched.update(range(first, stop + 1))
        used = sum(map(len, tokens))
        beyond = "".join(leaf.text for leaf in self.leaves[first : stop + 1])
        tail_chars = sum(tail[0][rest:])
        text = old[:skipped] + now[:used] + (beyond[len(beyond) - tail_chars :] if tail_chars else "")
        self._put(first, stop, text, lengths[:keep] + list(map(len, tokens)) + tail[0][rest:], counts[:keep] + self.counter.counts(tokens) + tail[1][rest:])

    def _meeting(self, now: str, first: int, keep: int, skipped: int, last: int, end: int, shift: int, least: int) -> tuple[list[str], int, int] | None:
        """The new pre-tokens up to where they meet the old ones: they, the old leaf and the number of
        its pre-tokens before that place.  None if the text that is at hand doesn't reach so far."""
        whole = last == len(self.leaves) - 1
        leaf, k, old = first, keep, skipped
        tokens: list[str] = []
        for m in self.counter.pattern.finditer(now):
            if not whole and m.end() > len(now) - LOOKAHEAD:
                return None
            tokens.append(m[0])
            if m.end() < least:
                continue
            goal = skipped + m.end() - shift  # the same place in the old text, from the first leaf's begin
            while old < goal:
                rows = self.leaves[leaf].opened()[0]
                if k < len(rows):
                    old += rows[k]
                    k += 1
                elif leaf < last:
                    leaf, k = leaf + 1, 0
                else:
                    break
            if old == goal and goal >= end:
                return tokens, leaf, k
        return (tokens, len(self.leaves) - 1, len(self.leaves[-1].opened()[0])) if whole else None

    def _put(self, first: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Deals pre-tokens to the leaves first..last and updates the sums above them."""
        room = last - first + 1
        if len(lengths) > 8 * LEAF * room:  # much more than before: a new tree, from the same leaves
            self._build([*self.leaves[:first], *_cut(text, lengths, counts, LEAF), *self.leaves[last + 1 :]])
            return
        dealt = list(_cut(text, lengths, counts, max(1, -(-len(lengths) // room))))
        for k in range(room):
            leaf = dealt[k] if k < len(dealt) else Leaf.of("", [], [])
            self.leaves[first + k] = leaf
            self.sums[self.size + first + k] = (leaf.chars, leaf.tokens, leaf.pretokens)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for node in range(low, high + 1):
                self._add(node)
            low, high = low // 2, high // 2

    def pretokens(self) -> list[str]:
        """All pre-tokens, from the leaves' lengths."""
        out = []
        for leaf in self.leaves:
            at = 0
            for n in leaf.opened()[0]:
                out.append(leaf.text[at : at + n])
                at += n
        return out


def _cut(text: str, lengths: list[int], counts: list[int], share: int) -> Iterator[Leaf]:
    at = 0
    for k in range(0, len(lengths), share):
        n = sum(lengths[k : k + share])
        yield Leaf.of(text[at : at + n], lengths[k : k + share], counts[k : k + share])
        at += n


def _leaves(tokens: list[str], counts: list[int]) -> Iterator[Leaf]:
    for k in range(0, len(tokens), LEAF):
        some = tokens[k : k + LEAF]
        yield Leaf.of("".join(some), list(map(len, some)), counts[k : k + LEAF])


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _tree_columns(trees: list[TokenTree]) -> pa.Array:
    return pa.array([[leaf.as_row() for leaf in t.leaves] for t in trees], TREE.field("leaves").type)


def token_trees(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its tokens, and the leaves of its tree, to be kept as a table.

    Null text counts as empty.  Repeated rows and ids have a tree each; a null id stays null; other
    columns are ignored; an empty table gives an empty result.  The ranks are read on the driver and
    broadcast: their size is the vocabulary's.
    """
    table = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def run(batches):
        counter = TokenCounter(table.value)
        for part, texts in B.rows_of_text(batches):
            trees = [TokenTree.of_text(t, counter) for t in texts]
            yield B.batch(TREE, part.column(0), [t.n_tokens for t in trees], _tree_columns(trees))

    return B.text_rows(docs, id_col, text_col).mapInArrow(run, TREE_DDL)


def edited_trees(trees: DataFrame, edits, ranks: str = RANKS) -> DataFrame:
    """The trees (doc_id, n_tokens, leaves) after their edits, with their tokens before, and how many
    pre-tokens the edits re-encoded and how many leaves they opened.

    edits: a Column array<struct<start, end, text>> over the table, in code points of the text as it
    is by then, applied in order and moved into the text's range; null edits, or a null array, do
    nothing; a null start is 0, a null end the start, a null replacement deletes.  Repeated rows and
    null ids are edited each by itself; other columns are ignored; an empty table gives an empty
    result.  Only rows that have edits need to be passed in: `with_edits` leaves the others out.
    """
    table = trees.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def run(batches):
        counter = TokenCounter(table.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows, done = batch.slice(at, 64), [], []
                for leaves, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = TokenTree([Leaf(**leaf) for leaf in leaves or ()], counter)
                    before, todo = tree.n_tokens, [e for e in todo or () if e is not None]
                    for e in todo:
                        start = e["start"] or 0
                        tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                    done.append(tree)
                    rows.append((len(todo), before, tree.n_pretokens, tree.reencoded, len(tree.touched), tree.n_chars))
                yield B.batch(EDITED, part.column(0), [t.n_tokens for t in done], _tree_columns(done), *map(list, zip(*rows, strict=True)))

    return trees.select(F.col("doc_id").cast("bigint").alias("doc_id"), "leaves", edits.alias("edits")).mapInArrow(run, EDITED_DDL)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees that have edits in a table (doc_id, seq, start, end, text), with these as `edits`.

    Edits of one document are ordered by seq; edits without a tree, and trees without edits, are left
    out: after the edits, `upserted_trees` puts the changed trees in the place of the old ones."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("listed"))
    shaped = F.transform("listed", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text")))
    return trees.join(listed, "doc_id").withColumn("edits", shaped).drop("listed")


def upserted_trees(trees: DataFrame, changed: DataFrame) -> DataFrame:
    """The trees with the changed ones in place of those with their ids; only ids of changed ones are joined."""
    return trees.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed.select(*trees.columns))
