"""Two-stage suffix sorting of byte texts, to a fixed depth, and adjacent common prefixes.

Suffixes that are smaller than their successors are sorted directly; the others are induced
by scanning the buckets of first bytes from the least on: a scanned suffix puts the one that
begins a byte before it, if that byte is larger (or equal, within the same bucket's induced
part), at the end of the induced part of its byte's bucket.  After Itoh and Tanaka, "An
Efficient Method for in Memory Construction of Suffix Arrays" (1999).
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't."""
    out = np.zeros(len(text), bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    if len(change):
        out[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1))
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes (shorter ones count as padded by 0)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = np.flatnonzero(smaller_than_next(text))
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    prefixes = np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(prefixes, kind="stable")]
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        row, front = [], np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(front):
            row.append(front)
            front = front[front > 0] - 1
            front = front[text[front] == c]
        row.append(direct[cuts[c] : cuts[c + 1]])
        scanned = np.concatenate(row)
        if not len(scanned):
            continue
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            by_byte = np.argsort(first, kind="stable")
            before, first = before[by_byte], first[by_byte]
            edges = np.flatnonzero(np.diff(first)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(first)], strict=True):
                induced[first[a]].append(before[a:b])
    return np.concatenate(out)


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at each place, and up to `depth` beyond the end, as one number."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    size = len(text) + depth + 8
    out = np.zeros(size, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + size]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, the bytes it has in common with the one before, up to `depth`."""
    out = np.zeros(len(order), np.int64)
    words = words_at(text, depth)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(live):
            break
        differ = words[order[live] + at] ^ words[order[live - 1] + at]
        same = differ == 0
        ends, bits = live[~same], differ[~same]
        out[ends] = at
        for k in range(1, 8):
            out[ends] += (bits >> np.uint64(64 - 8 * k)) == 0
        live = live[same]
        out[live] = at + 8
    return np.minimum(out, depth)
