"""Cuts of UTF-8 texts at places that no token of a vocabulary goes over.

Byte-level BPE of the kind used here first cuts a text into pre-tokens: a blank and letters, a blank
and digits, a blank and other marks, or white space.  None of them has white space behind anything
else, and what stands before a run of white space doesn't look at it, so a text may be cut before any
run of white space and the parts be encoded each by itself.  A vocabulary without pre-tokens allows
the same for a kind of white space that none of its entries holds behind something else.

Cuts are found on bytes, whole blocks of texts at a time.  Where it isn't certain that a character
is no white space, nothing is cut behind it: a missing cut never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import blocks as B

PATH = "/opt/tokenizers/"
BPE = PATH + "byte_bpe_50k.json"
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_TABLE = np.zeros(256, bool)
#: white space (and what some versions of Unicode call so) of more than one byte
_WIDE = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)}
_WIDE_CODES = np.array(sorted(int.from_bytes(w, "big") for w in _WIDE))
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII marks but the apostrophe, with which a pre-token of its own may begin
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True


def _wide_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white space of two or three bytes ends before these places."""
    two, three = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    far = at >= 2
    two[far] = buf[at[far] - 2].astype(np.int64) << 8 | buf[at[far] - 1]
    far = at >= 3
    three[far] = two[far] | buf[at[far] - 3].astype(np.int64) << 16
    return np.isin(two, _WIDE_CODES) | np.isin(three, _WIDE_CODES)


def cut_table(entries: list[bytes]) -> np.ndarray:
    """The ASCII white space before whose runs a text may be cut: none of the entries holds it behind
    what is no white space."""
    wide = tuple(_WIDE)
    unsafe = {e[k] for e in entries for k in range(1, len(e)) if _SPACE[e[k]] and not _SPACE[e[k - 1]] and not e[:k].endswith(wide)}
    table = _SPACE.copy()
    table[list(unsafe)] = False
    return table


def cuts(block: B.Block, table: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where the segments of a block's texts begin, in ascending order, texts' own beginnings among them.

    table: white space before whose runs it is cut.  marks: also between ASCII letters or digits and
    ASCII marks, which pre-tokens never join."""
    buf, n = block.buf, len(block.buf)
    if not n:
        return np.zeros(0, np.int64)
    here = np.zeros(n, bool)
    here[1:] = table[buf[1:]] & ~_SPACE[buf[:-1]]
    at = np.flatnonzero(here)
    high = at[buf[at - 1] >= 0x80]
    here[high[_wide_before(buf, high)]] = False
    if marks:
        here[1:] |= _ALNUM[buf[:-1]] & _MARKS[buf[1:]]
    begins = block.off[:-1][np.diff(block.off) > 0]
    here[begins] = True
    return np.flatnonzero(here)


def strings(block: B.Block, starts: np.ndarray) -> pa.Array:
    """The block's segments as binary strings, without a copy of their bytes."""
    off = np.append(starts, len(block.buf)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(block.buf))])


def byte_level(entries: dict[str, int]) -> dict[int, bytes]:
    """What each id of a byte-level vocabulary stands for: printable Latin-1 characters are their own
    bytes, the others in order come from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    codes = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {i: bytes(codes[c] for c in e) if all(c in codes for c in e) else e.encode() for e, i in entries.items()}


def load_bpe(path: str = BPE, plain_specials: bool = True):
    """A tokenizer of the tokenizers library; with plain_specials, special tokens' strings in texts are text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain_specials
    return made
