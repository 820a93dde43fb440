"""SentencePiece encoding by a shared-prefix Viterbi search, and decoding.

A text is cut into marked words (blanks as U+2581, then the word).  The distinct words of a
block are sorted, which is a depth-first walk through their trie; the forward scores of a
prefix that two words share are computed once.

The public model holds merge ranks and no log-probabilities; a piece of rank r gets the
score -ln(r + 2), as under Zipf's law.  A character without a piece becomes its UTF-8 bytes'
pieces, at ten below the lowest score.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: a U+2581 of the text itself, which must not turn into a blank; no valid text holds it
_OWN_MARK = "\udc81"
_WORD = re.compile(r" *[^ ]+| +")
_CACHE_WORDS = 400_000

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_sha256", pa.string()),
    ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32())),
])
DDL = "doc_id bigint, n_words bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean, ids array<int>"


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    longest: int
    fallback: float  # score of a character that has no piece

    def bytes_of(self) -> dict[int, bytes]:
        """What each id decodes to."""
        table = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        return table | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece goes over a word's begin: {piece!r}")
            pieces[piece] = (i, -math.log(2 - model.get_score(i)))
    return Vocabulary(pieces, tuple(byte_ids), max(map(len, pieces)), min(s for _, s in pieces.values()) - 10)


class Node:
    """A place in the trie of pieces."""

    __slots__ = ("next", "score")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.score: float | None = None


def piece_trie(vocabulary: Vocabulary) -> Node:
    root = Node()
    for piece, (_, score) in vocabulary.pieces.items():
        node = root
        for char in piece:
            node = node.next.setdefault(char, Node())
        node.score = score
    return root


class PrefixViterbi:
    """Encodes sorted words; keeps the forward scores along the current trie path.

    best and back: for each position of the word, the score and where the last piece begins.
    reach: the pieces that are under way there, as (begin, trie node).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.root = vocabulary, piece_trie(vocabulary)
        self.word = ""
        self.best, self.back, self.reach = [0.0], [0], [[]]
        self.steps = 0  # positions that were computed, not reused

    def encode(self, word: str) -> list[int]:
        """The best segmentation; of equal ones, that whose last piece is longest, from the end on."""
        old, best, back, reach = self.word, self.best, self.back, self.reach
        k, most = 0, min(len(old), len(word))
        while k < most and old[k] == word[k]:
            k += 1
        del best[k + 1 :], back[k + 1 :], reach[k + 1 :]
        pieces, root, fallback = self.v.pieces, self.root, self.v.fallback
        under_way = reach[k]
        for at in range(k, len(word)):
            char, going, top, begin = word[at], [], -math.inf, at
            for start, node in (*under_way, (at, root)):
                if (node := node.next.get(char)) is not None:
                    going.append((start, node))
                    if node.score is not None and (score := best[start] + node.score) > top:
                        top, begin = score, start
            if char not in root.next or root.next[char].score is None:
                if best[at] + fallback > top:
                    top, begin = best[at] + fallback, at
            best.append(top)
            back.append(begin)
            reach.append(going)
            under_way = going
        self.word, self.steps = word, self.steps + len(word) - k
        out, end = [], len(word)
        while end:
            start = back[end]
            if (found := pieces.get(word[start:end])) is not None:
                out.append(found[0])
            else:
                char = MARK if word[start] == _OWN_MARK else word[start]
                out += [self.v.byte_ids[b] for b in reversed(char.encode("utf-8", "replace"))]
            end = start
        out.reverse()
        return out


def marked_words(text: str) -> list[str]:
    """The text's words with marks for blanks and one before the text; they join to the whole."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, _OWN_MARK)
    return [w.replace(" ", MARK) for w in _WORD.findall(" " + text)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.table = vocabulary.bytes_of()
        self.is_byte = np.zeros(max(self.table) + 1, bool)
        self.is_byte[list(vocabulary.byte_ids)] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Each text's words and piece ids.  Words met before are kept, up to a bound."""
        split = [marked_words(t) for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known = {}
        known, search = self.known, PrefixViterbi(self.v)
        for word in sorted({w for words in split for w in words}.difference(known)):
            known[word] = np.array(search.encode(word), np.int32).tobytes()
        return [(len(words), np.frombuffer(b"".join([known[w] for w in words]), np.int32)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids, without the blank that encoding puts before it."""
        raw = b"".join([self.table[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: its piece ids, their digest, and whether they decode to the text.

    Null and empty texts have no pieces.  Repeated rows and ids are encoded each by itself;
    other columns are ignored; an empty table gives an empty result.  Texts are encoded
    whole.  The model is read on the driver and broadcast: its size is the vocabulary's.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for part, texts in B.rows_of_text(batches):
            found = encoder.encode(texts)
            ids = [i for _, i in found]
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=off[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat)) if with_ids else pa.nulls(len(ids), pa.list_(pa.int32()))
            same = [encoder.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield B.batch(SCHEMA, part.column(0), [n for n, _ in found], [len(i) for i in ids], [int(encoder.is_byte[i].sum()) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids], same, lists)

    return B.text_rows(docs, id_col, text_col).mapInArrow(run, DDL)
