"""Line-first quality rules.

Each line is judged alone (terminal punctuation, navigation, boilerplate, marks, repetition);
lines that fail are removed, and a document that loses too many of its words that way is
rejected.  Word and repetition counts of the whole text come with each verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

# Characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Phrases of page furniture, in the lower case, of the corpus's four languages.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "javascript is disabled",
    "lorem ipsum", "click here", "read more", "sign up", "log in", "subscribe to our newsletter", "share this", "follow us", "back to top", "skip to content", "powered by",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-richtlinie", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "javascript aktivieren", "hier klicken", "mehr lesen",
    "weiterlesen", "jetzt anmelden", "jetzt registrieren", "newsletter abonnieren", "folgen sie uns", "nach oben", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "activer javascript", "cliquez ici", "lire la suite",
    "en savoir plus", "se connecter", "s'inscrire", "abonnez-vous à notre newsletter", "suivez-nous", "retour en haut", "aller au contenu",
    "todos los derechos reservados", "aceptar cookies", "política de cookies", "política de privacidad", "aviso legal", "condiciones de uso", "activar javascript", "haga clic aquí", "leer más",
    "iniciar sesión", "regístrate", "suscríbete a nuestro boletín", "síguenos", "volver arriba", "saltar al contenido",
)
# Words that menus are made of, in the lower case.
MENU_WORDS = frozenset(
    "home about contact products services blog news login register search faq help support careers shop cart account sitemap archive categories tags menu next previous "
    "startseite kontakt produkte leistungen impressum anmelden suche hilfe karriere warenkorb konto übersicht weiter zurück "
    "accueil produits actualités connexion recherche aide panier compte suivant précédent "
    "inicio contacto productos servicios noticias buscar ayuda carrito cuenta siguiente anterior".split()
)
_FURNITURE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, BOILERPLATE))})(?!\w)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BARS = re.compile(r"(?<![^\x20\x09-\x0D])[|»›>•·/](?![^\x20\x09-\x0D])")
_MARKED = re.compile(r"[#*$%&|<>{}\\~^=_+]|!!")
_CLOSERS = "\"'”’»«)]}*"
_ENDS = tuple(".!?…。！？؟।")
_SENTENCE_END = re.compile(r"\w[.!?…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]+")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_lines", pa.int64()), ("n_lines_removed", pa.int64()),
    ("n_words_kept", pa.int64()), ("kept", pa.bool_()), ("clean_text", pa.string()),
])
DDL = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "n_lines bigint, n_lines_removed bigint, n_words_kept bigint, kept boolean, clean_text string"
)


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: the whole text's limits.  min_kept_percent: a document
    that keeps fewer of its words than this is rejected.

    Of lines: navigation_percent, marked_percent: one fails with more bars, or more marked words,
    among its words; menu_percent: or with as many words of menus; furniture_words: boilerplate
    phrases count in lines of at most so many words; distinct_percent: one of ten words or more
    fails with fewer different ones.  A line must end in terminal punctuation, but for closing
    quotes and brackets; exempt are a title (the first line, of at most title_words, with more
    lines after it) and prose that breaks off (a sentence end inside, and prose_words or more)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_kept_percent: int = 50
    navigation_percent: int = 25
    marked_percent: int = 40
    menu_percent: int = 50
    furniture_words: int = 30
    distinct_percent: int = 20
    title_words: int = 15
    prose_words: int = 10


def line_fails(line: str, title: bool, rules: Rules) -> tuple[int, bool]:
    """The line's words, and whether a rule removes it.  title: it may be one.  A blank line is kept."""
    words = _WORD.findall(line)
    n = len(words)
    if not n:
        return 0, False
    if "|" in line or "»" in line or "›" in line or " > " in line or "•" in line or "·" in line or " / " in line:
        if n >= 3 and 100 * len(_BARS.findall(line)) > rules.navigation_percent * n:
            return n, True
    if _MARKED.search(line) and 100 * sum(1 for w in words if _MARKED.search(w)) > rules.marked_percent * n and n >= 3:
        return n, True
    if n <= rules.furniture_words and _FURNITURE.search(line.lower()):
        return n, True
    if n >= 10 and 100 * len(set(words)) < rules.distinct_percent * n:
        return n, True
    if line.rstrip().rstrip(_CLOSERS).endswith(_ENDS):
        return n, False
    if 2 <= n <= rules.furniture_words and 100 * sum(1 for w in words if w.lower() in MENU_WORDS) >= rules.menu_percent * n:
        return n, True
    if title and n <= rules.title_words:
        return n, False
    return n, n < rules.prose_words or not _SENTENCE_END.search(line)


def _repeated_words(block: B.Block, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per document, the words that lie in a three-word window found twice or more."""
    of, n = B.owners(firsts), len(hashes)
    if n < 3:
        return np.zeros(len(block), np.int64)
    key = B.mix(hashes[:-2] + B.mix(hashes[1:-1] + B.mix(hashes[2:] + of[2:].astype(B.U64))))
    whole = of[:-2] == of[2:]
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    begins = order[twice]
    for k in range(3):
        hit[begins + k] = True
    return np.bincount(of[hit], minlength=len(block))


def _repeated_lines(block: B.Block, word_starts: np.ndarray) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    if not len(block.buf):
        return np.zeros(len(block), np.int64)
    cut = np.flatnonzero(block.buf == 10)
    starts = np.union1d(block.off[:-1], cut + 1)
    starts = starts[starts < len(block.buf)]
    stops = np.minimum(np.append(starts[1:], len(block.buf)), len(block.buf))
    stops = stops - ((stops > starts) & (block.buf[np.maximum(stops - 1, 0)] == 10))
    full = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, starts)
    starts, stops = starts[full], stops[full]
    of = np.searchsorted(block.off, starts, "right") - 1
    key = B.mix(block.hashes(starts, stops) + B.mix(of.astype(B.U64)))
    _, one = np.unique(key, return_index=True)
    return np.bincount(of, minlength=len(block)) - np.bincount(of[one], minlength=len(block))


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: counts, the lines removed, the verdict, the cleaned text, and the
    columns named in `carry`.

    Null text counts as empty: no words, base_failed, not kept.  Repeated rows are judged
    each by itself, ids may be null or repeat, other columns are ignored, an empty table
    gives an empty result.  Texts are judged whole, however long.
    """

    def run(batches):
        for part, block in B.blocks(batches):
            starts, stops, firsts = block.runs(B.INK)
            n = np.diff(firsts)
            follows = (block.buf & 0xC0) == 0x80
            seen = np.zeros(len(block.buf) + 1, np.int64)
            np.cumsum(B.INK[block.buf] & ~follows, out=seen[1:])
            chars = seen[block.off[1:]] - seen[block.off[:-1]]
            again = _repeated_words(block, block.hashes(starts, stops), firsts)
            failed = (n < rules.min_words) | (100 * again > rules.max_repeat_percent * n)
            lines, removed, left, clean = [], [], [], []
            raw = block.buf.tobytes()
            for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True):
                keep, words = [], 0
                split = raw[a:b].decode("utf-8", "replace").split("\n")
                for k, line in enumerate(split):
                    count, bad = line_fails(line, k == 0 and len(split) > 1, rules)
                    if not bad:
                        words += count
                        keep.append(line)
                lines.append(len(split))
                removed.append(len(split) - len(keep))
                left.append(words)
                clean.append("\n".join(keep) if with_text else None)
            kept = ~failed & (100 * np.array(left) >= rules.min_kept_percent * n)
            made = B.batch(SCHEMA, part.column(0), n, chars, block.count(SYMBOLS), _repeated_lines(block, starts), again, failed, lines, removed, left, kept, clean)
            yield B.carried(made, part, carry)

    return B.text_rows(docs, id_col, text_col, carry).mapInArrow(run, DDL + B.carried_ddl(docs, carry))
