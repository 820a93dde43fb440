"""Secrets in running text: fixed shapes, and encoded keys confirmed by their structure.

A candidate run of base64 or hex is decoded and must parse before it is reported: DER
with nested lengths that add up (private keys), an OpenSSH key with its length-prefixed
fields, or a signed token whose header is JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

# The three base shapes, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("der_key", "openssh_key", "signed_token")

_LONG_HEX = re.compile(r"[0-9a-f]{16}")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]{32,})-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{44,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{80,}|[0-9A-F]{80,})(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
DDL = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


def _der(data: bytes, at: int, end: int, depth: int = 0) -> tuple[int, list] | None:
    """The end and (tag, children) items of well-formed DER in data[at:end], or None."""
    items = []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size == 0x80:
            return None
        if size > 0x80:
            n = size & 0x7F
            if n > 4 or end - at < n or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if end - at < size:
            return None
        inner = None
        if tag & 0x20:
            if (inner := _der(data, at, at + size, depth + 1)) is None:
                return None
        items.append((tag, size, inner and inner[1]))
        at += size
    return at, items


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, begins with a version 0 or 1 and goes on with
    integers (RSA), an algorithm (PKCS#8) or an octet string (EC)."""
    if len(data) < 32 or data[0] != 0x30 or (top := _der(data, 0, len(data))) is None or len(top[1]) != 1:
        return False
    inner = top[1][0][2] or []
    if len(inner) < 3 or inner[0][:2] != (0x02, 1):
        return False
    tags = [x[0] for x in inner[1:]]
    return len(inner) >= 6 and all(t == 0x02 for t in tags) or tags[0] == 0x30 and tags[1] == 0x04 or tags[0] == 0x04 and inner[1][1] >= 16


def is_openssh_key(data: bytes) -> bool:
    """The format's name, then three length-prefixed strings and a key count of 1 to 16."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if len(data) - at < 4:
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return len(data) - at >= 4 and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def _unbase64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three dotted parts: JSON header with an "alg", JSON claims, and a signature that decodes."""
    head, claims, sign = text.split(".")
    for k, piece in enumerate((head, claims)):
        raw = _unbase64(piece, url=True)
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or k == 0 and not isinstance(value.get("alg"), str):
            return False
    return _unbase64(sign, url=True) is not None


def _key_kind(data: bytes | None) -> str | None:
    return None if data is None else "der_key" if is_der_key(data) else "openssh_key" if is_openssh_key(data) else None


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base kinds, then confirmed ones; by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _LONG_HEX.search(text):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    if "-----BEGIN" in text:
        found += [(kind, *m.span(2)) for m in _PEM.finditer(text) if (kind := _key_kind(_unbase64(m[2])))]
    covered = [x[1:] for x in found if x[0] in METHOD_KINDS]
    for pattern, decode in ((_B64, _unbase64), (_HEX_KEY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if (kind := _key_kind(decode(m[0]))) and not any(a <= m.start() and m.end() <= b for a, b in covered):
                found.append((kind, *m.span()))
    if "ey" in text:
        found += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    order = {k: n for n, k in enumerate((*BASE_KINDS, *METHOD_KINDS))}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all its spans, in code points.

    Null text counts as empty and has no spans.  Repeated rows and ids are scanned each by
    itself; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for part, texts in B.rows_of_text(batches):
            yield B.batch(SCHEMA, part.column(0), [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)] for t in texts])

    return B.text_rows(docs, id_col, text_col).mapInArrow(run, DDL)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
