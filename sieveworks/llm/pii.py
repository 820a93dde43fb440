"""Personal data by weak supervision, in DataFrame functions alone.

Fixed shapes (base kinds) are reported as they are.  Looser candidates are judged: labelers
(strict shape, gazetteer, context before, context against, edges) vote for, against or not at
all; expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data.  A logistic span classifier is then
trained towards those likelihoods on features of its own, which no labeler sees: length, share of
digits, separators, the characters on both sides and the word before.  Its weights become one
column expression that judges every candidate.

A text is split by a pattern and matched by it; pieces and matches in turn give the places.
Running sums and greatest values over a text's matches are taken in chunks, so that a text with
very many of them costs no more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# The base shapes.  Starts that lie inside a run of the first class, and so can
# only fail as the run's begin does, are skipped; \G is the end of the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(BASE)
# Shapes of candidates that are judged.
LOOSE = {
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "id_number": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9./-])",
    "long_number": r"(?<![0-9A-Za-z+.-])[0-9]{9,19}(?![0-9A-Za-z.-])",
}
KINDS = (*BASE, *LOOSE)
# Gazetteers and context words, lower case.
DOMAINS = r"\.(com|org|net|edu|gov|io|de|fr|es|uk|it|nl|eu|info)$"
GIVEN_NAMES = r"(?i)\b(anna|maria|peter|john|james|mary|robert|linda|michael|david|thomas|hans|klaus|marie|jean|pierre|carlos|jose|juan|carmen|laura|paul|sophie|lucas|emma)\b"
COUNTRY_CODES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|3[457]|6)"
IBAN_COUNTRIES = r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
RESERVED_IPS = r"^(0|10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168|2(2[4-9]|[34][0-9]|5[0-5]))\."
CONTEXT_FOR = (
    r"\b(e-?mail|mail|contact|kontakt|correo|courriel|call|phone|tel|telefon|tél|mobile|fax|card|visa|credit|karte|carte|tarjeta|ip|host|login|address|born|birth|geboren|né|née|"
    r"nacido|ssn|social security|passport|account|konto|compte|cuenta|iban|name|signed|dear|patient)\b[^.!?\n]*$"
)
CONTEXT_AGAINST = r"\b(version|release|isbn|issn|order|invoice|model|serial|section|page|figure|table|sku|item|part no|build|commit|revision|article|chapter)\b[^.!?\n]*$"
LABELERS = ("shape", "gazetteer", "context", "against", "edges")
CONTEXT = 40
#: what a text must hold for a shape to be searched for: cheap tests that leave most patterns out for most texts
_NEEDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "email_words": r"[\[(]at[\])]", "phone_local": r"[0-9]{3}[.-][0-9]{4}",
    "id_number": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}", "date": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "long_number": r"[0-9]{9}",
}
#: classes of the classifier's features: length, share of digits, separator, character before, character after, word before
FEATURES = (4, 5, 5, 5, 4, 16)
_CHUNK = 256


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item, op over those before it; the list is copied for each, so it must be short."""
    start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(items, start, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each int of an array that isn't empty, op over those before it (zero for the first).

    Chunks are scanned each by itself, and their totals among themselves."""
    z = F.lit(zero)
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda k: F.slice(v, k * _CHUNK + 1, _CHUNK))
    bases = lambda parts: _scan(F.transform(parts, lambda p: F.aggregate(p, z, op)), op, z)
    return _let(values, lambda v: _let(chunks(v), lambda parts: F.flatten(F.zip_with(parts, bases(parts), lambda p, base: F.transform(_scan(p, op, z), lambda x: op(base, x))))))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else found


def _spans(shape: Column) -> Column:
    """(kind, start, end, b0, b1, found, before, after) of each match of a shape (kind, matches, parts of the
    text between them), in code points and in bytes."""
    add = lambda a, b: a + b
    matches, parts = shape["matches"], shape["parts"]
    n = F.size(matches)
    pairs = F.zip_with(
        F.zip_with(F.slice(parts, 1, n), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("found"))), F.slice(parts, 2, n), lambda p, after: F.struct(p["gap"].alias("gap"), p["found"].alias("found"), after.alias("next"))
    )

    def with_places(pairs):
        chars = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["found"])), add, 0)
        octets = running(F.transform(pairs, lambda p: F.octet_length(p["gap"]) + F.octet_length(p["found"])), add, 0)
        return F.zip_with(F.zip_with(pairs, chars, lambda p, at: F.struct(p.alias("p"), at.alias("at"))), octets, lambda q, b: span(q["p"], q["at"], b))

    def span(p, at, b):
        start, first = at + F.length(p["gap"]), b + F.octet_length(p["gap"])
        return F.struct(
            shape["kind"].alias("kind"), start.alias("start"), (start + F.length(p["found"])).alias("end"), first.alias("b0"), (first + F.octet_length(p["found"])).alias("b1"), p["found"].alias("found"),
            F.substring(p["gap"], -CONTEXT, CONTEXT).alias("before"), F.substring(p["next"], 1, 1).alias("after"),
        )

    return _let(pairs, with_places)


def _by_kind(kind: Column, cases: dict[str, Column], default: Column) -> Column:
    """The case of a span's kind; the others are not computed."""
    out = F.when(F.lit(False), default)
    for k, value in cases.items():
        out = out.when(kind == KINDS.index(k), value)
    return out.otherwise(default)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i):
        v = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(s: Column) -> Column:
    """Whether a match counts; those of loose shapes always do."""
    found, digits = s["found"], _digits(s["found"])
    plain = lambda p: F.ltrim(p, F.lit("0"))
    part_fits = lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(F.nullif(plain(p), F.lit("")), F.lit("0")).try_cast("int") <= 255)
    cases = {
        "ip": F.forall(F.split(found, r"\."), part_fits), "card": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False), "phone": F.length(digits).between(9, 15),
    }
    return _by_kind(s["kind"], cases, F.lit(True))


def _vote(for_: Column, against: Column = None) -> Column:
    out = F.when(for_, 1)
    return (out.when(against, -1) if against is not None else out).otherwise(0)


def _shape(kind: Column, found: Column) -> Column:
    digits = _digits(found)
    strict = {
        "email_words": _vote(found.rlike(r"dot[\])] ?[A-Za-z]{2,6}$")),
        "phone_local": _vote(found.rlike(r"^(\([2-9]|[2-9])"), found.rlike(r"^\(?[01]")),
        "id_number": _vote(~found.rlike(r"^(000|666|9)|-00-|-0000$"), found.rlike(r"^(000|666|9)|-00-|-0000$")),
        "iban": _vote(F.length(F.translate(found, " ", "")).between(15, 34)),
        "person": _vote(found.rlike(r"\p{Ll} \p{Lu}\p{Ll}+$")),
        "date": _vote(found.rlike(r"(^|[./-])(19[2-9]|200|201)[0-9]"), F.lit(True)),
        "long_number": _vote(F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False), F.lit(True)),
    }
    return _by_kind(kind, strict, F.lit(1))


def _gazetteer(kind: Column, found: Column) -> Column:
    listed = {
        "email": _vote(found.rlike(DOMAINS)),
        "ip": _vote(~found.rlike(RESERVED_IPS), F.lit(True)),
        "card": _vote(found.rlike(CARD_PREFIXES), F.lit(True)),
        "phone": _vote(found.rlike(COUNTRY_CODES), F.lit(True)),
        "email_words": _vote(found.rlike(r"(com|org|net|edu|de|fr|es|uk|it)$")),
        "iban": _vote(found.rlike(IBAN_COUNTRIES), F.lit(True)),
        "person": _vote(found.rlike(GIVEN_NAMES)),
        "long_number": _vote(F.lit(False), ~found.rlike(CARD_PREFIXES)),
    }
    return _by_kind(kind, listed, F.lit(0))


def _features(s: Column) -> Column:
    """The classes of FEATURES, by position."""
    n, digits = F.length(s["found"]), F.length(_digits(s["found"]))
    mark, left, right = F.regexp_extract(s["found"], r"([^0-9\p{L}])", 1), F.right(s["before"], F.lit(1)), s["after"]
    word = F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))
    return F.array(
        F.when(n < 9, 0).when(n < 13, 1).when(n < 20, 2).otherwise(3),
        F.floor(4 * digits / n).cast("int"),
        F.when(mark == "", 0).when(mark == " ", 1).when(mark == ".", 2).when(mark == "-", 3).otherwise(4),
        F.when(left.isin("", "\n"), 0).when(left == " ", 1).when(left.isin(":", "=", "#"), 2).when(left.isin("(", "[", "<", '"', "'"), 3).otherwise(4),
        F.when(right.isin("", "\n"), 0).when(right == " ", 1).when(right.isin(*".,;:!?)]>"), 2).otherwise(3),
        F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(FEATURES[-1] - 1)).cast("int")),
    )


def _judged(s: Column) -> Column:
    """The span with its votes and its features."""
    before, kind = F.lower(s["before"]), s["kind"]
    glued = s["after"].rlike(r"[\p{L}\p{N}_]") | s["before"].rlike(r"[\p{L}\p{N}_]$")
    votes = F.array(_shape(kind, s["found"]), _gazetteer(kind, s["found"]), _vote(before.rlike(CONTEXT_FOR)), _vote(F.lit(False), before.rlike(CONTEXT_AGAINST)), _vote(F.lit(False), glued))
    return F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "b0", "b1")), votes.alias("votes"), _features(s).alias("features"))


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that meet no base span: by start, none before may end behind a span's start, and
    the next one must not start before its end."""
    far = (1 << 31) - 1
    one = lambda mark: lambda s: F.struct(s["start"].alias("start"), F.lit(mark).alias("loose"), s.alias("span"))

    def sweep(all_):
        ends = running(F.transform(all_, lambda e: F.when(e["loose"] == 0, e["span"]["end"]).otherwise(-1)), _most, -1)
        starts = F.reverse(running(F.reverse(F.transform(all_, lambda e: F.when(e["loose"] == 0, e["start"]).otherwise(far))), _least, far))
        rows = F.zip_with(F.zip_with(all_, ends, lambda e, a: F.struct(e.alias("e"), a.alias("before"))), starts, lambda r, b: F.struct(r["e"].alias("e"), r["before"].alias("before"), b.alias("next")))
        free = F.filter(rows, lambda r: (r["e"]["loose"] == 1) & (r["before"] <= r["e"]["start"]) & (r["next"] >= r["e"]["span"]["end"]))
        return F.transform(free, lambda r: r["e"]["span"])

    return F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(_let(F.array_sort(F.concat(F.transform(base, one(0)), F.transform(loose, one(1)))), sweep))


def candidates(docs: DataFrame, row: Column, text_col: str = "text") -> DataFrame:
    """(row, base, loose): the spans of every text, with votes and features; loose ones that meet base ones are left out."""
    out = docs.select(row.alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shapes = BASE | LOOSE
    out = out.select("row", "text", *(_matches(F.col("text"), k, p).alias(f"m_{k}") for k, p in shapes.items()))
    found = [F.when(F.size(f"m_{k}") > 0, F.struct(F.lit(n).alias("kind"), F.col(f"m_{k}").alias("matches"), F.split("text", p, -1).alias("parts"))) for n, (k, p) in enumerate(shapes.items())]
    out = out.select("row", F.array_compact(F.array(*found)).alias("shapes"))
    spans = F.filter(F.flatten(F.transform("shapes", _spans)), _passes)
    out = out.select("row", _let(F.transform(spans, _judged), lambda all_: F.struct(F.filter(all_, lambda s: s["kind"] < len(BASE)).alias("base"), F.filter(all_, lambda s: s["kind"] >= len(BASE)).alias("loose"))).alias("s"))
    return out.select("row", "s.base", _apart(F.col("s.base"), F.col("s.loose")).alias("loose"))


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 50, smooth: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their shares of all spans.

    Gives each pattern's probability to be true, the labelers' chances of each vote given
    false and true (class, labeler, vote), and the share of true ones.  It starts from the
    balance of votes, which also decides which class is which.  Only shares count, so it is the
    same for a table and for the table twice."""
    weight = weight / max(weight.sum(), 1)
    truth = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.05, 0.95)
    table, share = np.full((2, votes.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        for c, mass in enumerate((weight * (1 - truth), weight * truth)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((votes == v) * mass[:, None]).sum(0) + smooth
            table[c] /= table[c].sum(1, keepdims=True)
        share = float(np.clip((weight * truth).sum(), 0.01, 0.99))
        logs = [np.log(table[c, np.arange(votes.shape[1]), votes + 1]).sum(1) for c in (0, 1)]
        truth = 1 / (1 + np.exp(np.clip(np.log(1 - share) - np.log(share) + logs[0] - logs[1], -50, 50)))
    return truth, table, share


def design(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A column for each kind and each class of each feature, and a constant one."""
    columns = [np.ones(len(kind))] + [kind == k for k in range(len(KINDS))]
    columns += [features[:, j] == c for j, n in enumerate(FEATURES) for c in range(n)]
    return np.stack(columns, 1).astype(float)


def fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 25) -> np.ndarray:
    """Logistic regression towards soft targets, by damped Newton steps; the weights' sum is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def train(found: DataFrame) -> np.ndarray:
    """The span classifier's weights, from all candidates of all documents.

    The driver gets counts by vote pattern (3^5 at most), for expectation-maximisation, and by
    kind and feature classes (11 * 32,000 at most), each with its mean likelihood: both are
    bounded by the labelers and features, however many documents there are."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    code = F.aggregate("s.votes", F.lit(0), lambda acc, v: acc * 3 + v + 1)
    seen = spans.groupBy(code.alias("code")).agg(F.first("s.votes").alias("votes"), F.count("*").alias("n")).orderBy("code").collect()
    if not seen:
        return np.zeros(1 + len(KINDS) + sum(FEATURES))
    truth, _, _ = reliabilities(np.array([r.votes for r in seen]), np.array([r.n for r in seen], float))
    likely = F.element_at(F.create_map(*(F.lit(x) for r, t in zip(seen, truth, strict=True) for x in (r.code, float(round(t, 9))))), code)
    rows = spans.groupBy("s.kind", "s.features").agg(F.count("*").alias("n"), F.avg(likely.cast("decimal(10,9)")).cast("double").alias("truth")).orderBy("kind", "features").collect()
    kind, features, n, target = (np.array([r[k] for r in rows]) for k in range(4))
    return fit(design(kind, features), target, n / n.sum())


def _score(weights: np.ndarray, s: Column) -> Column:
    """The classifier's log-odds of a span."""
    w = [float(x) for x in weights]
    pick = lambda a, n, k: F.get(F.array(*map(F.lit, w[a : a + n])), k)
    at = 1 + len(KINDS)
    score = F.lit(w[0]) + pick(1, len(KINDS), s["kind"])
    for j, n in enumerate(FEATURES):
        score += pick(at, n, F.get(s["features"], F.lit(j)))
        at += n
    return score


def _judged_spans(weights: np.ndarray) -> Column:
    """Base spans and the loose ones that the classifier accepts, by start, then kind."""

    def named(s, base):
        score = F.lit(None).cast("double") if base else _score(weights, s)
        places = [s[c].alias(c) for c in ("end", "b0", "b1")]
        return F.struct(s["start"].alias("start"), s["kind"].alias("rank"), *places, F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), F.lit(base).alias("base"), score.alias("score"))

    loose = F.filter(F.transform("loose", lambda s: named(s, False)), lambda s: s["score"] > 0)
    return F.array_sort(F.concat(F.transform("base", lambda s: named(s, True)), loose))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `spans`, an array of (start, rank, end, b0, b1, kind, base, score) by start, then kind.

    Starts and ends are in code points, b0 and b1 in bytes, ends exclusive; score is null for base
    spans.  Null text counts as empty.  The id is passed on as it is, of any type.  Repeated rows
    and ids are judged each by itself, but all rows count in training; other columns are ignored; an
    empty table gives an empty result.
    """
    found = written(candidates(docs, F.col(id_col), text_col))
    return found.select(F.col("row").alias("doc_id"), _judged_spans(train(found)).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with [KIND] in place of each span.

    Of spans that meet, the text of all is replaced by the first one's name.  Null text stays
    null.  Repeated rows are masked each by itself, but all count in training; columns of any
    name are passed on; an empty table gives an empty result.  The texts are searched once, and
    written with their candidates; nothing is shuffled but counts.
    """
    found = written(candidates(docs, F.struct(*(docs[c] for c in docs.columns)), text_col))
    text = F.col(f"row.`{text_col}`")

    def cut(data, spans):
        ends = running(F.transform(spans, lambda s: s["b1"]), _most, 0)
        heads = F.filter(F.zip_with(spans, ends, lambda s, e: F.struct(s.alias("s"), e.alias("from"))), lambda h: h["s"]["b0"] >= h["from"])
        piece = lambda a, n: F.substring(data, a + 1, n).cast("string")
        pieces = F.transform(heads, lambda h: F.concat(piece(h["from"], h["s"]["b0"] - h["from"]), F.lit("["), F.upper(h["s"]["kind"]), F.lit("]")))
        last = F.array_max(F.transform(spans, lambda s: s["b1"]))
        return F.concat(F.array_join(pieces, ""), piece(last, F.length(data)))

    judged = found.select("row", _judged_spans(train(found)).alias("spans"))
    clean = F.when(text.isNotNull() & (F.size("spans") > 0), _let(text.cast("string").cast("binary"), lambda data: _let(F.col("spans"), lambda spans: cut(data, spans)))).otherwise(text)
    return judged.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
