"""Repair of conversations: faults of turns, and the cheapest edits that give a legal order of roles.

A legal conversation is empty, or users and assistants by turns, a user first and an assistant last,
perhaps behind a system turn.  Rows are kept or reroled (retained) or deleted, and turns without text are
inserted.  The search runs over retained rows alone: from one to the next, the rows between cost the
difference of prefix sums of deletions, and the two roles say how many turns must be inserted.  So a
row asks, for each role before it, for the least of (cost so far - deletions so far): a running minimum
for each state.  States are the role of the last retained or inserted turn, or that there is none.

Of equally cheap edits those win whose initials (D, I, K, R) come first in ASCII order.  Deletions
stand before insertions of the same gap.  Two audits of the same rows that end in a row's edit are
never prefixes of one another, so which of two comes first is known by the order of the states that they
come from, and no audit is compared letter by letter.

Such a search over a part of a conversation is a small table: from each state at its begin to each at
its end, the cost and the order of audits.  Rows are dealt and sorted by range, so a conversation of any
size lies in several parts, each with a table; the tables are then joined in order, and each part is
written out by itself.  Only the digest of a repaired text, which goes through it in order, passes
over a long conversation's finished pieces in one task, and streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: rows and characters of a part of a conversation
PART_ROWS, PART_CHARS = 4096, 4 << 20
_KEPT_PLANS = 200_000
_NONE, _S, _U, _A = range(4)
_STATE = {"s": _S, "u": _U, "a": _A}
# turns to insert before a retained one, by the state before and its role; None: impossible
_BEFORE = {(_NONE, _S): 0, (_NONE, _U): 0, (_NONE, _A): 1, (_S, _U): 0, (_S, _A): 1, (_U, _U): 1, (_U, _A): 0, (_A, _U): 0, (_A, _A): 1}
_AT_END = (0, 2, 1, 0)
_EDITS = ("D", "IK", "IR", "K", "R")
INK = r"[^\x20\x09-\x0D]"

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STATS = [("lowest", pa.int64()), ("highest", pa.int64()), ("turns", pa.int64())] + [(c, pa.int64()) for c in _COUNTS]
#: whole: finished (signature null) or a part of a conversation that may go on; rows of both kinds come from one pass
PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), *_STATS, ("first", pa.string()), ("last", pa.string()),
    ("signature", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
PARTS_DDL = (
    "conv_id bigint, part bigint, place bigint, whole boolean, lowest bigint, highest bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "signature string, roles array<string>, texts array<string>, cost bigint, audit string, repaired_sha256 string"
)
REPORT = ("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


class Search:
    """The cheapest edits of a run of rows from one state on.

    signature: for each row x (must go) or its role's initial, o for any other; in capitals if it is truncated."""

    def __init__(self, signature: str, state: int = _NONE):
        self.signature, self.start = signature, state
        least: list[int | None] = [None] * 4  # by state: cost less the deletions of all rows so far
        least[state] = 0
        order = [0] * 4  # of the audits that lead to the states
        self.back = bytearray()  # by row and state: the state before * 8 + edit
        for i, letter in enumerate(signature):
            gone = DELETE * i
            if letter == "x":
                self.back += bytes(s * 8 for s in range(4))
                continue
            own, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
            # for each state: (cost, order of the audit before, letters, state before, edit); ties by these in turn
            best = [None if m is None else (m + gone + DELETE, order[s], "D", s, 0) for s, m in enumerate(least)]
            for role, name in ((_S, "s"), (_U, "u"), (_A, "a")):
                keeps = own == name
                if role == _S and not keeps:
                    continue
                for before in range(4):
                    if least[before] is None or (gap := _BEFORE.get((before, role))) is None:
                        continue
                    edit = (3 if keeps else 4) - 2 * gap
                    found = (least[before] + gone + INSERT * gap + (0 if keeps else REROLE) + extra, order[before], _EDITS[edit], before, edit)
                    if best[role] is None or found < best[role]:
                        best[role] = found
            self.back += bytes(255 if b is None else b[3] * 8 + b[4] for b in best)
            ranked = sorted((b[1], b[2], s) for s, b in enumerate(best) if b is not None)
            for rank, (_, _, s) in enumerate(ranked):
                order[s] = rank
            least = [None if b is None else b[0] - gone - DELETE for b in best]
        total = DELETE * len(signature)
        self.costs = [None if m is None else m + total for m in least]
        self.order = order

    def audit(self, state: int) -> str:
        """The edits that lead to this state."""
        out = []
        for i in range(len(self.signature) - 1, -1, -1):
            code = self.back[4 * i + state]
            out.append(_EDITS[code & 7])
            state = code >> 3
        return "".join(reversed(out))


def closing(costs: list[int | None], order: list[int]) -> tuple[int, int]:
    """The cheapest state to end in, and what it costs with the turns that must follow."""
    cost, _, state = min((c + INSERT * _AT_END[s], order[s], s) for s, c in enumerate(costs) if c is not None)
    return state, cost


_plans: dict[str, tuple[int, str]] = {}


def cheapest(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; those of short ones are kept."""
    if (found := _plans.get(signature)) is None:
        search = Search(signature)
        state, cost = closing(search.costs, search.order)
        found = cost, search.audit(state) + "I" * _AT_END[state]
        if len(signature) <= 64:
            if len(_plans) > _KEPT_PLANS:
                _plans.clear()
            _plans[signature] = found
    return found


def edited(signature: str, audit: str, roles: list[str], texts: list[str], state: int = _NONE) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; roles and texts are those of the rows that needn't go."""
    names, values, row, free = [], [], 0, 0
    for edit in audit:
        letter = "" if edit == "I" else signature[row]
        row += edit != "I"
        if edit == "D":
            free += letter != "x"
            continue
        if edit == "K":
            names.append(roles[free])
            state = _STATE[letter.lower()]
        else:
            state = _A if state == _U else _U
            names.append("assistant" if state == _A else "user")
        values.append("" if edit == "I" else texts[free])
        free += edit != "I"
    return names, values


def _joined(roles: list[str], texts: list[str]) -> str:
    return "\n".join([f"{r}:{t}" for r, t in zip(roles, texts, strict=True)])


class _Part:
    """Rows of a conversation as they come in order."""

    def __init__(self, conv_id: int | None, part: int, place: int):
        self.key = (conv_id, part, place)
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.codes, self.roles, self.texts, self.turns, self.rows, self.chars = [], [], [], [], 0, 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, times: int, fresh: bool, blank: bool, cut: bool) -> None:
        initial = role[:1]
        if self.rows:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.counts["illegal"] += times - 1  # copies stand side by side
        self.last = initial
        again = times
        if blank:
            self.counts["blank"] += times
        else:
            again = times - fresh
            self.counts["duplicate"] += again
            if fresh:
                self.counts["truncated"] += cut
                code = initial if initial in _STATE else "o"
                self.codes.append(code.upper() if cut else code)
                self.roles.append(role)
                self.texts.append(text)
                self.chars += len(text)
        self.codes.append("x" * again)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.rows += 1

    def row(self, whole: bool) -> tuple:
        signature = "".join(self.codes)
        stats = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        stats += (len(self.turns), *self.counts.values())
        if not whole:
            return (*self.key, False, *stats, self.first, self.last, signature, self.roles, self.texts, None, None, None)
        cost, audit = cheapest(signature)
        roles, texts = edited(signature, audit, self.roles, self.texts)
        return (*self.key, True, *stats, self.first, self.last, None, roles, texts, cost, audit, hashlib.sha256(_joined(roles, texts).encode()).hexdigest())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to finished conversations and parts of such as may go on in another task or are long."""
    part, place, now, ids, out, size = TaskContext.get().partitionId(), 0, None, 0, [], 0
    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.key[0]:
                if now is not None:
                    out.append(now.row(whole=ids > 1 and not split))
                    size += now.chars
                ids, split, place = ids + 1, False, place + 1
                now = _Part(conv_id, part, place)
            elif now.rows >= PART_ROWS or now.chars >= PART_CHARS:
                out.append(now.row(whole=False))
                size += now.chars
                split, place = True, place + 1
                now = _Part(conv_id, part, place)
            if len(out) > 10_000 or size > PART_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PARTS, strict=True)], schema=PARTS)
                out, size = [], 0
            now.add(*row)
    if now is not None:
        out.append(now.row(whole=False))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PARTS, strict=True)], schema=PARTS)


PLAN = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("closes", pa.bool_())])
PLAN_DDL = "part bigint, place bigint, enter int, leave int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, closes boolean"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a conversation in order: the states each begins and ends in; the last one has the totals."""
    now, seen, places = object(), None, []

    def finished():
        costs, order, back, totals, (lowest, highest, turns), _, _ = seen
        state, cost = closing(costs, order)
        path = [state]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        gaps = 0 if lowest is None else highest - lowest + 1 - turns
        last = len(places) - 1
        for at in range(0, len(places), 4096):
            rows = [(*places[k], path[k], path[k + 1], *((gaps, *totals, cost) if k == last else (None,) * 6), k == last) for k in range(at, min(at + 4096, last + 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PLAN, strict=True)], schema=PLAN)

    for batch in batches:
        for conv_id, part, place, signature, lowest, highest, turns, *counts, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen is None or conv_id != now:
                if seen is not None:
                    yield from finished()
                now, places = conv_id, []
                seen = ([0, None, None, None], [0] * 4, [], [0] * len(counts), (None, None, 0), None, False)
            costs, order, back, totals, (low, high, n), before, begun = seen
            step = [None] * 4
            for enter, cost in enumerate(costs):
                if cost is None:
                    continue
                search = Search(signature, enter)
                for leave, more in enumerate(search.costs):
                    if more is not None:
                        found = (cost + more, order[enter], search.order[leave], enter)
                        if step[leave] is None or found < step[leave]:
                            step[leave] = found
            ranked = sorted((f[1], f[2], s) for s, f in enumerate(step) if f is not None)
            order = [0] * 4
            for rank, (_, _, s) in enumerate(ranked):
                order[s] = rank
            back.append(bytes(255 if f is None else f[3] for f in step))
            totals = [a + b for a, b in zip(totals, counts, strict=True)]
            if begun:
                totals[3] += before + first not in ("su", "ua", "au")
            if lowest is not None:
                n += turns - (high is not None and high == lowest)
                low, high = lowest if low is None else low, highest
            places.append((part, place))
            seen = ([None if f is None else f[0] for f in step], order, back, totals, (low, high, n), last, True)
    if seen is not None:
        yield from finished()


PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("audit", pa.string()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("closes", pa.bool_())])
PIECE_DDL = "conv_id bigint, part bigint, place bigint, roles array<string>, texts array<string>, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, closes boolean"
LONG = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
LONG_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their states to their edits and the turns that remain."""
    for batch in batches:
        for conv_id, part, place, signature, roles, texts, enter, leave, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            audit = Search(signature, enter).audit(leave) + "I" * (_AT_END[leave] if rest[-1] else 0)
            row = (conv_id, part, place, *edited(signature, audit, roles, texts, enter), audit, *rest)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, PIECE, strict=True)], schema=PIECE)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished pieces in order, as a stream, to a row for each conversation."""
    digest, audit, begun = hashlib.sha256(), [], False
    for batch in batches:
        for conv_id, roles, texts, edits, *totals, closes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if roles:
                digest.update((b"\n" if begun else b"") + _joined(roles, texts).encode())
                begun = True
            audit.append(edits)
            if closes:
                row = (conv_id, *totals, "".join(audit), digest.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, LONG, strict=True)], schema=LONG)
                digest, audit, begun = hashlib.sha256(), [], False


def repaired(rows: DataFrame, ids: DataFrame | None = None, times: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): a row for each conversation, and the turns that remain.

    report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    turns has conv_id, piece, place, role, text; a conversation's turns are in order by piece and place.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text.
    times tells how often a row stands there (1), copies side by side; repeated rows are such copies.  A
    null role or text is one blank.  Rows with a null conversation are a conversation.  ids: a table
    with the ids that the report shall have, as conversations without rows; those get zeros, an empty
    audit and the digest of nothing.  Other columns are ignored; an empty table gives an empty report.
    Ids and turns must be integers.
    """
    blank = F.lit(" ")
    taken = rows.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"),
        (F.lit(1) if times is None else times).cast("bigint").alias("times"),
    ).withColumn("of", F.sha2("text", 256))
    one = written(taken.groupBy("conv_id", "turn", "role", "of", "text").agg(F.sum("times").alias("times")))
    begin = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
    firsts = one.groupBy("conv_id", "role", "of").agg(begin).select(F.col("conv_id").alias("c"), F.col("least.turn").alias("t"), F.col("role").alias("r"), F.col("of").alias("o"), F.lit(True).alias("fresh"))
    told = one.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("of") == F.col("o")), "left")
    end = F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("of")]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(
        dealt.select("conv_id", "turn", "role", "text", "times", F.coalesce("fresh", F.lit(False)).alias("fresh"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut")).mapInArrow(_parts, PARTS_DDL)
    )
    whole, cut = parts.where("whole"), parts.where("not whole")
    gaps = F.when(F.col("lowest").isNull(), 0).otherwise(F.col("highest") - F.col("lowest") + 1 - F.col("turns")).cast("bigint")
    short = whole.withColumn("gaps", gaps).select(*REPORT)
    together = ("part", "place")
    small = cut.select("conv_id", "part", "place", "signature", "lowest", "highest", "turns", *_COUNTS, "first", "last")
    plan = small.repartition("conv_id").sortWithinPartitions("conv_id", *together).mapInArrow(_planned, PLAN_DDL)
    met = cut.select("conv_id", "part", "place", "signature", "roles", "texts").join(plan, [*together])
    pieces = written(met.select("conv_id", "part", "place", "signature", "roles", "texts", "enter", "leave", "gaps", *_COUNTS, "cost", "closes").mapInArrow(_pieces, PIECE_DDL))
    long = pieces.repartition("conv_id").sortWithinPartitions("conv_id", *together).select("conv_id", "roles", "texts", "audit", "gaps", *_COUNTS, "cost", "closes").mapInArrow(_digested, LONG_DDL)
    report = short.unionByName(long)
    if ids is not None:
        every = ids.select(F.col(conv_col).cast("bigint").alias("_id")).distinct()
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *_COUNTS, "cost")]
        report = every.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
            F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
        )
    piece = F.shiftleft(F.col("part"), 33) + F.col("place")
    lines = whole.unionByName(pieces, allowMissingColumns=True).select("conv_id", piece.alias("piece"), F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "line"))
    return report, lines.select("conv_id", "piece", "place", F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))


def damaged(rows: DataFrame, modulus: int = 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, times: rows with planted faults, by the CRC-32 of `conv_id:turn`.

    Of its remainders, 0 drops a row, 1 empties its text, 2 takes the marks .!? out of it, 3 repeats it
    (times 2), 4 sets its role to user.  A null is one blank, in the key, the role and the text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kept = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, blank).alias("role"), F.coalesce(text_col, blank).alias("text"), (F.crc32(key.cast("binary")) % modulus).alias("_kind"))
    kind, text = F.col("_kind"), F.col("text")
    return kept.where("_kind <> 0").select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )
