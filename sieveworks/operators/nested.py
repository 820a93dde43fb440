"""Free-form JSON as rows, and back as canonical text: keys sorted, no blanks, at any depth.

Texts become variants, whose objects and lists are opened a level at a time; a node is a row with its path.  Texts are
put together from the deepest level up.  Numbers go through as they are written (a variant would forget that 1.0 is
no 1), so a number is text with a mark before it until it is written out again.
"""

from __future__ import annotations

import json
import sys
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import settled, stored

_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|-'
_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
_MARK, _STRING = "\x01number ", "\x01string "
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
# Keys of conclusions, which no input of an analysis may hold.
CONCLUSIONS = tuple(
    """security_classification classification_reasoning exploitable vulnerable_internal additional_callers verdict finding confirmed decision cwe_id cwe_name attack_vector vulnerabilities severity
    why_vulnerable not_a_vulnerability""".split()
)


def quoted(text: Column) -> Column:
    """A text as a JSON string, with characters beyond ASCII as they are."""
    escapes = _ESCAPES | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}
    odd = reduce(lambda made, pair: F.replace(made, F.lit(pair[0]), F.lit(pair[1])), escapes.items(), text)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), odd).otherwise(text), F.lit('"'))


def _fields(lexeme: Column) -> tuple[Column, Column, Column]:
    """Sign, digits without zeros around them, and the power of ten of the first digit, of a written number."""
    part = lambda k: F.regexp_extract(lexeme, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", k)
    every = F.concat(part(2), part(3))
    led = F.regexp_replace(every, "^0+", "")
    power = F.length(part(2)) - 1 - (F.length(every) - F.length(led)) + F.coalesce(part(4).try_cast("int"), F.lit(0))
    return part(1), F.regexp_replace(led, "0+$", ""), power


def with_number_text(rows: DataFrame, lexeme: str, out: str) -> DataFrame:
    """The rows with a number as it is written canonically: whole numbers of any size as they are, others as the shortest digits
    that give the same double, with a point from 1e-4 up to 1e16 and with an exponent elsewhere.  Null stays null.

    More than 15 digits are those of the JVM's text of the double, which before JDK 19 has one too many for some values, the
    smallest doubles among them.  Each step is a column, so that none is worked out again where it is used twice."""
    as_struct = lambda c: F.struct(*(x.alias(n) for n, x in zip(("sign", "digits", "power"), _fields(F.col(c)), strict=True)))
    near = (F.length("_a.digits") <= 15) & (F.abs("_a.power") < 300)
    staged = rows.withColumn("_a", as_struct(lexeme)).withColumn("_double", F.col(lexeme).try_cast("double")).withColumn("_plain", F.when(near, F.col(lexeme)).otherwise(F.col("_double").cast("string"))).withColumn("_b", as_struct("_plain"))
    sign, digits, power, double = F.col("_b.sign"), F.col("_b.digits"), F.col("_b.power"), F.col("_double")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    fixed = (
        F.when(power < 0, F.concat(F.lit("0."), zeros(-power - 1), digits)).when(n <= power + 1, F.concat(digits, zeros(power + 1 - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    head = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(F.lit("")))
    size = F.abs(power).cast("string")
    far = F.concat(head, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    real = F.concat(sign, F.when(digits == "", "0.0").when((power >= -4) & (power < 16), fixed).otherwise(far))
    endless = F.when(F.abs(double) == float("inf"), F.when(double < 0, "-Infinity").otherwise("Infinity"))
    whole = F.when(F.col(lexeme) == "-0", "0").otherwise(F.col(lexeme))
    return staged.withColumn(out, F.when(F.col(lexeme).rlike("^-?[0-9]+$"), whole).otherwise(F.coalesce(endless, real))).drop("_a", "_b", "_double", "_plain")


def _marked(text: Column) -> Column:
    """JSON whose numbers are strings with a mark; strings that begin like a mark get another before it."""
    own = F.lit('"\\u0001')
    one = lambda t: F.when(t.rlike(_NUMBER), F.concat(own, F.lit("number "), t, F.lit('"'))).when(t.startswith(own), F.concat(own, F.lit("string "), F.substring(t, 2, 10**9))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), one), "")


def json_nodes(rows: DataFrame, drop: tuple[str, ...] = (), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, path, kind, text): the objects, lists and values of JSON texts, of which keys in `drop` are left out at any depth.

    A path's parts are keys (after `k`) and places in lists (after `i`, of ten digits); a value's text is its canonical
    one, others have none.  Null and broken texts have no rows; so have texts with an object that repeats a key,
    unless the session takes the last of them (spark.sql.variant.allowDuplicateKeys).  Ids are unique."""
    spark = rows.sparkSession
    level = rows.select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(_marked(F.col(text_col))).alias("v")).where("v is not null")
    found = []
    while True:
        shape, raw = F.schema_of_variant("v"), F.try_variant_get("v", "$", "string")
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(raw.startswith(_MARK), "number").otherwise("string")
        told = stored(level.select("id", "path", kind.alias("kind"), raw.alias("raw"), F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.to_json("v")).alias("inner")))
        found.append(told.select("id", "path", "kind", F.when(~F.col("kind").isin("object", "list"), F.col("raw")).alias("raw")))
        inner = told.where("inner is not null").select("id", "path", F.parse_json("inner").alias("of"))
        if inner.isEmpty():
            break
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("of").outer()))
        name = _unmarked(F.col("key"), _STRING)
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("k"), name)).otherwise(F.concat(F.lit("i"), F.lpad(F.col("pos").cast("string"), 10, "0")))
        level = below.where(~F.coalesce(name.isin(*drop), F.lit(False)) if drop else F.lit(True)).select("id", F.array_append("path", step).alias("path"), F.col("value").alias("v"))
    every = reduce(DataFrame.unionAll, found)
    every = with_number_text(every.withColumn("_lexeme", F.when(F.col("kind") == "number", _unmarked(F.col("raw"), _MARK))), "_lexeme", "_number")
    text = F.when(F.col("kind") == "number", F.col("_number")).when(F.col("kind") == "string", quoted(_unmarked(F.col("raw"), _STRING))).when(F.col("kind") == "null", "null").otherwise(F.col("raw"))
    return every.select("id", "path", "kind", text.alias("text"))


def _unmarked(text: Column, mark: str) -> Column:
    return F.when(text.startswith(mark), F.substring(text, len(mark) + 1, 10**9)).otherwise(text)


def canonical(nodes: DataFrame) -> DataFrame:
    """(id, text): the canonical texts of nodes: keys in the order of their characters, `,` and `:` without blanks."""
    nodes = settled(nodes)
    depth = nodes.agg(F.max(F.size("path"))).first()[0]
    if depth is None:
        return nodes.select("id", "text")
    own = F.element_at("path", -1)
    below = None
    for d in range(depth, -1, -1):
        here = nodes.where(F.size("path") == d)
        if below is None:
            whole = here.withColumn("parts", F.array().cast("array<string>"))
        else:
            item = F.when(own.startswith("k"), F.concat(quoted(F.substring(own, 2, 10**9)), F.lit(":"), "text")).otherwise(F.col("text"))
            pairs = below.select("id", F.slice("path", 1, d).alias("path"), F.struct(own.alias("own"), item.alias("item")).alias("pair"))
            lists = pairs.groupBy("id", "path").agg(F.transform(F.array_sort(F.collect_list("pair")), lambda p: p["item"]).alias("parts"))
            whole = here.join(lists, ["id", "path"], "left")
        inner = F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("kind") == "list", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("text"))
        below = settled(whole.select("id", "path", text.alias("text")))
    return below.select("id", "text")


def _canonical_text(text: str | None, drop: frozenset[str], repeats: bool) -> str | None:
    """One JSON text in canonical form without the keys in `drop`; None if it is broken."""

    def members(pairs):
        found = dict(pairs)
        if len(found) < len(pairs) and not repeats:
            raise ValueError("a key is repeated")
        return {k: v for k, v in found.items() if k not in drop}

    def constant(name):
        raise ValueError(f"{name} is no JSON")

    try:
        made = json.dumps(json.loads(text, object_pairs_hook=members, parse_constant=constant), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, TypeError, RecursionError):
        return None
    return made.encode("utf-8", "replace").decode()


def canonical_texts(rows: DataFrame, drop: tuple[str, ...] = (), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): what `canonical` of `json_nodes` makes of JSON texts, for whole texts that no step has to open as rows: a text goes
    through alone, so nothing is shuffled or written.  Broken texts, and null ones, have a null; trailing text makes one broken."""
    keys, repeats = frozenset(drop), rows.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "true"

    def run(batches):
        sys.set_int_max_str_digits(0)  # whole numbers of any size
        for batch in batches:
            made = pa.array([_canonical_text(t, keys, repeats) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "text"])

    both = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return both.mapInArrow(run, both.schema)


def digests(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, sha256): the SHA-256 of JSON texts' canonical form; null where there is none."""
    return canonical_texts(rows, (), id_col, text_col).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def without_conclusions(rows: DataFrame, drop: tuple[str, ...] = CONCLUSIONS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): JSON texts without the keys of conclusions, at any depth, in canonical form; broken texts have no row."""
    return canonical_texts(rows, drop, id_col, text_col).where("text is not null")
