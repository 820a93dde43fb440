"""DuckDB SQL for the rows of the corpus queries that SQL can express.

The queries named *_base take an operator's base columns alone, since what its method adds (bounded
edits, parsed keys, trained weights, line rules) is beyond SQL; the tests hold that against
brute-force versions instead.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BITS = "0000000100100011010001010110011110001001101010111100110111101111"

OP1 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
    b AS (SELECT page_id, n, array_to_string(list_transform(range(1, 41), lambda i: substr('{_BITS}', 4 * (position(substr(x, i, 1) IN '0123456789abcdef') - 1) + 1, 4)), '') AS bits FROM p),
    d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, 5 * i + 1, 1) AS int) + 8 * cast(substr(bits, 5 * i + 2, 1) AS int)
        + 4 * cast(substr(bits, 5 * i + 3, 1) AS int) + 2 * cast(substr(bits, 5 * i + 4, 1) AS int) + cast(substr(bits, 5 * i + 5, 1) AS int), 1)), '') AS payload_digest FROM b),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
    SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to, page_id % 50 = 0 AS after_gap FROM m"""

OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT cast(item_id AS varchar) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x WHERE len(w) > 0),
    p AS (SELECT DISTINCT item, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS key FROM q),
    s AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS spot, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS key FROM d JOIN (SELECT DISTINCT k FROM q) z ON len(w) >= k),
    h AS (SELECT doc_id, spot, s.k, item FROM s JOIN p ON p.k = s.k AND p.key = s.key),
    n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + k)) AS word FROM h) x GROUP BY doc_id),
    i AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP5 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS shingle FROM d WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
    r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id"""

OP10 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    s AS (SELECT doc_id, unnest(range(0, n - 99)) AS spot, unnest(list_transform(range(0, n - 99), lambda i: md5(substr(x, 2 * i + 1, 200)))) AS key FROM d WHERE n >= 100),
    again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY key ORDER BY doc_id, spot) AS k FROM s) z WHERE k > 1),
    runs AS (SELECT doc_id, min(spot) AS a, max(spot) + 100 AS b FROM (SELECT doc_id, spot, sum(new) OVER (PARTITION BY doc_id ORDER BY spot) AS run FROM (SELECT doc_id, spot, CASE WHEN spot > lag(spot, 1, -1000) OVER (PARTITION BY doc_id ORDER BY spot) + 100 THEN 1 ELSE 0 END AS new FROM again) y) z GROUP BY doc_id, run),
    cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
    g AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS k, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(x, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""


def _spans(text: str, kind: str, rank: int, pattern: str, passes: str) -> str:
    """SQL for doc_id, rank, kind, start, stop of a pattern's matches m that pass."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(gs[1 : k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : k - 1], lambda g: length(g))), 0))) AS start
        FROM (SELECT doc_id, regexp_extract_all({text}, '{quoted}') AS ms, regexp_split_to_array({text}, '{quoted}') AS gs FROM documents) x WHERE len(ms) > 0) y WHERE {passes.format(pattern=quoted)}"""


def _kinds(columns: dict[str, tuple[str, str]]) -> str:
    text = "coalesce(text, '')"
    spans = " UNION ALL ".join(_spans(text, kind, rank, *rest) for rank, (kind, rest) in enumerate(columns.items()))
    counts = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in columns)
    sums = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in columns)
    return f"""WITH s AS ({spans}), g AS (SELECT doc_id, {sums}, string_agg(concat(kind, ':', cast(start AS bigint), ':', cast(stop AS bigint)), ',' ORDER BY start, rank) AS joined FROM s GROUP BY doc_id)
    SELECT doc_id, {counts}, sha256(coalesce(joined, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN cast(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS int) ELSE (2 * cast(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS int)) // 10 + (2 * cast(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS int)) % 10 END)) % 10 = 0"
PERSONAL = _kinds({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(p AS hugeint) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
})
_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
SECRETS = _kinds({
    "assign": (rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{pattern}', 1)) >= 12"),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": (r"[0-9a-f]{16,}", "true"),  # maximal runs, as shorter ones don't count
})

_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_STANDS = " UNION ALL ".join(
    f"SELECT doc_id, spot, '{label}' AS label FROM v WHERE " + " AND ".join(f"w{k} = '{word}'" for k, word in enumerate(phrase.split())) for phrase, label in _PHRASES.items()
)
LICENSES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS spot FROM d),
    v AS (SELECT doc_id, spot, word AS w0, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY spot)), s AS ({_STANDS}),
    g AS (SELECT doc_id, count(*) AS n, min(spot) AS a, max(spot) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM s GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)"""

QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    v AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS spot, unnest(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS key FROM d WHERE len(w) > 2),
    r AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(spot, spot + 3)) AS word FROM (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, key) AS k FROM v) x WHERE k > 1) y GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
    SELECT doc_id, len(w) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""

SQL = {
    "op1_warc_salvage": OP1, "op3_benchmark_decontamination": OP3, "op5_minhash_near_dups": OP5, "op10_suffix_array_dedup": OP10, "personal_data_base": PERSONAL, "secret_scan_base": SECRETS,
    "license_scan_base": LICENSES, "quality_rules_base": QUALITY,
}
