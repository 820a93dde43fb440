"""The merged findings that several queries show, and the oracles' own statement of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stages
from .derived import Tables

# The oracle's own statement of the merge and of the states.
_KEY_OF = "coalesce(nullif(unit_id, ''), nullif(finding_id, ''))"
_LAST = "SELECT *, min(pos) OVER (PARTITION BY key) AS at FROM (SELECT {k} AS key, * FROM {t}) x WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1"
_MERGED = f"""WITH a AS ({_LAST.format(k=_KEY_OF, t="{found1}")}), b AS ({_LAST.format(k=_KEY_OF, t="{found2}")}), d AS ({_LAST.format(k=_KEY_OF, t="{found3}")}),
    df AS (SELECT * FROM {{found3}} WHERE finding_id <> '' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY pos DESC) = 1),
    l AS (SELECT * FROM a WHERE decision IN ('candidate', 'inconclusive', 'error')),
    one AS (SELECT l.key, 0 AS section, l.at AS pos, l.finding_id AS f1, b.finding_id AS f2, l.decision AS d1, b.decision AS d2, b.execution_state AS e2, coalesce(d.decision, df.decision) AS dd, coalesce(d.execution_state, df.execution_state) AS ed, l.file, l.function, l.cited AS c1, b.cited AS c2, coalesce(d.cited, df.cited) AS c3
        FROM l LEFT JOIN b ON b.key = l.key LEFT JOIN d ON d.key = l.key LEFT JOIN df ON d.key IS NULL AND df.finding_id = b.finding_id),
    two AS (SELECT b.key, 1, b.at, a.finding_id, b.finding_id, a.decision, b.decision, b.execution_state, d.decision, d.execution_state, a.file, a.function, a.cited, b.cited, d.cited
        FROM b LEFT JOIN a ON a.key = b.key LEFT JOIN d ON d.key = b.key WHERE b.key NOT IN (SELECT key FROM l)),
    m AS (SELECT * FROM one UNION ALL SELECT * FROM two)
    SELECT key AS unit_id, section, pos, coalesce(nullif(f2, ''), nullif(f1, ''), key) AS finding_id, d1, d2, e2, dd, ed,
    CASE WHEN file <> '' THEN file WHEN position(':' IN key) > 0 THEN regexp_extract(key, '^(.*):([^:]*)$', 1) ELSE '' END AS file, CASE WHEN file <> '' THEN function WHEN position(':' IN key) > 0 THEN regexp_extract(key, '^(.*):([^:]*)$', 2) ELSE coalesce(function, '') END AS function,
    list_concat(coalesce(string_split(c1, ','), []), coalesce(string_split(c2, ','), []), coalesce(string_split(c3, ','), [])) AS cited FROM m"""
_STATES = f"""SELECT *, CASE WHEN d1 = 'error' OR e2 = 'failed' OR ed = 'failed' THEN 'error' WHEN dd = 'reproduced' AND ed = 'succeeded' THEN 'reproduced'
    WHEN d2 = 'rejected' AND e2 = 'succeeded' THEN 'rejected' WHEN d2 = 'confirmed' AND e2 = 'succeeded' AND dd = 'not_reproduced' AND ed = 'succeeded' THEN 'confirmed_not_reproduced'
    WHEN d2 = 'confirmed' AND e2 = 'succeeded' AND (ed IS NULL OR ed IN ('skipped', 'blocked')) THEN 'confirmed_not_dynamically_tested' WHEN d2 = 'confirmed' AND e2 = 'succeeded' AND dd = 'inconclusive' THEN 'inconclusive'
    WHEN d1 = 'candidate' AND d2 IS NULL THEN 'candidate' WHEN d1 = 'inconclusive' OR d2 = 'inconclusive' OR dd = 'inconclusive' THEN 'inconclusive' WHEN d1 = 'candidate' THEN 'candidate' ELSE 'inconclusive' END AS final_state
    FROM ({_MERGED}) m"""
_ORDER = "CASE final_state WHEN 'reproduced' THEN 1 WHEN 'confirmed_not_dynamically_tested' THEN 2 WHEN 'confirmed_not_reproduced' THEN 3 WHEN 'candidate' THEN 4 WHEN 'rejected' THEN 5 WHEN 'inconclusive' THEN 6 ELSE 7 END"
FOUND_STATES, FOUND_ORDER = _STATES, _ORDER


def found(t: Tables, name: str) -> DataFrame:
    return t[name].withColumn("evidence_ids", F.split("cited", ","))


def merged_findings(t: Tables, cited: bool = True) -> DataFrame:
    """cited: with the evidence that they cite; without it the records go through the merge without their lists."""
    of = (lambda name: found(t, name)) if cited else t.__getitem__
    return stages.merged(of("found1"), of("found2"), of("found3"))
