"""Personal data against Python's own matching, and what training adds."""

import hashlib
import re
import time

import numpy as np

from sieveworks.llm import pii, queries

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def counts(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(SHAPES.items()) for m in re.finditer(p, text or "") if counts(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def check(rows, got):
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(brute(text))
    for r in got:
        assert r.base_sha256 in [hashlib.sha256(w.encode()).hexdigest() for w in want[r.doc_id]], r
        assert r.n_email + r.n_ip + r.n_card + r.n_phone in [w.count(":") // 2 for w in want[r.doc_id]]
    assert len(got) == len(rows)


TEXTS = [
    "a@b.c_d@e.f x..@y.z.w@q.r 1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 99999999999999999999.1.1.1",
    "é ñ 😀 write to jo%e+x@mail-1.example.com. or +1 (017) 555-7713, +49 30-1234567) 4111 1111 1111 1111",
    "4111-1111-1111-1111 4111 1111 1111 1112 5 55 4111111111111111 4111111111111111",
    "", None, "@", "+", "+1 2", "1.1.1", "a@b", "x@y." + "z." * 3000 + "q", "1" * 5000, "1 " * 4000, "+1" + "(" * 4000 + "2", "a" * 100_000,
    "Contact Dr. Anna Schmidt, phone 212-555-0188, born 1984-03-12; jo [at] mail [dot] com. Version 123-45-6789",
]


def table(spark, sf_dir, tmp_path, rows, ddl="doc_id bigint, text string"):
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op2_personal_data(spark, str(tmp_path)).collect()


def test_base_spans_equal_brute_force(spark, sf_dir, tmp_path):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[1])]
    check(rows, table(spark, sf_dir, tmp_path, rows))


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op2_personal_data(spark, sf_dir).collect())


def test_training_adds_spans_and_leaves_others(spark):
    rows = [(k, f"Contact us, phone 212-555-01{k:02d} or mail jo{k}@mail.com today.") for k in range(40)]
    rows += [(100 + k, f"see version 013-55-01{k:02d}x and order 123456789012 of page 3") for k in range(20)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == ["phone_local", "email"] for k in range(40))
    assert not any(got[100 + k] for k in range(20))


def test_estimation_finds_the_reliable_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.8, 0.55)], 1)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    _, table, share = pii.reliabilities(patterns, weight)
    assert table[1, 0, 2] > 0.85 and table[1, 0, 2] > table[1, 1, 2] > table[1, 2, 2] and abs(share - 0.4) < 0.06


def test_running_values(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "_CHUNK", 4)
    rng = np.random.default_rng(2)
    lists = [rng.integers(-50, 50, n).tolist() for n in (1, 3, 4, 5, 16, 17, 100)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    got = df.select("v", pii.running(F.col("v"), lambda a, b: a + b, 0).alias("s"), pii.running(F.col("v"), pii._most, -99).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[:k]) for k in range(len(r.v))] and r.m == [max([-99, *r.v[:k]]) for k in range(len(r.v))]


def test_loose_spans_that_meet_base_ones_are_left_out(spark):
    # the long number is a card, the local number lies in the phone number; the last ones stand alone
    rows = [(1, "4111111111111111 and +1 212-555-0188 then 212-555-0188; x@y.de 1984-03-12" + " é" * 300 + " 212-555-0189")]
    spans = pii.candidates(spark.createDataFrame(rows, "doc_id bigint, text string"), pii.F.lit(1)).first()
    text = rows[0][1]
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in sorted(spans.loose, key=lambda s: s.start)] == [("phone_local", "212-555-0188"), ("date", "1984-03-12"), ("phone_local", "212-555-0189")]
    assert all(text.encode()[s.b0 : s.b1].decode() == text[s.start : s.end] for s in (*spans.base, *spans.loose))


def test_a_text_of_many_matches_takes_seconds(spark):
    text = " ".join(f"é mail user{k}@host{k}.example or 212-555-{k % 10000:04d} now" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    row = pii.masked(docs).first()
    assert row.text.count("[EMAIL]") == 100_000 and time.time() - began < 60


def test_training_does_not_depend_on_size(spark):
    rows = [(k, f"phone 212-555-01{k:02d} or mail jo{k}@mail.com, order 123456789{k:03d} of 2001-02-0{k % 9 + 1}") for k in range(60)]
    found = [pii.candidates(spark.createDataFrame(rows * n, "doc_id bigint, text string"), pii.F.col("doc_id")) for n in (1, 7)]
    assert np.allclose(pii.train(found[0]), pii.train(found[1]), atol=1e-6)


def test_clashing_columns_and_other_ids(spark):
    rows = [("a", "x@y.de", 1, "b", 2), ("a", "x@y.de", 1, "b", 2), (None, None, 3, None, 4)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id string, text string, spans int, row string, base int")).collect()
    assert sorted(((r.doc_id, [s.kind for s in r.spans]) for r in got), key=str) == [("a", ["email"]), ("a", ["email"]), (None, [])]
    same = pii.masked(spark.createDataFrame(rows, "doc_id string, text string, spans int, row string, base int"))
    assert sorted(map(tuple, same.collect()), key=str) == sorted([("a", "[EMAIL]", 1, "b", 2)] * 2 + [(None, None, 3, None, 4)], key=str)
    assert pii.masked(same.limit(0)).count() == 0


def test_masking_and_empty(spark):
    rows = [(1, "mail a@b.com now", 3), (2, "nothing", 4), (3, None, 5), (1, "1.2.3.4", 6), (None, "a@b.co +1 (017) 555-7713.", 7)]
    got = pii.masked(spark.createDataFrame(rows, "doc_id bigint, text string, base int")).collect()
    want = {(1, "mail [EMAIL] now", 3), (2, "nothing", 4), (3, None, 5), (1, "[IP]", 6), (None, "[EMAIL] [PHONE].", 7)}
    assert {tuple(r) for r in got} == want
    assert pii.personal_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
