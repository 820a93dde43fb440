"""Repeated passages against a brute-force version, and the suffix sorter against sorting."""

import hashlib
import random

import numpy as np
import pytest

from sieveworks.llm import repeats, shared
from sieveworks.llm.suffixes import common_prefixes, suffix_order

SCHEMA = "doc_id bigint, text string"


def brute(rows, size=100):
    """Over (id, text) rows with different ids."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            piece = data[k : k + size]
            if piece in seen:
                gone[k : k + size] = b"\1" * size
            else:
                seen[piece] = (i, k)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "γ", "de", "e", "fghij", "\n", "0"]

    def make(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared, common = make(60), "x" * 40 + "common line of text" * 3
    rows = [(k, make(rng.randint(0, 120)) + common + shared[: rng.randint(0, 300)] + make(40)) for k in range(40)]
    rows += [(40 + k, rows[k][1]) for k in range(10)] + [(60, shared * 4), (61, "aa" * 400), (62, "a" * 99), (63, "a" * 100), (64, ""), (65, None)]
    return rows


@pytest.mark.parametrize("together", [4000, 3])
def test_equals_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = texts(together)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(repeats.repeated_passages(df)) == brute(rows)


def test_hot_hashes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_LEAST", 5)
    monkeypatch.setattr(shared, "HOT_PART", 1 << 40)
    monkeypatch.setattr(repeats, "TOGETHER", 3)
    rows = texts(8)
    assert found(repeats.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_keyed_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    rows = spark.createDataFrame([(k % 4 if k % 3 else 7, k) for k in range(40)] + [(None, 99)], "h bigint, v int")
    keyed = spark.createDataFrame([(0, 7, "a"), (1, 2, "b"), (7, 13, "c"), (9, 0, "d")], "h bigint, c bigint, w string")
    want = sorted(map(tuple, rows.join(keyed, "h").select("h", "v", "c", "w").collect()))
    assert sorted(map(tuple, shared.keyed_join(rows, keyed, ["h"], "c").select("h", "v", "c", "w").collect())) == want


def test_largest_id_and_clashing_columns(spark):
    top, text = (1 << 63) - 1, "one passage, said again and again, " * 6
    rows = [(top, text, 1, b"x", "p"), (None, text, 2, b"y", "q"), (5, text, 3, b"z", "r")]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string, n int, bytes binary, part string"))
    assert got.columns == [f.name for f in repeats.RESULT]
    gone = {r.doc_id: r.n_removed for r in got.collect()}
    assert gone[top] == gone[None] == len(text) and gone[5] < len(text)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(repeats.repeated_passages(df)) == brute(rows)


def test_odd_rows(spark):
    long = "some words that are said again " * 10
    rows = [(None, long), (1, long), (1, long), (2, None), (2, "")]
    got = sorted(repeats.repeated_passages(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_bytes", "n_removed").collect(), key=str)
    one = [r.n_removed for r in got if r.doc_id == 1]
    assert len(got) == 5 and one[0] == one[1] < len(long)
    assert [r.n_removed for r in got if r.doc_id is None] == [len(long)]
    assert repeats.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "t", 5, "b")], "doc_id bigint, text string, a int, bytes string")
    assert repeats.repeated_passages(clash).columns[0] == "doc_id"


def test_sorter():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 300)).astype(np.uint8)
        depth = int(rng.integers(1, 20))
        order, raw = suffix_order(text, depth), text.tobytes()
        keys = [raw[i : i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        shared = common_prefixes(text, order, depth)
        for k in range(1, len(keys)):
            assert shared[k] == next((j for j in range(depth) if keys[k][j] != keys[k - 1][j]), depth)
