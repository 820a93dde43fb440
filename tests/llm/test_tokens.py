"""Tokenizer alignment and token files against whole-text encoding, one document at a time."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from sieveworks.llm import alignment as A
from sieveworks.llm import queries, shared
from sieveworks.llm import segments as S
from sieveworks.llm import token_files as T

ODD = [
    None, "", " ", "\n", "a<|endoftext|>b c <s> </s> <unk>", "é  x", "　 a", "don't, stop.It's 'sx x86,(y) a\n\n b\t c \r\n\r\n x\r\ny", "\x1c d", " \n", "x'sé,", " " * 50 + "a", "日本、 語。 😀", "the ▁ the", "\n\nfoo bar\n baz",
    "<0x41> the\x00 the", "a\xa0 \xa0b", "x" * 5000, "​ x​ y ᠎ z  w", "same words here, same words here", "same words here, same words here", "'s 're' s", "a ▁", "▁▁ b", "1,000.5e-3 a_b-c",
]


def brute_alignment(docs):
    """doc_id -> columns of op11, by the libraries on whole texts."""
    a_model, b_model = Tokenizer.from_file(S.BPE), sentencepiece.SentencePieceProcessor(model_file=A.PIECES)
    a_model.encode_special_tokens = True
    names = {i: e for e, i in a_model.get_vocab().items()}
    table = S.byte_level(a_model.get_vocab())

    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        raw = f" {text or ''}".encode()
        if b"".join(table[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            found.append((doc_id, None))
            continue
        assert all(i in names for i in a)
        ends, at = {}, 0
        for k, i in enumerate(a):
            at += len(table[i])
            ends[at] = k
        at, last_a, last_b, groups, links = 0, 0, 0, [], []
        for k, i in enumerate(b):
            at += len(b_bytes(i))
            if at in ends:
                stop = ends[at] + 1
                groups.append(",".join(map(str, a[last_a:stop])) + "|" + ",".join(map(str, b[last_b : k + 1])))
                links.append((a[stop - 1], i))
                last_a, last_b = stop, k + 1
        counts.update(links)
        found.append((doc_id, (len(a), len(b), groups, links)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for doc_id, one in found:
        if one is None:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = one
            rows.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def by_text(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1:]))


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """Documents of the smallest size with odd ones, a repeated row, a null id, and columns with clashing names."""
    path = tmp_path_factory.mktemp("tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD)] + [(10**6, "twice here"), (10**6 + 50, "twice here"), (10**6 + 50, "twice here"), (None, "no id")], docs.schema)
    docs.unionByName(odd).selectExpr("doc_id", "text", "'x' AS segment", "1 AS roll", "2 AS block", "3 AS start").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("most", [A.MOST_PAIRS, 0])
def test_alignment_equals_whole_texts(spark, folder, monkeypatch, most):
    """With the pairs' counts broadcast, and met by a shuffle."""
    monkeypatch.setattr(A, "MOST_PAIRS", most)
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op11_tokenizer_alignment(spark, folder).collect()]
    assert by_text(got) == by_text(brute_alignment(rows_of(spark, folder)))
    assert sum(r[-1] == "" for r in got) >= 4


def test_a_single_blank_ends_a_text(spark, tmp_path):
    """Its last segment is that blank alone."""
    texts = ["the end ", "a ", "x, \n", "two  ", "é ", "\t ", "日本 ", "b ▁ ", "same end ", "same end "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()]
    assert by_text(got) == by_text(brute_alignment(list(enumerate(texts)))) and sum(r[-1] == "" for r in got) == 1


def test_groups_join_to_the_texts(spark, folder):
    pair = A.pair_of(S.BPE, A.PIECES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in A.align_tokens(docs).collect():
        for side, table in ((0, pair.a_bytes), (1, pair.b_bytes)):
            assert b"".join(table[int(i)] for g in r.groups.split(";") for i in g.split("|")[side].split(",")).decode() == " " + texts[r.doc_id]


def test_cuts_need_proof():
    """White space that an entry holds behind a letter is no place to cut."""
    table = S.cut_table([b"a", b" b", b"\t ", b"x\r", b"\xc2\xa0 "])
    assert table[0x20] and table[0x09] and not table[0x0D]
    assert not S.cut_table([b"a b"])[0x20]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.align_tokens(empty).collect() == []
    path = shared.folder(spark)
    T.write_token_files(empty, path)
    assert T.read_token_files(spark, path).collect() == []


def test_token_files_equal_whole_texts(spark, folder):
    model = Tokenizer.from_file(S.BPE)
    docs = sorted(rows_of(spark, folder), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {r: [*model.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in docs}
    got = queries.op13_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs] and [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    want = Counter((i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t in docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_files_are_read_by_document(spark, folder, tmp_path):
    """Only asked documents' frames, over many files; any zstandard reader can read a file through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    T.write_token_files(docs, f"file://{tmp_path}/t", file_bytes=10_000)
    every = T.read_token_files(spark, f"file://{tmp_path}/t").collect()
    assert len(every) == docs.count() and T.token_files(spark, f"file://{tmp_path}/t").count() > 3
    asked = spark.createDataFrame([(3,), (3,), (60,), (10**6 + 50,), (None,), (10**9,)], "doc_id bigint")
    some = T.read_token_files(spark, f"file://{tmp_path}/t", asked).collect()
    assert sorted(tuple(r) for r in some) == sorted(tuple(r) for r in every if r.doc_id in (3, 60, 10**6 + 50)) and len(some) == 4
    raw = next((tmp_path / "t").rglob("part-*")).read_bytes()
    found = T.FileReader(memoryview(raw))
    through = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)
    assert through == b"".join(found.ids(k).astype("<u4" if w == 4 else "<u2").tobytes() for k, w in enumerate(found.widths.tolist()))


def test_damage_is_found():
    out = T.FileWriter(0, 0, 3)
    for k, ids in enumerate(([1, 2, 3], [70_000, 1], [])):
        out.add(k or None, np.array(ids, "<u4"))
    raw = out.closed() + T.SEEKABLE.to_bytes(4, "little")
    found = T.FileReader(memoryview(raw))
    assert [found.ids(k).tolist() for k in range(3)] == [[1, 2, 3], [70_000, 1], []] and found.known.tolist() == [False, True, True]
    caught = 0
    for at in range(int(found.ends[0])):
        broken = bytearray(raw)
        broken[at] ^= 0x10
        try:
            assert T.FileReader(memoryview(bytes(broken))).ids(0).tolist() == [1, 2, 3]  # a bit of the header that says nothing
        except T.DamagedFile:
            caught += 1
        assert T.FileReader(memoryview(bytes(broken))).ids(1).tolist() == [70_000, 1]
    assert caught > int(found.ends[0]) // 2
    for cut in (1, 5, 9, 30):
        with pytest.raises(T.DamagedFile):
            T.FileReader(memoryview(raw[:-cut]))
