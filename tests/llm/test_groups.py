"""Near-duplicates, tokens and the whole pipeline against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sieveworks.llm import counts, near_dups, pieces, pii, quality, queries

INK = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string"


def shingles(text):
    words = INK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    done = set()
    for ids in at.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_near_duplicates(spark, sf_dir, tmp_path):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    top = 10**6
    for g in range(12):  # chains: neighbours alike, ends not
        text = [rng.choice(words) for _ in range(60)]
        for k in range(12):
            rows.append((top, " ".join(text)))
            top += 1
            text[rng.randrange(60)] = rng.choice(words)
    rows += [(top, ""), (top + 1, None), (top + 2, "  "), (top + 3, "one Two"), (top + 4, "One\ntwo"), (top + 5, "one two three"), (top + 6, "same " * 500), (top + 7, "same " * 300)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.op5_minhash_near_dups(spark, str(tmp_path))) == components(rows)


def test_large_buckets_are_dealt(spark, monkeypatch):
    from sieveworks.llm import shared

    monkeypatch.setattr(near_dups, "TOGETHER", 3)
    monkeypatch.setattr(shared, "HOT_LEAST", 20)
    rng = random.Random(6)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(150):  # a template with different ends: alike, but most pairs not enough
        rows.append((k, " ".join(base[: 60 - rng.randrange(25)] + [f"x{rng.randrange(40)}" for _ in range(12)])))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(60)]
    assert found(near_dups.near_duplicates(spark.createDataFrame(rows, DDL))) == components(rows)


def test_near_duplicates_at_the_threshold(spark):
    # seven words, and the same with one more: 3 of 4 shingles
    texts = [" ".join(f"p{k}x{j}" for j in range(n)) for k in range(6000) for n in (7, 8)]
    got = found(near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DDL).repartition(8)))
    assert [i for i, (_, component, _) in got.items() if component != i // 2 * 2] == []
    deviation = (0.75 * 0.25 / near_dups.PLACES) ** 0.5
    assert near_dups.SKETCH_SLACK >= 6 * deviation


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    got = near_dups.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DDL + ", component_id int")).collect()
    assert len(got) == 4 and all(r.component_id == (None if r.doc_id is None else 1) for r in got)
    assert near_dups.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    sign = near_dups.super_minhash(np.concatenate([a, b]), np.array([0, 400, 800]), 1024)
    assert abs((sign[0] == sign[1]).mean() - 0.6) < 0.06


def test_edited_counts(spark):
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=counts.PATTERN, mergeable_ranks=counts.load_ranks(), special_tokens={}).encode_ordinary
    rng = random.Random(4)
    counter = counts.TokenCounter(counts.load_ranks())
    alphabet = ["a", "bc", " ", "  ", "\n", "12", "'s", "'", "é", "!", "漢字", "the "]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        tree = counts.TokenTree.of_text(text, counter)
        assert tree.n_tokens == len(encode(text))
        for _ in range(6):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.randint(0, 12)), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_tokens == len(encode(text)) and "".join(tree.pretokens()) == text


def applied(text, edits):
    for start, end, new in edits:
        a = max(0, min(start or 0, len(text)))
        b = max(a, min(a if end is None else end, len(text)))
        text = text[:a] + (new or "") + text[b:]
    return text


def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=counts.PATTERN, mergeable_ranks=counts.load_ranks(), special_tokens={}).encode_ordinary


ODD = ["", None, " ", "\n" * 500, "a" * 30_000, "word " * 9_000, "é漢字 " * 300, "x\n \n  y"]


def test_edited_counts_query(spark, sf_dir, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    ids = [*range(len(texts) - 2), 0, None]
    spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts, strict=True)], DDL + ", leaves int").write.parquet(f"{tmp_path}/documents.parquet")
    encode, want = encoder(), []
    for i, text in zip(ids, texts, strict=True):
        text = text or ""
        n = len(text)
        after = applied(text, [(n // 4, n // 4 + 7, ""), (n // 2, n // 2, " an inserted passage, isn't it? "), (n * 3 // 4, n * 3 // 4 + 5, "12 \n")])
        want.append((i, len(encode(text)), 3, len(encode(after)), len(after)))
    rows = queries.op6_edit_aware_counts(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_reencoded < 120 and r.n_leaves_opened <= 12 for r in rows)


def test_edits_of_a_kept_table(spark):
    docs = spark.createDataFrame([(k, f"doc {k} has some words in it, " * 40) for k in range(20)], DDL)
    trees = counts.token_trees(docs)
    edits = [(3, 1, 10, 12, "XY"), (3, 0, 0, 4, None), (5, 0, None, None, "begin "), (7, 0, 10**9, 10**9, " end"), (9, 0, -5, 10**9, ""), (99, 0, 0, 1, "no such document")]
    table = spark.createDataFrame(edits, "doc_id bigint, seq int, start bigint, end bigint, text string")
    chosen = counts.with_edits(trees, table)
    done = counts.edited_trees(chosen, chosen["edits"])
    encode, texts = encoder(), {r.doc_id: r.text for r in docs.collect()}
    for i, a in {3: [(0, 4, None), (10, 12, "XY")], 5: [(None, None, "begin ")], 7: [(10**9, 10**9, " end")], 9: [(-5, 10**9, "")]}.items():
        texts[i] = applied(texts[i], a)
    got = {r.doc_id: ("".join(leaf.text for leaf in r.leaves), r.n_tokens) for r in counts.upserted_trees(trees, done).collect()}
    assert got == {i: (t, len(encode(t))) for i, t in texts.items()}
    none = counts.edited_trees(trees.limit(2), no_edits()).collect()
    assert all(r.n_edits == 0 and r.n_tokens == r.n_tokens_before and r.n_leaves_opened == 0 for r in none)
    assert counts.edited_trees(trees.limit(0), no_edits()).count() == 0 and counts.token_trees(docs.limit(0)).count() == 0


def no_edits():
    from pyspark.sql import functions as F

    return F.lit(None).cast("array<struct<start:bigint,end:bigint,text:string>>")


def best_score(word, vocabulary):
    best = [0.0]
    for end in range(1, len(word) + 1):
        options = [best[a] + vocabulary.pieces[word[a:end]][1] for a in range(max(0, end - vocabulary.longest), end) if word[a:end] in vocabulary.pieces]
        if word[end - 1] not in vocabulary.pieces:
            options.append(best[end - 1] + vocabulary.fallback)
        best.append(max(options))
    return best[-1]


def test_pieces(spark, sf_dir, tmp_path):
    vocabulary = pieces.load_vocabulary()
    score = {i: s for i, s in vocabulary.pieces.values()}
    viterbi, words = pieces.PrefixViterbi(vocabulary), set()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()[:40]] + ["", "  a  b ", "▁x ▁", "é漢\U0001f600\n\t", "x" * 500, "\x00"]
    for t in texts:
        words |= set(pieces.marked_words(t))
    for w in sorted(words):
        ids = viterbi.encode(w)
        chars = [c for c in w if c not in vocabulary.pieces]
        got = sum(score.get(i, 0) for i in ids)
        if not chars:
            assert got == pytest.approx(best_score(w, vocabulary))
    assert viterbi.steps < sum(map(len, words))
    spark.createDataFrame(list(enumerate([*texts, None])), DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r.round_trip for r in queries.op7_sentencepiece(spark, str(tmp_path)).collect())


def brute_pieces(text, vocabulary):
    """Piece ids by a plain search over each word; of equal scores, the longest last piece."""
    out = []
    for word in pieces.marked_words(text):
        best, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, begin = float("-inf"), end - 1
            for a in range(max(0, end - vocabulary.longest), end):
                if word[a:end] in vocabulary.pieces and best[a] + vocabulary.pieces[word[a:end]][1] > top:
                    top, begin = best[a] + vocabulary.pieces[word[a:end]][1], a
            if word[end - 1] not in vocabulary.pieces and best[end - 1] + vocabulary.fallback > top:
                top, begin = best[end - 1] + vocabulary.fallback, end - 1
            best.append(top)
            back.append(begin)
        own, end = [], len(word)
        while end:
            piece = word[back[end] : end]
            if piece in vocabulary.pieces:
                own.append([vocabulary.pieces[piece][0]])
            else:
                own.append([vocabulary.byte_ids[b] for b in piece.replace(pieces._OWN_MARK, pieces.MARK).encode()])
            end = back[end]
        out += [i for ids in reversed(own) for i in ids]
    return out


def test_pieces_query(spark, sf_dir, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()[:60]] + ["", None, "  a  b ", "▁x ▁", "é漢\U0001f600\n\t", "x" * 3000, "\x00", "word " * 5000]
    ids = [*range(len(texts) - 2), 0, None]
    spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], DDL + ", n_pieces int").write.parquet(f"{tmp_path}/documents.parquet")
    vocabulary, want = pieces.load_vocabulary(), []
    for i, text in zip(ids, texts, strict=True):
        found = brute_pieces(text or "", vocabulary)
        want.append((i, len(found), sum(k in vocabulary.byte_ids for k in found), hashlib.sha256(np.array(found, np.int32).tobytes()).hexdigest(), True))
    got = [(r.doc_id, r.n_pieces, r.n_byte_pieces, r.ids_sha256, r.round_trip) for r in queries.op7_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.encode_pieces(spark.createDataFrame([], DDL)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cleaned(text):
    """What the quality stage leaves of a text, or None."""
    words, rules = INK.findall(text), quality.Rules()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(set(windows)) < len(windows) else set()
    lines = text.split("\n")
    kept = [x for k, x in enumerate(lines) if not quality.line_fails(x, k == 0 and len(lines) > 1, rules)[1]]
    left = sum(len(INK.findall(x)) for x in kept)
    return "\n".join(kept) if len(words) >= 50 and 100 * len(hit) <= 50 * len(words) and 2 * left >= len(words) else None


def decontaminated(text, patterns):
    """The text without words inside a benchmark window, or None if no word is left."""
    folded = text.translate({c: c + 32 for c in range(65, 91)})
    places = [m.span() for m in WORD.finditer(folded)]
    low = [folded[a:b] for a, b in places]
    hit = set()
    for n in {len(p) for p in patterns}:
        for k in range(len(low) - n + 1):
            if tuple(low[k : k + n]) in patterns:
                hit |= set(range(k, k + n))
    if hit and len(hit) == len(places):
        return None
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : places[k][0]])
        at = places[k][1]
    return "".join([*out, text[at:]])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def stage(name, before):
        after = corpus_pipeline.shared.written(stages[name](spark, before, sf_dir))
        if name != "sentencepiece encoding":
            assert after.columns == docs.columns and after.where("n_chars <> length(text)").count() == 0, name
            others = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
            assert all((r.lang, r.source) == others[r.doc_id] for r in after.collect()), name
        return after

    one = stage("quality rules", docs)
    texts = {i: c for i, t in texts.items() if (c := cleaned(t or "")) is not None}
    assert {r.doc_id: r.text for r in one.collect()} == texts and len(texts) < docs.count()
    two = stage("near-duplicates", one)
    texts = {i: texts[i] for i, (_, _, kept) in components(list(texts.items())).items() if kept}
    assert {r.doc_id: r.text for r in two.collect()} == texts
    three = stage("benchmark decontamination", two)
    patterns = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        patterns |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9) if words else 0)}
    texts = {i: c for i, t in texts.items() if (c := decontaminated(t, patterns)) is not None}
    assert {r.doc_id: r.text for r in three.collect()} == texts
    four = stage("personal data", three)
    for r in pii.personal_data(three).collect():
        text, out, at = texts[r.doc_id], [], 0
        for s in sorted(r.spans, key=lambda s: (s.start, s.rank)):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        texts[r.doc_id] = "".join([*out, text[at:]])
    assert {r.doc_id: r.text for r in four.collect()} == texts
    assert four.where(r"text rlike '[0-9]@[a-z0-9]+[.]example|[+]1 [(][0-9]{3}[)]'").count() == 0
    five = corpus_pipeline.run(spark, sf_dir).collect()
    vocabulary = pieces.load_vocabulary()
    assert {r.doc_id: r.ids for r in five} == {i: brute_pieces(t, vocabulary) for i, t in texts.items()} and all(r.round_trip for r in five)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kept int"
    body = " ".join(f"Word{k} follows word{k + 1}." for k in range(60))
    rows = [(1, body, "en", None, 1, "x", 0), (1, body, "en", None, 1, "x", 0), (None, body, None, "s", None, None, None), (2, None, "en", "s", 0, "", 1), (3, "", "en", "s", 0, "", 1), (4, body + " extra words here.", "en", "s", 5, "", 1)]
    spark.createDataFrame([(1, None), (None, "an item of words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        ids = sorted((r.doc_id for r in got.collect()), key=str)
        want = {"quality rules": [1, 1, 4, None], "near-duplicates": [1, 2, 3, None]}.get(name, [1, 1, 2, 3, 4, None])
        assert ids == want, name


def test_repeated_ids_keep_one_row(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "en", "b", 9), (1, text, "en", "a", 9), (2, text, "en", "a", 9), (3, "other words", "en", "a", 9)]
    got = corpus_pipeline.near_dups_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    assert sorted((r.doc_id, r.source) for r in got) == [(1, "a"), (3, "a")]
