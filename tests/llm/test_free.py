"""Operators beyond SQL: against brute force, exact round trips and held-out accuracy."""

import itertools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import common, language, minhash, neighbours, packing, simple8b, token_output, tokens


@pytest.fixture(scope="session")
def plain():
    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'sS tré\n\tŐı½²9.,!<|İΣ中­"), st.characters(max_codepoint=0x24F)), max_size=20), max_size=5))
def test_tokens_equal_the_library(plain, texts):
    ids, n = tokens.encoder(tokens.default_vocabulary()).encode(pa.array(texts, pa.string()))
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at : at + k].tolist() == ids_of(plain, t)
        at += k
    assert at == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    shard = simple8b.read_shard(simple8b.write_shard([None, 3], np.array([0, len(v)]), v))
    assert (shard.ids() == v).all() and shard.doc_ids == [None, 3] and shard.lengths.tolist() == [0, len(v)]
    for k in range(len(shard.index) - 1):
        assert (shard.block(k) == v[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_token_files(spark, docs, no_docs, plain, tmp_path):
    shards = token_output.write_token_shards(docs, common.staged_path(spark, "t"), shard_ids=600)
    got = [tuple(r) for r in token_output.digests(shards).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(plain, text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert [r["ids"] for r in token_output.document_ids(shards).filter("doc_id = 6").collect()] == [[*ids_of(plain, "one two"), 1]]
    again = token_output.write_token_shards(docs, f"file://{tmp_path}/out", shard_ids=600)
    files = sorted(p.name for p in (tmp_path / "out" / "files").iterdir())
    assert len(files) == again.count() > 1 and files == sorted(r["path"].rpartition("/")[2] for r in again.collect())
    assert all(simple8b.read_shard(p.read_bytes()).lengths.sum() for p in (tmp_path / "out" / "files").iterdir())
    assert token_output.digests(token_output.write_token_shards(no_docs, common.staged_path(spark, "t"))).count() == 0


def crc_rows(texts, encode, end):
    return sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in ([*encode(t), end] for t in texts))


def test_tokens_of_long_texts_ties_and_another_vocabulary(spark, plain):
    """A text beyond a batch's limit, repeated and null doc_ids, clashing columns, and a vocabulary without the shortcut."""
    import public_tokenizers

    long = " ".join(f"word{i % 997} über{i % 13}" for i in range(180_000))
    assert len(long.encode()) > 2_500_000
    texts = [long, "One text.", "another Text", "another Text", None, "Don't  STOP", ""]
    rows = [(5, t, "p", 1, b"x") for t in texts] + [(None, t, "p", 1, b"x") for t in texts[1:]]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, part int, salt binary")
    shards = token_output.write_token_shards(df, common.staged_path(spark, "t"))
    got = token_output.digests(shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 6 + [5] * 7 and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got]).tolist()[:-1]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == crc_rows([r[1] for r in rows], lambda t: ids_of(plain, t), 1)
    pieces = packing.pack_documents(df).filter("piece = 0").select("doc_id", "length").collect()
    assert len(pieces) == len(rows) and sum(r["length"] == 2048 for r in pieces) == 1

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    assert not tokens.encoder(path).shortcut and tokens.encoder(tokens.default_vocabulary()).shortcut
    few = df.filter("length(text) < 100 OR text IS NULL")
    got = token_output.digests(token_output.write_token_shards(few, common.staged_path(spark, "t"), vocabulary=path)).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == crc_rows([r[1] for r in rows if r[1] != long], lambda t: ids_of(other, t), 1)


def check_packing(rows, lengths, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, docs, no_docs, plain):
    rows = packing.pack_documents(docs, capacity=64).collect()
    want = []
    for r in docs.collect():
        ids = [*ids_of(plain, r["text"]), 0]
        want += [(r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    key = lambda t: str(t)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    check_packing(rows, None, 64)
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_best_fit(counts, 40)
    rows = []
    for n, c in counts.items():
        s, o = plan.seats(np.full(c, n), np.arange(c))
        rows += [{"sequence_id": int(a), "offset": int(b), "length": n} for a, b in zip(s, o)]
    used = check_packing(rows, None, 40)
    bins = []  # plain best-fit decreasing, piece by piece
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(40 - n)
    assert used == len(bins)


def brute_set(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width=4):
    sets = [(d, brute_set(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets}


def test_near_duplicates(spark, docs, no_docs):
    got = minhash.near_duplicates(docs).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(no_docs).count() == 0


def test_keep_one_takes_shingles_of_five_words(spark):
    """38 of 46 shingles of four words are shared (83 %), but 36 of 46 of five words (78 %)."""
    words = [f"w{i}" for i in range(45)]
    edited = [*words[:20], "x", *words[21:]]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["component_id"] for r in minhash.near_duplicates(df).orderBy("doc_id").collect()] == [1, 1, 1]
    assert [r["doc_id"] for r in minhash.keep_one(df).orderBy("doc_id").collect()] == [1, 2]


def test_keep_one_with_repeated_and_null_ids(spark):
    """Rows that share a doc_id are judged by their texts; exact repeats count as copies; odd texts stay."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [
        (3, text("a"), "first"),
        (5, text("a"), "copy of 3"),
        (5, text("b"), "only in 5"),
        (7, text("c"), "twice"),
        (7, text("c"), "twice"),
        (9, text("d").upper(), "alike but for case"),
        (9, text("d"), "alike but for case"),
        (None, text("a"), "copy without an id"),
        (None, text("e"), "no id"),
        (None, text("e"), "no id"),
        (None, text("f"), "no id, alone"),
        (11, None, "null"),
        (11, None, "null"),
        (12, "", "empty"),
        (13, " \t", "wordless"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, digest string").repartition(3)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r["digest"] for r in kept.collect())
    assert got == sorted(["first", "only in 5", "twice", "alike but for case", "no id", "no id, alone", "null", "null", "empty", "wordless"])


def test_near_duplicates_of_long_texts(spark, monkeypatch):
    """Texts beyond the limits of a batch and of a stretch, and a text that is one long word."""
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(120_000))
    rows = [(1, long), (2, long.replace("w5 ", "x5 ")), (3, long[: len(long) // 2]), (4, "z" * 1_200_000), (5, "Z" * 1_200_000), (6, "z" * 1_200_001)]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, bands string, signature binary")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_words_do_not_depend_on_stretches(monkeypatch, limit):
    texts = pa.array(["a bb  ccc\t" * 40, "", "d" * 300 + " e", "\n", "F f é 中文 x " * 30])
    want = minhash.shingle_sets(texts)
    monkeypatch.setattr(minhash, "STRETCH", limit)
    got = minhash.shingle_sets(texts)
    assert all((x == y).all() for x, y in zip(got, want))


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Copies with chains of edits: similarities on both sides of the limit, in blocks of a few, buckets split."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SPLIT", 5)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        for i in rng.choice(120, rng.integers(0, 5), replace=False):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    rows += [(100 + d, " ".join(f"y{d}_{i}" for i in range(30))) for d in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


@pytest.mark.parametrize("same", [0.5, 0.8, 0.95])
def test_super_minhash_estimates(same):
    rng = np.random.default_rng(1)
    n, found = 300, []
    shared = int(2 * n * same / (1 + same))
    for _ in range(80):
        x = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        s = minhash.super_minhash(np.concatenate([x[:n], x[:shared], x[n:]]), np.array([n, n]))
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.02
    assert np.std(found) < 1.1 * np.sqrt(same * (1 - same) / minhash.SLOTS)


def test_super_minhash_is_a_permutation_for_one_element():
    s = minhash.super_minhash(np.array([7], np.uint64), np.array([1, 0]))
    assert sorted((s[0] >> 24).tolist()) == list(range(minhash.SLOTS)) and (s[1] == 0xFFFFFFFF).all()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    step = rng.normal(size=(3, 3))
    for lengths in ([1], [3, 2, 1], [5, 4]):
        e = rng.normal(size=(sum(lengths), 3)) * 2
        got, at = language.marginals(e, np.array(lengths), step), 0
        for n in lengths:
            p = np.zeros((n, 3))
            for y in itertools.product(range(3), repeat=n):
                w = np.exp(e[at + np.arange(n), list(y)].sum() + sum(step[a, b] for a, b in zip(y, y[1:]))) * np.exp(step[:, y[0]]).sum()
                p[np.arange(n), list(y)] += w
            assert np.allclose(got[at : at + n], p / p[0].sum())
            at += n


def test_forward_backward_across_segments():
    rng = np.random.default_rng(2)
    e, step = rng.normal(size=(300, 4)), rng.normal(size=(4, 4))
    a, up = np.full(4, 0.25), []
    for x in e:
        a = (a @ np.exp(step)) * np.exp(x)
        a /= a.sum()
        up.append(a)
    b, out = np.ones(4), []
    for x, a in zip(e[::-1], up[::-1]):
        out.append(a * b / (a * b).sum())
        b = np.exp(step) @ (np.exp(x) * b)
        b /= b.sum()
    assert np.allclose(language.marginals(e, np.array([300]), step), out[::-1])


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    stems = {"en": "the of and to wh th ing".split(), "fr": "le la que eau é oi ç".split(), "de": "der die ung sch ü pf".split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(stems[l], 2)) for _ in range(rng.integers(3, 60))) + ". 12", l) for i in range(300) for l in [("en", "fr", "de")[i % 3]]]
    rows += [(1000, None, "en"), (1001, "12 !!", "en"), (1002, "", None), (None, "the whing", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    got = language.predict(df, model).join(df.withColumn("h", language.held_out(F.col("doc_id"))), "doc_id").filter("h AND doc_id < 1000").collect()
    assert len(got) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).filter("doc_id >= 1000").collect()}
    assert odd == {1000: ("und", 0.0), 1001: ("und", 0.0), 1002: ("und", 0.0)}
    long = spark.createDataFrame([(7, " ".join(["derung schdie"] * 200_000), "x", "y"), (7, None, "x", "y"), (None, "the whing", "x", "y")], "doc_id long, text string, lang_pred string, score string")
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["n_letter_words"]) for r in language.predict(long, model).collect())
    assert got == [("7", "de", 400_000), ("7", "und", 0), ("None", "en", 2)]
    mixed = spark.createDataFrame([(1, " ".join(["thing whof theand"] * 8 + ["derung schdie"] * 8))], "doc_id long, text string")
    assert language.predict(mixed, model).first()["n_switches"] >= 1
    assert language.predict(df.limit(0), language.fit(df.limit(0))).count() == 0


def test_language_fit_is_bounded(spark, monkeypatch):
    """More languages than rows are meant for: all are learned; a long text is seen in spans from all over it."""
    monkeypatch.setattr(language, "FIT_ROWS", 30)
    monkeypatch.setattr(language, "FIT_TOTAL", 600_000)
    seen = {}
    monkeypatch.setattr(language, "train", lambda rows: seen.update(rows=rows))
    rows = [(i, f"{chr(97 + i % 40 % 26)}{chr(97 + i % 40 // 26)} " * 20, f"l{i % 40}") for i in range(400)] + [(1000 + i, " ".join(f"w{k}" for k in range(20_000)), "long") for i in range(40)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in seen["rows"]} >= {f"l{i}" for i in range(40)}
    assert sum(len(t) for t, _ in seen["rows"]) <= 600_000
    spans = [t for t, lang in seen["rows"] if lang == "long"]
    assert all(any(f"w{k}" in t.split() for k in range(10_000, 20_000)) and 500 <= len(t) < 9000 for t in spans)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24)).astype(np.float32) * rng.uniform(0.5, 2, (700, 1)).astype(np.float32)
    x[100:140] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [None] + [1.0] * 23), (2060, [float("nan")] * 24), (2080, [1.0] * 3), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    y, recall = x.astype(float), []
    for q, found in got.items():
        s = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        recall.append(len({i for i, _ in found} & set(order)) / 20)
        assert len(found) == 20 and [v for _, v in found] == [s[i] for i, _ in found]
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert np.mean(recall) >= 0.9
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 0.0]), (3, [1.0, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.nearest(huge).orderBy("rank").collect()] == [(1, float("inf")), (3, 2e200), (3, 1e200), (2, float("-inf"))]
    clash = neighbours.nearest(df.selectExpr("*", "'x' AS code", "1 AS block", "2 AS kind").filter("vec_id < 60"))
    assert clash.columns == ["query_id", "rank", "vec_id", "score"] and clash.count() == 60
    few = neighbours.nearest(df.filter("vec_id < 5")).collect()
    assert len(few) == 4 and neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_of_repeated_queries(spark):
    """Rows of one vec_id ask together, and a candidate takes one place of theirs."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 2, 3.0), (0, 2, 3.0), (0, 1, 2.0)]


def test_neighbours_recall_at_50_000_rows(spark, tmp_path):
    """Clustered vectors: the index finds the near ones and leaves most rows unscored."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(500, 32))
    x = centres[rng.integers(0, 500, 50_000)] + rng.normal(scale=0.25, size=(50_000, 32))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 32).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": lists}), tmp_path / "v.parquet")
    found = defaultdict(set)
    for r in neighbours.nearest(spark.read.parquet(f"file://{tmp_path}/v.parquet"), every=200).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = []
    for i in range(0, 50_000, 200):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(set(np.argsort(-score, kind="stable")[:20].tolist()) & found[i]) / 20)
    assert len(recall) == 250 and np.mean(recall) >= 0.9
    most = float(np.abs(x).max())
    codes = neighbours.fit_codes(x[::6] / most, most, float(np.sqrt(((x / most) ** 2).sum(axis=1).max())), len(x), 20)
    table = neighbours.SubstringIndex(codes.code(x, False), codes.bits)
    scored = np.mean([len(table.within(c, codes.radius)) for c in codes.code(x[::500], True)]) / len(x)
    assert scored < 0.2, scored


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=80), st.integers(0, 2**12 - 1), st.integers(0, 12))
def test_substring_index_is_exact(codes, query, radius):
    c = np.array(codes, np.uint64)
    want = [i for i, v in enumerate(codes) if bin(v ^ query).count("1") <= radius]
    assert neighbours.SubstringIndex(c, 12).within(np.uint64(query), radius).tolist() == want
