"""Filter audit and prefix trie against their SQL, SimHash against brute force."""

import re
import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import common, filter_audit, prefix_trie, simhash

LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"


def test_audit_equals_sql(spark, docs, no_docs, hold):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (6, 0, 0), (13, 1, None), (None, 1, 1), (99, 1, 1)], LABELS)
    got = filter_audit.audit(docs.withColumn("digest", docs["lang"]).withColumn("part", docs["lang"]).withColumn("n", docs["lang"]), labels)
    hold(got, filter_audit.ORACLE_SQL, documents=docs, labels=labels)
    assert {r["part"] for r in got.select("part").distinct().collect()} == {"", "a", "b", "c", "d"} and got.count() == 5 * 600
    assert filter_audit.audit(no_docs, labels).count() == 0
    hold(filter_audit.audit(docs, labels.limit(0)), filter_audit.ORACLE_SQL, documents=docs, labels=labels.limit(0))


def test_audit_of_copies_without_ids_and_long_texts(spark, hold):
    """Every filter fails somewhere; copies over parts, repeated and null doc_ids, a text of 3 MB."""
    good = " ".join(f"word{i}" for i in range(400))
    texts = [good, good + " #", "SHOUT " * 300, "a b c", "word " * 300, good + " x", "AB $ " * 50, None, "", "\t \n"]
    rows = [(i % 37 if i % 5 else None, texts[i % 10], f"p{i % 3}" if i % 7 else None) for i in range(300)]
    rows += [(500 + i, good, "p1") for i in range(40)] + [(7, "w " * 1_500_000, "p0"), (7, "w " * 1_500_000, "p0")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 540, 2)], LABELS)
    got = filter_audit.audit(table, labels)
    hold(got, filter_audit.ORACLE_SQL, documents=table, labels=labels)
    whole = got.groupBy("part").agg({"removed": "max", "redundant": "max", "unique_fails": "max"}).collect()
    assert len(whole) == 4 and all(r["max(removed)"] and r["max(redundant)"] for r in whole)


def test_trie_equals_sql(spark, hold, tmp_path):
    """Shared starts, families, missing and short bases, nulls, ties, repeats, clashing columns."""
    start = [("user", "hello there"), ("assistant", "hi  you\tall"), ("user", None), (None, "")]
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 19, 20, 21, 39, 61, 62, 63, 64, 65, 66, 67, 99, 140, 141]:
        for t in range(c % 7):
            role, text = start[t] if t < 4 and c % 3 else ("user", f"turn {t} of {c % 5}")
            rows.append((c, t if c % 4 else None, role, text))
    rows += rows[:4] + [(20, 0, "user", "a"), (None, 0, "user", "hello there"), (100_000, 0, "user", "x"), (2**40, 3, "user", "x"), (2**40, 3, "user", "y" * 2_000_000)]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], TURNS + ", node string, depth int")
    table.write.parquet(f"file://{tmp_path}/conversations.parquet")
    hold(prefix_trie.op12_prefix_trie(spark, f"file://{tmp_path}"), prefix_trie.ORACLE_SQL, conversations=table)


def test_trie_of_long_and_hot_conversations(spark, hold, monkeypatch):
    """One conversation of many turns, many of the same turns, a key's parts and chunks cut small."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    monkeypatch.setattr(common, "HEAVY", 6)
    rows = [(0, t, "user", f"turn {t}") for t in range(300)] + [(0, 5, "user", "turn 5")] * 3
    rows += [(c, t, "user", f"turn {t}") for c in range(1, 120) for t in range(c % 3 + 1)] + [(c, 9, "user", f"own {c}") for c in range(60, 90)]
    table = spark.createDataFrame(rows, TURNS)
    # as they stand: no conversation is rebuilt
    plain = re.sub(r"list_concat\(.*?\) AS turns", "h.turns AS turns", prefix_trie.ORACLE_SQL, count=1)
    hold(prefix_trie.conversation_trie(table), plain, conversations=table)
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0
    turns = prefix_trie.facts(prefix_trie.ordered(table))
    hold(prefix_trie.trie(*prefix_trie.rebuilt(turns)), prefix_trie.ORACLE_SQL, conversations=table)


def test_sql_knows_crc32():
    import duckdb

    ids = [0, 7, 10, 12345, 2**40, -3]
    got = duckdb.sql(f"SELECT {prefix_trie._CRC} FROM (SELECT unnest({ids}) AS conv_id)").fetchall()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) for i in ids]


def plain_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBÉ é\t\n\x0b\x1c\xa0ß"), max_size=60))
def test_fingerprint_equals_plain(text):
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_fingerprint_in_stretches(monkeypatch):
    text = " ".join(f"Word{i % 91}" for i in range(2000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_print(text)
    for n in (1, 7, 50, 5000):
        monkeypatch.setattr(simhash, "STRETCH", n)
        assert simhash.fingerprint(text.encode()) == whole and simhash.fingerprint(b"One  two") == plain_print("one two")


def plain_components(prints):
    """{(id, print)} -> smallest id, by comparing all pairs."""
    known = sorted({p for i, p in prints if i is not None})
    label = {p: p for p in known}
    for _ in known:
        before = dict(label)
        for x in known:
            for y in known:
                if (x ^ y).bit_count() <= simhash.BUDGET:
                    label[y] = min(label[x], label[y])
        if label == before:
            break
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", None if i is None else least[label[p]]) for i, p in prints), key=str)


def test_simhash_equals_brute_force(spark, docs, no_docs):
    more = spark.createDataFrame([(100 + i, f"near copy number {i % 2} of " + " ".join(f"w{k}" for k in range(300)), "z", 1) for i in range(9)] + [(None, "only here", "z", 1), (200, " \t", "z", 1), (201, "İstanbul \x1c ß", "z", 1)], "doc_id long, text string, print string, row int")
    table = docs.select("doc_id", "text").union(more.select("doc_id", "text"))
    want = plain_components([(r["doc_id"], plain_print(r["text"])) for r in table.collect()])
    for block in (1, simhash.BLOCK):
        assert sorted(map(tuple, simhash.near_duplicates(table, block=block).collect()), key=str) == want
    assert simhash.near_duplicates(more).count() == 12
    assert simhash.near_duplicates(no_docs).count() == 0


def test_trie_join_loses_no_link(spark, monkeypatch):
    """Clustered and scattered fingerprints under blocks and frontiers of several sizes."""
    rng = np.random.default_rng(3)
    prints = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 64, 60, dtype=np.uint64).tolist():
        for _ in range(6):
            for bit in rng.integers(0, 64, 3).tolist():
                base ^= 1 << bit
            prints.add(base)
    prints = sorted(prints)
    want = {(x, y) for k, x in enumerate(prints) for y in prints[k + 1 :] if (x ^ y).bit_count() <= simhash.BUDGET}
    for outright, frontier in ((1, 7), (48, 1 << 17)):
        monkeypatch.setattr(simhash, "OUTRIGHT", outright)
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        one = simhash._Trie(np.array(prints, np.uint64))
        got = [(prints[i], prints[j]) for a, b in simhash.close(one, one, 0, 0) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    wanted = {r[2] for r in plain_components([(k, p) for k, p in enumerate(prints)])}
    for block in (20, 1 << 14):
        edges = simhash.links(table, block=block)
        roots = {r["node"]: r["root"] for r in simhash.minhash.components(edges).collect()}
        groups = {}
        for k, p in enumerate(signed):
            groups.setdefault(roots.get(p, p), k)
        assert set(groups.values()) == wanted
