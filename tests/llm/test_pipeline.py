"""The pipeline's stages, each against SQL or brute force on its own input."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import common, line_templates, mixing, quality, tokens
from tests.llm.test_free import brute_components, check_packing

SOUND = "The {a} boat left the {b} harbour early, long before anyone in the {c} village was awake to see it go out.\nNobody knew where the {b} road would lead, but all of them followed the {a} one over the {c} hill anyway."


def corpus(spark, docs):
    """The odd rows of docs, and a corpus of sound documents with near copies, shared lines and templates."""
    names = [f"{x}{y}" for x in ("oak", "elm", "ash", "fir", "yew") for y in ("ton", "ham", "ley", "by")]
    rows = []
    for i in range(40):
        a, b, c = names[i % 20], names[(i * 7 + 3) % 20], names[(i * 11 + i // 20 + 5) % 20]
        extra = " ".join(f"{names[(i * k + k) % 20]}{k}" for k in range(1, 30)) + "."
        shared = "\nThis long line stands word for word in two documents of the corpus, and in no third one." if i in (8, 30) else ""
        form = f"\nThe account of {a} was opened on the first day by {b} in person." if i % 8 == 1 else ""
        rows.append((100 + i, SOUND.format(a=a, b=b, c=c).replace("\n", f" {extra}\n") + shared + form, "en", f"s{i % 3}", i))
    rows += [(200 + i, rows[i][1], "en", "s1", i) for i in range(4)]
    rows += [(300 + i, rows[i][1].replace("harbour", "port"), "en", "s2", i) for i in range(4)]
    rows += [(100, rows[9][1].upper(), "en", None, 0), (None, rows[0][1], "en", None, 0), (100, rows[0][1], "en", "s0", 7)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def brute_keep(rows):
    """Texts that near-dedup may keep: groups of row texts, of each of which one row stays."""
    numbered = [(i, r["text"]) for i, r in enumerate(rows)]
    group = defaultdict(list)
    for i, (_, c) in brute_components(numbered, 5).items():
        group[c].append(i)
    return list(group.values())


def test_stages(spark, docs, hold):
    now = common.staged(corpus(spark, docs), "corpus")
    others = [c for c in docs.columns if c != "text"]
    stage = iter(f for _, f in corpus_pipeline.STAGES)

    def step(df):
        out = common.staged(next(stage)(spark, df, ""), "stage")
        assert "piece" in out.columns or out.columns == docs.columns
        return out

    # quality rules: rows and cleaned texts as the SQL has them
    cleaned = step(now)
    one = now.withColumn("whole", F.struct(*others))
    sql = quality.verdict_sql("(SELECT whole AS doc_id, text FROM documents)")
    hold(cleaned.select(F.struct(*others).alias("whole"), "text"), f"SELECT doc_id AS whole, cleaned AS text FROM ({sql}) WHERE kept", documents=one.select("whole", "text"))
    assert 20 < cleaned.count() < now.count()

    # line dedup: the SQL's texts, without those that lost all their words
    deduped = step(cleaned)
    sql = line_templates.drop_sql(whole_docs=line_templates.LEAST_DOCS, keep_first=True)
    hold(deduped, f"SELECT * EXCLUDE (rn, n_lines, n_dropped) FROM ({sql}) WHERE n_dropped = 0 OR regexp_matches(text, '{common.WORD}')", documents=cleaned)
    assert deduped.agg(F.sum(F.length("text"))).first()[0] < cleaned.agg(F.sum(F.length("text"))).first()[0]

    # near-dedup: one row of each brute-force group, then lines that two of the rest share
    rows = deduped.collect()
    single = step(deduped)
    groups, kept = brute_keep(rows), Counter(r["doc_id"] for r in single.collect())
    grouped = [g for g in groups if len(g) > 1]
    assert grouped and sum(kept.values()) == len(groups)
    for g in groups:
        ids = [rows[i]["doc_id"] for i in g]
        assert kept[min((d for d in ids if d is not None), default=None)]
    before = common.staged(corpus_pipeline.minhash.keep_one(deduped), "one")
    hold(single, f"SELECT * EXCLUDE (rn, n_lines, n_dropped) FROM ({line_templates.drop_sql(fields=False, keep_first=True)}) WHERE n_dropped = 0 OR regexp_matches(text, '{common.WORD}')", documents=before)
    texts = [r["text"] for r in single.collect()]
    assert sum("stands word for word" in t for t in texts) == 1

    # mixing: as often as the SQL takes it
    mixed = step(single)
    hold(mixed, f"SELECT * EXCLUDE (rn2) FROM (SELECT {', '.join(docs.columns)}, unnest(range(repeats)) AS rn2 FROM ({mixing.mix_sql()}))", documents=single)

    # packing: all ids, in as few sequences as plain best-fit decreasing
    packed = step(mixed).collect()
    plain = Tokenizer.from_file(tokens.default_vocabulary())
    want, lengths = [], []
    for r in mixed.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.append((str(r["doc_id"]), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
            lengths.append(want[-1][3])
    assert sorted((str(p["doc_id"]), p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in packed) == sorted(want)
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(2048 - n)
    assert check_packing(packed, None, 2048) == len(bins)


def test_empty(spark, no_docs):
    now = no_docs
    for _, stage in corpus_pipeline.STAGES:
        now = common.staged(stage(spark, now, ""), "stage")
    assert now.count() == 0


def test_clashing_columns(spark, docs):
    """Columns named like those the stages make for themselves come through unchanged."""
    names = ["row", "kept", "hash", "digest", "size", "repeats", "target", "n_lines", "n_dropped", "cleaned", "bucket", "component_id", "part", "piece", "keys", "whole", "lines", "root", "stays"]
    now = docs.select("*", *(F.lit(f"{n}!").alias(n) for n in names))
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.staged(stage(spark, now, ""), "stage")
        assert now.columns == columns
        assert now.filter(F.concat(*names) != "".join(f"{n}!" for n in names)).count() == 0
    assert now.count()
    assert "row" not in corpus_pipeline.STAGES[-1][1](spark, now, "").columns


def test_lines_of_two_documents_go_but_not_before_near_copies(spark):
    words = lambda k: " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    passage = words("p")
    rows = [(1, f"{words('x')}\n{passage}"), (2, f"{passage}\n{words('y')}"), (3, f"{words('x')}\n{passage} edited"), (4, words("z"))]
    now = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        now = common.staged(stage(spark, now, ""), "stage")
    # 3 is a near copy of 1 and goes whole; 2 only shares a passage with 1
    assert {r["doc_id"]: r["text"] for r in now.collect()} == {1: rows[0][1], 2: words("y"), 4: rows[3][1]}
