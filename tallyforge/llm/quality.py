"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import GAP, WORD, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A document that loses more than this share (in percent) of its word characters is rejected.
MAX_LOST = 50
# Marks that end a sentence, or close what ends one, in the scripts that have them
# (Latin, Greek, Armenian, Hebrew, Arabic, Urdu, Devanagari, Ethiopic, Khmer, Myanmar, Tibetan, Chinese, Japanese).
TERMINAL = ".!?:;…‽։׃؟۔؛।॥፧፨።៕၊။༎。！？．：；｡\"'”’»)]}」』）】》〉›"
#: Line rules, as patterns that Java and RE2 read alike.
SEPARATOR = r"[\x20\x09-\x0D][|>»›·•/][\x20\x09-\x0D]"
SHOUT = r"[!?]{2}"
LINK = r"https?://|www\."
#: Letters of scripts that are written without spaces: two count as a word.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
# What pages say about themselves; a dot stands for an accented letter.
CUES = (
    "(use|accept|accept all) cookies", "cookie (policy|settings)", "enable javascript", "all rights reserved", "privacy policy", "terms of (use|service)", "sign up", "log in", "subscribe now", "click here", "read more", "share this", "follow us",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "anmelden", "jetzt registrieren", "mehr lesen",
    "tous droits r.serv.s", "mentions l.gales", "politique de confidentialit.", "conditions d.utilisation", "se connecter", "lire la suite",
    "todos los derechos reservados", "pol.tica de privacidad", "aviso legal", "iniciar sesi.n", "leer m.s",
    "tutti i diritti riservati", "informativa sulla privacy", "todos os direitos reservados", "termos de uso", "lorem ipsum",
)
BOILERPLATE = r"(?i)\b(" + "|".join(CUES) + r")\b|[©®]"
#: A line that stands in a document so many times is a frame, not text.
FRAME = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeat_words(words: Column) -> Column:
    """Words that stand in a WINDOW-word window found twice or more, each counted once.

    Windows are compared by a 64-bit hash. Sorting (hash, place) brings equal windows
    together, so the cost is n log n however often a window recurs.
    """
    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))

        def width(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.sort_array(F.transform(let(places, twice), lambda x: x["i"])), width)

    def joined(h: Column, apart: int) -> Column:
        """Hashes of twice as wide windows: each with the one that starts where it ends."""
        return F.transform(F.slice(h, F.lit(1), F.size(h) - apart), lambda x, i: F.xxhash64(x, F.get(h, i + apart)))

    def count(w: Column) -> Column:
        def eights(h: Column) -> Column:
            return let(joined(h, WINDOW // 2), lambda e: F.when(F.size(F.array_distinct(e)) < F.size(e), covered(e)).otherwise(F.lit(0).cast("long")))

        def fours(h: Column) -> Column:
            # a window that recurs holds WINDOW // 2 + 1 recurring windows of half its width
            return F.when(F.size(h) - F.size(F.array_distinct(h)) > WINDOW // 2, eights(h)).otherwise(F.lit(0).cast("long"))

        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h1: let(joined(h1, 1), lambda h2: let(joined(h2, 2), fours)))

    return F.when(F.size(words) >= WINDOW, count(words)).otherwise(F.lit(0).cast("long"))


def line_measures(line: Column) -> Column:
    """struct(line, words, n, chars, symbols, fails): a line by itself, each pattern counted once.

    A line without a word never fails: it holds nothing to judge. Else it fails if it is a
    fragment (under ten words, two letters of an unspaced script counting as one, and no
    terminal mark), symbols are over a twentieth of its characters, it is a menu (three
    separators, or two among eight words or fewer), it shouts, links are a third of its
    words, under a quarter of ten or more words are distinct, or 30 words or fewer hold a cue.
    """
    def measure(words: Column) -> Column:
        def judge(m: Column) -> Column:
            n, chars, symbols = m["n"], m["chars"], m["symbols"]
            last = F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
            menus, shouts = F.regexp_count(line, F.lit(SEPARATOR)), F.regexp_count(line, F.lit(SHOUT))
            fails = (
                ((n < 10) & ~F.contains(F.lit(TERMINAL), last) & (2 * n + F.regexp_count(line, F.lit(UNSPACED)) < 20))
                | (symbols * 20 > chars)
                | let(menus, lambda k: (k >= 3) | ((k == 2) & (n <= 8)))
                | let(shouts, lambda k: (k >= 3) & (k * 5 > n))
                | (F.contains(line, F.lit("://")) | F.contains(line, F.lit("www."))) & (F.regexp_count(line, F.lit(LINK)) * 3 >= n)
                | ((n >= 10) & (F.size(F.array_distinct(words)) * 4 < n))
                | ((n <= 30) & line.rlike(BOILERPLATE))
            )
            return F.struct(line.alias("line"), words.alias("words"), n.alias("n"), chars.alias("chars"), symbols.alias("symbols"), ((n > 0) & fails).alias("fails"))

        chars = F.length(F.array_join(words, "")).cast("long")
        return let(F.struct(F.size(words).cast("long").alias("n"), chars.alias("chars"), F.regexp_count(line, F.lit("[" + SYMBOLS + "]")).cast("long").alias("symbols")), judge)

    return let(words_of(line), measure)


def frames(spoken: Column) -> Column:
    """Hashes of the lines that stand FRAME times or more among spoken (hashes of a document's lines with words)."""
    return let(F.array_sort(spoken), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + (FRAME - 1)) == x, F.lit(False)))))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, then what the rules find in each row's whole text.

    cleaned: the text without failing lines, those of line_measures and those that stand
    FRAME times in the text; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words;
    lost_chars: word characters of failing lines; base_failed: under 20 words or over 30 %
    repeated words; kept: neither base_failed nor over MAX_LOST % lost.

    Null text counts as empty: no words, base_failed. Ties and repeated rows: each row is
    judged by itself. Empty table: no rows. Columns not named in keep are ignored, so
    they can't clash. A text is held once in one task, whatever its length.
    """
    def total(lines: Column, name: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x[name])

    def measure(text: Column) -> Column:
        return let(F.transform(F.split(text, "\n", -1), line_measures), of_lines)

    def of_lines(lines: Column) -> Column:
        spoken = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: F.xxhash64(x["line"]))
        return let(spoken, lambda s: with_doubles(lines, s, (F.size(s) - F.size(F.array_distinct(s))).cast("long")))

    def with_doubles(lines: Column, spoken: Column, doubles: Column) -> Column:
        framing = F.when(doubles >= FRAME - 1, frames(spoken)).otherwise(F.array().cast("array<long>"))

        def cleaned(frame: Column) -> Column:
            out = lambda x: x["fails"] | ((x["n"] > 0) & (F.size(frame) > 0) & F.array_contains(frame, F.xxhash64(x["line"])))
            return let(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), out(x).alias("out"))), verdict)

        def verdict(marked: Column) -> Column:
            kept_lines = F.transform(F.filter(marked, lambda x: ~x["out"]), lambda x: x["line"])
            lost = total(F.filter(marked, lambda x: x["out"]), "chars")
            words = F.flatten(F.transform(lines, lambda x: x["words"]))
            found = F.struct(total(lines, "n").alias("n"), total(lines, "chars").alias("chars"), let(words, repeat_words).alias("repeated"), lost.alias("lost"))

            def last(m: Column) -> Column:
                failed = (m["n"] < 20) | (100 * m["repeated"] > 30 * m["n"])
                return F.struct(
                    F.array_join(kept_lines, "\n").alias("cleaned"),
                    m["n"].alias("n_words"),
                    m["chars"].alias("word_chars"),
                    total(lines, "symbols").alias("n_symbols"),
                    doubles.alias("n_dup_lines"),
                    m["repeated"].alias("n_repeat_words"),
                    m["lost"].alias("lost_chars"),
                    failed.alias("base_failed"),
                    (~failed & (100 * m["lost"] <= MAX_LOST * m["chars"])).alias("kept"),
                )

            return let(found, last)

        return let(framing, cleaned)

    # A generator is computed once; a projected struct would be computed anew for each use.
    return docs.select(*keep, F.inline(F.transform(F.array(F.coalesce(F.col("text").cast("string"), F.lit(""))), measure)))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of docs with cleaned text; other columns as they are, whatever their names.

    Null, empty and very short texts are rejected (base_failed). Each row is judged by
    itself, so repeated rows and doc_ids fare alike. No rows: none out.
    """
    others = [c for c in docs.columns if c != "text"]
    found = judged(docs.select(F.struct(*others).alias("row"), "text"), "row").filter("kept")
    return found.select(*((F.col("cleaned") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GAP_SQL = r"[\x20\x09-\x0D]+"


def verdict_sql(documents: str = "documents") -> str:
    """DuckDB SQL of judged(): one row for each document, with a row number rn."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM {documents}),
    s AS (SELECT *, list_filter(string_split_regex(text, '{_GAP_SQL}'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS lines FROM d),
    wds AS (SELECT rn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
    win AS (SELECT rn, i, {" || ' ' || ".join(["x"] + [f"lead(x, {k}) OVER o" for k in range(1, WINDOW)])} AS g FROM wds WINDOW o AS (PARTITION BY rn ORDER BY i)),
    named AS (SELECT * FROM win WHERE g IS NOT NULL),
    twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM named) WHERE c > 1),
    rep AS (SELECT rn, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM twice) GROUP BY rn),
    li AS (SELECT rn, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM s),
    lw AS (SELECT *, list_filter(string_split_regex(line, '{_GAP_SQL}'), lambda x: x <> '') AS w, length(regexp_replace(line, '{_GAP_SQL}', '', 'g')) AS chars FROM li),
    lr AS (SELECT *, count(*) OVER (PARTITION BY rn, line) AS times FROM lw),
    lp AS (SELECT *, len(w) = 0 OR NOT (
        (len(w) < 10 AND NOT contains('{TERMINAL.replace("'", "''")}', right(rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) AND 2 * len(w) + len(regexp_extract_all(line, '{UNSPACED}')) < 20)
        OR len(regexp_extract_all(line, '[{SYMBOLS}]')) * 20 > chars
        OR len(regexp_extract_all(line, '{SEPARATOR}')) >= 3 OR (len(regexp_extract_all(line, '{SEPARATOR}')) = 2 AND len(w) <= 8)
        OR (len(regexp_extract_all(line, '{SHOUT}')) >= 3 AND len(regexp_extract_all(line, '{SHOUT}')) * 5 > len(w))
        OR (len(regexp_extract_all(line, '{LINK}')) > 0 AND len(regexp_extract_all(line, '{LINK}')) * 3 >= len(w))
        OR (len(w) >= 10 AND len(list_distinct(w)) * 4 < len(w))
        OR (len(w) <= 30 AND regexp_matches(line, '{BOILERPLATE}'))
        OR times >= {FRAME}) AS passes FROM lr),
    pl AS (SELECT rn, sum(CASE WHEN passes THEN 0 ELSE chars END)::BIGINT AS lost, count(CASE WHEN len(w) > 0 THEN 1 END) - count(DISTINCT CASE WHEN len(w) > 0 THEN line END) AS dup, string_agg(CASE WHEN passes THEN line END, chr(10) ORDER BY k) AS cleaned FROM lp GROUP BY rn),
    m AS (SELECT s.rn, doc_id, coalesce(cleaned, '') AS cleaned, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_GAP_SQL}', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, lost FROM s JOIN pl USING (rn) LEFT JOIN rep USING (rn))
    SELECT rn, doc_id, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= {MAX_LOST} * word_chars AS kept, lost FROM m
    """


ORACLE_SQL = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({verdict_sql()})"
