"""Text, name and amount functions. Column in, Column out; nothing leaves the JVM.

Patterns carry (?U) where words and white space are meant as in Unicode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import vocab

MISSING = ("", "NA", "N/A", "NAN", "NULL", "NONE")


def column_name(raw: str) -> str:
    """Lower, trimmed, white space, dashes and slashes to single underscores."""
    return re.sub("_+", "_", re.sub(r"[ \-/]", "_", raw.strip().lower()))


def safe_string(c: Column) -> Column:
    """Trimmed; empty or NA: null."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", F.when(~F.upper(t).isin("NA", "N/A", "NAN"), t))


def currency(c: Column) -> Column:
    """Decimal of an amount with $ and commas; what is no number: null."""
    return F.regexp_replace(F.trim(c.cast("string")), "[$,]", "").try_cast("decimal(18,2)")


def slugify(c: Column) -> Column:
    """P5."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_budget_item(c: Column) -> Column:
    """Alias in its own case, canonical name, slug, else unchanged (trimmed); blank: null."""
    t = F.trim(c)
    return F.when(t != "", F.coalesce(vocab.by_alias(t), F.when(t.isin(*vocab.BUDGET_ITEMS), t), vocab.by_slug(slugify(t)), t))


def file_budget_item(name: Column) -> Column:
    """By the exact slug of the name without its extension."""
    return vocab.by_slug(slugify(F.regexp_replace(name, r"\.[^.]*$", "")))


def normalize_name(c: Column) -> Column:
    """White space collapsed, punctuation dropped, lower-cased, trimmed; null: empty."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")
    return F.trim(F.lower(kept))


def name_tokens(c: Column) -> Column:
    """P10: distinct tokens in order."""
    return F.array_distinct(F.filter(F.split(normalize_name(c), " +"), lambda t: t != ""))


def person(full: Column, first: Column, last: Column) -> Column:
    """P11."""
    return F.struct(normalize_name(full).alias("full_name"), normalize_name(first).alias("first_name"), normalize_name(last).alias("last_name"))


def first_name_variants(c: Column) -> Column:
    """P12: 'A (B)' gives A and B; null or empty: none."""
    nick = F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))
    base = F.trim(F.regexp_replace(c, r"\s*\([^)]+\)\s*", " "))
    both = F.filter(F.array(base, nick), lambda x: x != "")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>"))
        .when(~c.rlike(r"\([^)]+\)") | (F.size(both) == 0), F.array(F.trim(c)))
        .otherwise(both)
    )


def amount_terms(amount: Column) -> Column:
    """The spellings of an amount that a page may show."""
    plain, grouped = amount.cast("string"), F.format_number(amount, 2)
    return F.array(plain, F.concat(F.lit("$"), plain), grouped, F.concat(F.lit("$"), grouped))


def search_terms(first: Column, last: Column, amount: Column) -> Column:
    """First-name variants, last name, 'first last' phrases, amount spellings."""
    variants = first_name_variants(first)
    surname = F.filter(F.array(F.trim(last)), lambda x: x.isNotNull() & (x != ""))
    phrases = F.transform(F.filter(variants, lambda v: F.size(surname) > 0), lambda v: F.concat_ws(" ", v, surname[0]))
    amounts = F.when(amount.isNotNull() & (amount != 0), amount_terms(amount)).otherwise(F.array().cast("array<string>"))
    return F.concat(variants, surname, phrases, amounts)


def table_text(c: Column) -> Column:
    """Lower, only a-z, 0-9 and white space, collapsed, trimmed."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def salvage_json(c: Column) -> Column:
    """The JSON text in an answer: code fence stripped, from the first opener to its last closer; else null."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    curly, square = F.instr(body, "{"), F.instr(body, "[")
    as_object = (curly > 0) & ((square == 0) | (curly < square))
    found = F.when(as_object, F.regexp_extract(body, r"(?s)\{.*\}", 0)).when(square > 0, F.regexp_extract(body, r"(?s)\[.*\]", 0))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def context_keywords(context: Column, budget_item: Column, limit: int = 10) -> Column:
    """Letter-first tokens of two characters or more, without stop words and the budget item's words, distinct in order."""
    budget = F.split(F.regexp_replace(F.lower(F.coalesce(budget_item, F.lit(""))), r"[&\-/]", " "), r"\s+")
    stop = F.array(*map(F.lit, vocab.STOP_WORDS))
    words = F.filter(text_words(context), lambda w: ~F.array_contains(stop, w) & ~F.array_contains(budget, w))
    return F.slice(F.array_distinct(words), 1, limit)


def text_words(c: Column) -> Column:
    """Letter-first tokens with & and - dropped, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"[&\-]", ""), F.lit("[a-zA-Z][a-zA-Z0-9]+"), F.lit(0)), F.lower)


def token_set(texts: Column) -> Column:
    """Distinct tokens of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), text_words)))


def is_generic(text: Column, budget_item: Column, slug: Column) -> Column:
    """P20: the text says no more than the budget item's name."""
    t, b = F.lower(F.trim(text)), F.lower(budget_item)
    return (t == "") | (t == b) | (t == F.lower(slug)) | F.contains(b, t) | F.contains(t, b)


def same_budget_item(a: Column, b: Column) -> Column:
    """Equal but for case, equal slugs, or a physical document id of the other's slug."""
    sa, sb = slugify(a), slugify(b)
    return F.coalesce((F.lower(a) == F.lower(b)) | (sa == sb) | F.startswith(F.lower(a), F.concat(sb, F.lit("__"))) | F.startswith(F.lower(b), F.concat(sa, F.lit("__"))), F.lit(False))


def token_pattern(token: Column) -> Column:
    """The token with optional white space between letters and digits."""
    return F.regexp_replace(token, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", r"\\s*")


def token_in_page(token: Column, text: Column) -> Column:
    """Contained, or with white space where letters and digits meet; text is lower-cased."""
    return F.contains(text, token) | (token.rlike("[a-z]") & token.rlike("[0-9]") & F.regexp_like(text, token_pattern(token)))


def squeezed(c: Column) -> Column:
    """Lower-cased, without white space between letters and digits: what token_in_page() finds in c is contained in this."""
    return F.regexp_replace(F.lower(c), r"(?<=[a-z])\s+(?=[0-9])|(?<=[0-9])\s+(?=[a-z])", "")


def token_runs(c: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a page, squeezed; a token (P18) that the page holds stands inside one."""
    return F.array_distinct(F.regexp_extract_all(squeezed(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; none on either side: 0."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


#: Characters of a text that one number holds a bit for, with room for a carry.
LIMB = 60


def _common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by bits.

    A set of numbers holds a bit for each character of b. For each character of a, one
    addition and a mask, with a carry from number to number, clear the bits at which the
    subsequence grows; the cleared bits are its length.
    """
    one = F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, n.cast("int"))
    full = F.lit((1 << LIMB) - 1)

    def walked(others: Column) -> Column:
        limbs = F.sequence(F.lit(0), F.ceil(F.size(others) / LIMB).cast("int") - 1)
        valid = F.transform(limbs, lambda k: bit(F.least(F.lit(LIMB), F.size(others) - k * LIMB)) - one)

        def mask(char: Column) -> Column:
            own = lambda k: F.transform(F.slice(others, k * LIMB + 1, F.lit(LIMB)), lambda x, i: F.when(x == char, bit(i)).otherwise(F.lit(0).cast("long")))
            return F.transform(limbs, lambda k: F.aggregate(own(k), F.lit(0).cast("long"), lambda acc, x: acc + x))

        def over(masks: Column) -> Column:
            def step(v: Column, char: Column) -> Column:
                def limb(state: Column, k: Column) -> Column:
                    here, m = F.get(v, k), F.get(F.try_element_at(masks, char), k)
                    total = here + here.bitwiseAND(m) + state["carry"]
                    kept = total.bitwiseAND(full).bitwiseOR(here.bitwiseAND(F.bitwise_not(m)))
                    return F.struct(F.shiftright(total, LIMB).alias("carry"), F.array_append(state["v"], kept).alias("v"))

                none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("v"))
                return F.when(F.map_contains_key(masks, char), F.aggregate(limbs, none, limb)["v"]).otherwise(v)

            left = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), valid, step)
            return F.size(others) - F.aggregate(F.zip_with(left, valid, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)

        entries = F.transform(F.array_distinct(others), lambda c: F.struct(c.alias("key"), mask(c).alias("value")))
        return F.get(F.transform(F.array(F.map_from_entries(entries)), over), F.lit(0))

    return F.get(F.transform(F.array(F.filter(F.split(b, ""), lambda c: c != "")), walked), F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (both lengths)."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(200.0 * _common_length(a, b) / total)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """P25."""
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def row_id(row_index: Column, *fields: Column) -> Column:
    """row_<index>_<8 hex digits of sha256 of the index and fields, null as None>."""
    joined = F.concat_ws("|", row_index.cast("string"), *(F.coalesce(f.cast("string"), F.lit("None")) for f in fields))
    return F.concat(F.lit("row_"), row_index.cast("string"), F.lit("_"), F.substring(F.sha2(joined, 256), 1, 8))


def content_hash(c: Column) -> Column:
    """P30."""
    return F.sha2(c, 256)


def json_text(c: Column) -> Column:
    """A string as JSON, or null."""
    quoted = F.to_json(F.array(c.cast("string")))
    return F.coalesce(F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), F.lit("null"))


def request_id(job: Column, sub_item: Column, doc: Column, amount: Column, row_texts: Column, table_texts: Column, amounts: Column) -> Column:
    """16 hex digits over the JSON list of a request's parts; amount and amounts as texts, lists sorted, null lists empty."""
    def listed(values: Column) -> Column:
        texts = F.array_sort(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")))
        return F.concat(F.lit("["), F.array_join(F.transform(texts, json_text), ", "), F.lit("]"))

    parts = F.concat_ws(", ", json_text(job), json_text(sub_item), json_text(doc), F.coalesce(json_text(amount), F.lit('"None"')), listed(row_texts), listed(table_texts), listed(amounts))
    return F.substring(F.sha2(F.concat(F.lit("["), parts, F.lit("]")), 256), 1, 16)


def page_label(filename: Column, local_page: Column, page: Column) -> Column:
    """P32: 'file p.N (vp M)', or 'vp M' where no file holds the page."""
    return F.when(filename.isNotNull(), F.format_string("%s p.%d (vp %d)", filename, local_page, page)).otherwise(F.format_string("vp %d", page))


def csv_field(c: Column) -> Column:
    """P33."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def amounts_shown(c: Column) -> Column:
    """All d.dd that a text contains, at whatever place in a number, as texts: 172.005 shows 172.00, 72.00 and 2.00."""
    numbers = F.regexp_extract_all(c, F.lit(r"(?<![0-9])(?=([0-9]+[.][0-9]{2}))"), F.lit(1))
    tails = F.transform(numbers, lambda n: F.transform(F.sequence(F.lit(1), F.length(n) - 3), lambda i: F.substring(n, i, F.length(n))))
    return F.array_distinct(F.concat(F.flatten(tails), F.regexp_extract_all(c, F.lit(r"(?=(-[0-9]+[.][0-9]{2}))"), F.lit(1))))


def dollars_shown(c: Column) -> Column:
    """All whole d of $d that a text contains, as texts."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\$\s*([0-9]+)(?![.0-9])"), F.lit(1)))


def amount_text(c: Column) -> Column:
    """Two decimals when positive, else empty."""
    return F.when(c > 0, F.format_string("%.2f", c.cast("double"))).otherwise(F.lit(""))


def amounts_text(c: Column) -> Column:
    """Several joined by ' / '."""
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, amount_text), " / ")).otherwise(F.lit(""))


def employee_slug(first: Column, last: Column) -> Column:
    """P37."""
    return slugify(F.concat_ws(" ", first, last))


def manual_keywords(c: Column) -> Column:
    """Comma-split, trimmed, without empties."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda t: t != "")


def add_keyword(keywords: Column, word: Column) -> Column:
    """Normalized and added if absent."""
    w = F.lower(F.trim(word))
    return F.when((w == "") | F.array_contains(keywords, w), keywords).otherwise(F.array_append(keywords, w))


def remove_keyword(keywords: Column, word: Column) -> Column:
    return F.array_remove(keywords, F.lower(F.trim(word)))


def search_words(c: Column) -> Column:
    """Comma-split, trimmed, lower-cased, two characters or more."""
    return F.filter(F.transform(F.split(c, ","), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 2)


def shortened(c: Column, most: int) -> Column:
    """What of a text goes into a prompt."""
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def highlight_labels(amount: Column, first: Column, last: Column) -> Column:
    """P42."""
    name = F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))
    return F.filter(F.array(F.when(amount > 0, F.concat(F.lit("$"), F.format_number(amount, 2))), name), lambda x: x.isNotNull())


def default_entities(page_number: Column) -> Column:
    """What stands for a page whose extraction failed."""
    strings = F.array().cast("array<string>")
    return F.struct(
        page_number.cast("int").alias("page_number"),
        F.lit("unknown").alias("doc_type"),
        F.array().cast("array<struct<full_name:string,first_name:string,last_name:string>>").alias("people"),
        *(strings.alias(c) for c in ("organizations", "periods", "dates")),
        F.array().cast("array<struct<raw:string,value:double,currency:string,context:string,budget_item:string,source:string,table_row_index:int>>").alias("amounts"),
        strings.alias("keywords"),
    )
