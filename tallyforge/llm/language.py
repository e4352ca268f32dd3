"""Language identification: a linear-chain conditional random field labels every word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common, tokens

#: Labelled documents of each language that the model is fitted on, chosen by hash, and documents in all.
FIT_DOCUMENTS, FIT_ROWS = 300, 40_000
#: Characters of a document that the fit sees, drawn in spans by hash, and characters in all, about.
FIT_CHARS, FIT_TOTAL, FIT_SPAN = 40_000, 40_000_000, 500
#: Slots of the hashed affix and n-gram weights; lexicon entries.
SLOTS, LEXICON = 1 << 17, 50_000
STEPS, SEQUENCES, SPAN, LENGTH = 160, 192, 14, 48
#: Words that are stepped through together; longer texts are strung from such segments.
SEGMENT = 64
#: Bytes of texts that a worker labels at once.
BATCH = 2_000_000

_U = np.uint64
_MIX1, _MIX2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_EDGE = 1  # stands before and after each word; no letter


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(_MIX1)
    h = (h ^ (h >> _U(27))) * _U(_MIX2)
    return h ^ (h >> _U(31))


_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


@dataclass
class Words:
    """The words (letter runs, lower-cased) of some texts."""

    chars: np.ndarray  # code points, an _EDGE before and after each word
    start: np.ndarray  # of each word's first letter
    size: np.ndarray
    doc: np.ndarray
    key: np.ndarray  # 64-bit hash


def words_of(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    letter = _letters()[codes]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    doc = np.searchsorted(ends, begin, "right")
    # repack as edge, letters, edge for each word
    start = np.cumsum(size + 2) - size - 1
    chars = np.full(int((size + 2).sum()) + 4, _EDGE, np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    chars[np.repeat(start, size) + place] = codes[np.repeat(begin, size) + place]
    if not len(size):
        return Words(chars, start, size, doc, np.zeros(0, np.uint64))
    powers = np.cumprod(np.full(int(size.max()), _GOLD, np.uint64))
    sums = np.add.reduceat(_mix(codes[np.repeat(begin, size) + place].astype(np.uint64) + _U(_GOLD)) * powers[place], np.cumsum(size) - size)
    return Words(chars, start, size, doc, _mix(sums + size.astype(np.uint64)))


def features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's affixes (1-4) and n-grams (2, 3), one word after the other, and their numbers."""
    start, size = words.start[which], words.size[which]
    c = words.chars
    slots, owner = [], []

    def gram(at: np.ndarray, n: int, kind: int) -> np.ndarray:
        h = np.full(len(at), (kind * _GOLD) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = _mix(h + c[at + k] + _U(k + 1))
        return (h & _U(SLOTS - 1)).astype(np.int64)

    everyone = np.arange(len(which))
    for n in range(1, 5):
        long = everyone[size >= n]
        slots += [gram(start[long], n, 10 + n), gram(start[long] + size[long] - n, n, 20 + n)]
        owner += [long, long]
    for n in (2, 3):
        count = np.maximum(size + 3 - n, 0)  # both edges take part
        who = np.repeat(everyone, count)
        place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        slots.append(gram(start[who] - 1 + place, n, n))
        owner.append(who)
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.bincount(owner, minlength=len(which))


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # SLOTS x labels
    scale: float  # of the lexicon feature
    keys: np.ndarray  # lexicon: sorted hashes
    leaning: np.ndarray  # and log P(label | word) less its prior
    transition: np.ndarray

    def lexicon(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), len(self.labels)), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            out[known] = self.leaning[at[known]]
        return out

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each word's labels; a word that recurs is scored once."""
        _, first, inverse = np.unique(words.key, return_index=True, return_inverse=True)
        out = np.zeros((len(first), len(self.labels)), np.float32)
        for a in range(0, len(first), 50_000):
            which = first[a : a + 50_000]
            slots, counts = features(words, which)
            out[a : a + 50_000] = np.add.reduceat(self.weight[slots], np.cumsum(counts) - counts) + self.scale * self.lexicon(words.key[which])
        return out[inverse]


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(label) of every word by forward-backward, for texts of the given numbers of words.

    A text starts from an unknown label. Texts are cut into segments: all segments' transfer
    matrices are multiplied up in step, then strung together in step over the texts, and
    the messages inside segments follow from those at their ends. The result is exact,
    and the steps depend on the longest text's segments, not on its words.
    """
    k = emission.shape[1]
    step = np.exp(transition - transition.max()).astype(np.float64)
    gain = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64) if len(emission) else np.zeros((0, k))
    per = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(lengths) - lengths)[text] + nth * SEGMENT
    size = np.minimum(lengths[text] - nth * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size, text, nth = begin[order], size[order], text[order], nth[order]
    n = len(size)
    live = [int(np.searchsorted(-size, -s, "left")) for s in range(SEGMENT)]  # segments longer than s
    transfer = np.tile(np.eye(k), (n, 1, 1))
    for s in range(SEGMENT):
        if m := live[s]:
            t = (transfer[:m].reshape(-1, k) @ step).reshape(m, k, k) * gain[begin[:m] + s][:, None, :]
            transfer[:m] = t / t.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((n, k)), np.empty((n, k))
    row = np.lexsort((text, nth))
    cuts = np.searchsorted(nth[row], np.arange(nth.max() + 2 if n else 1))
    a, b = np.full((len(lengths), k), 1 / k), np.ones((len(lengths), k))
    for r in (row[x:y] for x, y in zip(cuts, cuts[1:])):
        ahead[r] = a[text[r]]
        now = np.einsum("ni,nij->nj", ahead[r], transfer[r])
        a[text[r]] = now / now.sum(axis=1, keepdims=True)
    for r in (row[x:y] for x, y in reversed(list(zip(cuts, cuts[1:])))):
        behind[r] = b[text[r]]
        now = np.einsum("nij,nj->ni", transfer[r], behind[r])
        b[text[r]] = now / now.sum(axis=1, keepdims=True)
    out = np.empty((len(emission), k))
    for s in range(SEGMENT):
        if m := live[s]:
            now = (ahead[:m] @ step) * gain[begin[:m] + s]
            ahead[:m] = now / now.sum(axis=1, keepdims=True)
            out[begin[:m] + s] = ahead[:m]
    for s in reversed(range(SEGMENT)):
        if m := live[s]:
            at = begin[:m] + s
            both = out[at] * behind[:m]
            out[at] = both / both.sum(axis=1, keepdims=True)
            now = (gain[at] * behind[:m]) @ step.T
            behind[:m] = now / now.sum(axis=1, keepdims=True)
    return out


def train(samples: list[tuple[str, str]], seed: int = 3) -> Model:
    """Fits the field to (text, language) samples by stochastic gradients of its likelihood.

    Sequences are strung from spans of different documents, each word labelled with its
    document's language, so that transitions learn both staying and switching.
    """
    labels = sorted({lang for _, lang in samples})
    k = len(labels)
    words = words_of([t for t, _ in samples])
    of_doc = np.array([labels.index(lang) for _, lang in samples], np.int64)
    label = of_doc[words.doc] if len(words.doc) else np.zeros(0, np.int64)
    unique, inverse, counts = np.unique(words.key, return_inverse=True, return_counts=True)
    table = np.bincount(inverse * k + label, minlength=len(unique) * k).reshape(-1, k).astype(np.float64) if len(unique) else np.zeros((0, k))
    share = table.sum(axis=0) / max(1, table.sum())
    common_words = np.sort(np.argsort(-counts, kind="stable")[:LEXICON])
    common_words = common_words[counts[common_words] >= 3]
    if not len(samples):
        return Model([], np.zeros((SLOTS, 0), np.float32), 0.2, np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    leaning = np.log((table[common_words] / np.maximum(table.sum(axis=0), 1) + 1e-6) / ((table[common_words] / np.maximum(table.sum(axis=0), 1)).mean(axis=1, keepdims=True) + 1e-6))
    model = Model(labels, np.zeros((SLOTS, k), np.float32), 0.2, unique[common_words], np.clip(leaning, -4, 4).astype(np.float32), np.zeros((k, k)))
    if k < 2 or not len(label):
        return model
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(label == i) for i in range(k)]
    square, square_t, square_s = np.full((SLOTS, k), 1e-2, np.float32), np.full((k, k), 1e-2), 1e-2
    lengths = np.full(SEQUENCES, LENGTH)
    for _ in range(STEPS):
        at = np.empty(SEQUENCES * LENGTH, np.int64)
        filled = 0
        while filled < len(at):
            own = by_label[rng.integers(k)]
            if len(own):
                n = min(int(rng.geometric(1 / SPAN)), len(at) - filled)
                at[filled : filled + n] = own[(rng.integers(len(own)) + np.arange(n)) % len(own)]
                filled += n
        y = label[at]
        slots, counts_ = features(words, at)
        lexical = model.lexicon(words.key[at])
        emission = np.add.reduceat(model.weight[slots], np.cumsum(counts_) - counts_) + model.scale * lexical
        p = marginals(emission, lengths, model.transition)
        wrong = (np.eye(k)[y] - p) / SEQUENCES
        spread = np.repeat(np.arange(len(at)), counts_)
        for i in range(k):
            g = np.bincount(slots, wrong[spread, i], SLOTS).astype(np.float32) - 1e-5 * model.weight[:, i]
            square[:, i] += g * g
            model.weight[:, i] += 0.3 * g / np.sqrt(square[:, i])
        g = float((wrong * lexical).sum())
        square_s += g * g
        model.scale += 0.05 * g / np.sqrt(square_s)
        expected = pair_counts(emission, p, model.transition)
        seen = np.zeros((k, k))
        inner = np.arange(len(at)) % LENGTH > 0
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        g = (seen - expected) / SEQUENCES - 1e-3 * model.transition
        square_t += g * g
        model.transition = model.transition + 0.2 * g / np.sqrt(square_t)
    return model


def pair_counts(emission: np.ndarray, p: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Expected label pairs of neighbouring words, for sequences of LENGTH words."""
    k = p.shape[1]
    gain = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(float).reshape(-1, LENGTH, k)
    step = np.exp(transition - transition.max())
    ahead = np.empty_like(gain)
    now = np.full((len(gain), k), 1 / k)
    for s in range(LENGTH):
        now = (now @ step) * gain[:, s]
        now /= now.sum(axis=1, keepdims=True)
        ahead[:, s] = now
    behind = np.ones((len(gain), k))
    total = np.zeros((k, k))
    for s in range(LENGTH - 1, 0, -1):
        joint = ahead[:, s - 1, :, None] * step * (gain[:, s] * behind)[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind = (gain[:, s] * behind) @ step.T
        behind /= behind.sum(axis=1, keepdims=True)
    return total


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """Fits on about documents labelled rows of each language, on fewer where FIT_ROWS leaves fewer, on one at least.

    Rows are chosen by hash among those that are not held out; null doc_id, text or lang: not
    used. Every language is learned. Of a long text the fit sees spans from all over it, drawn
    by hash; their number goes down with that of the rows, so that up to FIT_ROWS languages
    FIT_TOTAL characters (160 MB at four bytes each) bound what comes to the driver,
    whatever the texts. No usable row: a model without labels.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1 << 20))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).orderBy("lang").collect()
    if not counts:
        return train([])
    documents = max(1, min(documents, FIT_ROWS // len(counts)))
    chars = max(FIT_SPAN, min(FIT_CHARS, FIT_TOTAL // (2 * documents * len(counts))))
    chance = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], max(r["least"], int((1 << 20) * documents / r["n"])) + 1)))
    chosen = usable.filter(F.coalesce(place < F.try_element_at(chance, F.col("lang")), F.lit(False)))
    spans = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{FIT_SPAN}}})"))
    drawn = F.filter(spans, lambda s, i: F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 20)) * F.length("text") < F.lit(chars << 19))
    seen = F.when(F.length("text") <= chars, F.col("text")).otherwise(F.array_join(F.slice(drawn, 1, chars // FIT_SPAN), " "))
    rows = chosen.select(seen.alias("text"), "lang").limit(2 * documents * len(counts)).collect()
    return train(sorted((r["text"], r["lang"]) for r in rows))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_letter_words, n_switches) of every row of docs(doc_id, text).

    Every word of the whole text gets P(language) by forward-backward; the document's
    language has the largest mean, its score. n_switches counts neighbouring words whose
    likeliest languages differ. Null text, or one without a letter (or a model without
    labels): `und`, score 0. Every row is judged; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        common.forget()
        m = shared.value
        for whole in batches:
            for part in tokens.batches(whole, limit=BATCH):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                words = words_of(texts)
                n = np.bincount(words.doc, minlength=len(texts))
                names, scores, switches = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if len(words.doc) and m.labels:
                    p = marginals(m.emissions(words), n, m.transition)
                    full = np.flatnonzero(n)
                    mean = np.add.reduceat(p, (np.cumsum(n) - n)[full]) / n[full, None]
                    best = mean.argmax(axis=1)
                    for i, j in zip(full.tolist(), best.tolist()):
                        names[i] = m.labels[j]
                    scores[full] = np.clip(mean[np.arange(len(full)), best], 0, 1)
                    likely = p.argmax(axis=1)
                    changed = (likely[1:] != likely[:-1]) & (words.doc[1:] == words.doc[:-1])
                    switches = np.bincount(words.doc[1:][changed], minlength=len(texts))
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(n.astype(np.int64)), pa.array(switches.astype(np.int64))], ["doc_id", "lang_pred", "score", "n_letter_words", "n_switches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(label, "doc_id long, lang_pred string, score double, n_letter_words long, n_switches long")


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_letter_words", "n_switches")
