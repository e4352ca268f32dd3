"""Token ids of whole texts, exactly as the tokenizers library gives them.

The library is asked once per distinct piece and worker instead of once per text: the
word_bpe vocabulary splits a normalised text into pieces (contractions, letter runs,
digits, other runs) that are encoded independently of each other and end with a
word-final token each, so a text's ids are the concatenation of its pieces' ids. That
shortcut is taken only for texts whose characters all lie where the normaliser (NFC,
white space, lower case) and the split are plain; any other text goes through the
library whole. A vocabulary file of any other make (another normaliser, split or model)
gets no shortcut: all its texts go through the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyforge.llm import common

#: Every character here is NFC already, lower-cases to one letter, and its class is fixed.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ňŊ-ž‐-‧€]*")
_LETTER = "a-zªµºß-öø-ÿĀ-ž"
_DIGIT = "0-9²³¹¼-¾"
#: The vocabulary's split, of lower-cased words joined by line feeds, which come out too.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|\n|[^ \n{_LETTER}{_DIGIT}]+")
#: Words and pieces a worker remembers; beyond this it starts anew, so its memory is bounded.
_REMEMBERED = 250_000
# The make of vocabulary that the shortcut is right for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


def has_shortcut(made: dict) -> bool:
    """Whether a vocabulary file's content is of the make that the shortcut assumes."""
    model = made["model"]
    return (
        made["normalizer"] == _NORMALIZER
        and made["pre_tokenizer"] == _SPLIT
        and made["post_processor"] is None
        and all(model.get(k) == v for k, v in _MODEL.items())
        and all("<|" in t["content"] for t in made["added_tokens"])
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Store:
    """Keys with an id list each, in flat arrays."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.n, self.used = 0, 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)

    def add(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> int:
        """Appends; returns the place of the first. No keys: entries that are not remembered."""
        first, total = self.n, len(ids)
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lens[first : first + len(lens)] = lens
        self.starts[first : first + len(lens)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + total] = ids
        self.n, self.used = self.n + len(lens), self.used + total
        self.index.update(zip(keys, range(first, self.n)))
        return first

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after the other, and where each entry ends."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(total)], ends


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            self.shortcut = has_shortcut(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = _Store(), _Store()
        if not self.shortcut:
            return
        # the same model for text that is normalised and split already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.final[i] = token.endswith("</w>")

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())), lens

    def _new_pieces(self, new: list[str]) -> None:
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.final[ids]) + 1
            lens = np.diff(ends, prepend=0)
            if len(ends) != len(part) or (len(ids) and ends[-1] != len(ids)):
                ids, lens = self._whole(part)
            self.pieces.add(part, ids, lens)

    def _new_words(self, new: list[str]) -> None:
        flat = _PIECE.findall("\n".join([*new, ""]))
        index = self.pieces.index
        self._new_pieces([p for p in set(flat).difference(index) if p != "\n"])
        # a word's end has no ids of its own
        if "\n" not in index:
            self.pieces.add(["\n"], np.zeros(0, np.int32), np.zeros(1, np.int64))
        at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        ids, ends = self.pieces.take(at)
        upto = ends[at == index["\n"]]
        self.words.add(new, ids, np.diff(upto, prepend=0))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text. Null: none."""
        if not self.shortcut:
            return self._whole([t or "" for t in texts.to_pylist()])
        if max(self.words.n, self.pieces.n) > _REMEMBERED:
            self.words, self.pieces = _Store(), _Store()
        common.trim()
        plain = [t is None or ("<|" not in t and _PLAIN.fullmatch(t) is not None) for t in texts.to_pylist()]
        odd = [i for i, p in enumerate(plain) if not p]
        kept = pc.fill_null(texts, "")
        if odd:
            kept = pc.if_else(pa.array(plain), kept, "")
        split = pc.utf8_split_whitespace(pc.utf8_lower(kept.cast(pa.large_string())))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_name = np.fromiter(map(self.words.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        # words are added in the order in which they are missing
        missing, first = np.flatnonzero(of_name < 0), self.words.n
        self._new_words([names[i] for i in missing.tolist()])
        of_name[missing] = np.arange(first, first + len(missing))
        at = of_name[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        offsets = offsets - offsets[0]
        if odd:
            first = self.words.add([], *self._whole([texts[i].as_py() for i in odd]))
            at = np.insert(at, offsets[odd], first + np.arange(len(odd)))
            offsets = offsets + np.concatenate([[0], np.cumsum(~np.array(plain))])
        ids, ends = self.words.take(at)
        return ids, np.diff(np.concatenate([[0], ends])[offsets])


_encoders: dict[str, Encoder] = {}
common.MEMORIES.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, with what it remembers from earlier batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part's texts have about limit bytes, whatever their number."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
