"""Simple-8b coding of token ids, and its file format.

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selectors 1-15 say how many
values of how many bits the payload holds; selector 0 is the escape for a value of more
than 60 bits: its payload is a place in the file's list of escaped values. Values are
coded in blocks of BLOCK; the index holds each block's first word, so any block can be
decoded alone. Coding runs over all blocks in step, decoding over all words of a selector
at once.

File (little-endian): magic "TFS8B\\x01\\0\\0", then seven u64: documents, ids, blocks,
words, escapes, block size, 0; then i64 doc_id and u8 validity per document, u64 ids per
document, u64 first word per block and one past the end, the words, the escaped values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024
MAGIC = b"TFS8B\x01\0\0"
#: Values in a word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_WIDTH16 = np.zeros(1 << 16, np.uint8)
for _bits in range(16):
    _WIDTH16[1 << _bits :] = _bits + 1


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if not len(values) or values.max() < 1 << 16:
        return _WIDTH16[values]
    w = np.zeros(len(values), np.uint8)
    for shift in (48, 32, 16, 0):
        part = (values >> np.uint64(shift)).astype(np.uint64)
        here = (w == 0) & (part != 0)
        w[here] = _WIDTH16[part[here].astype(np.int64)] + shift
    return w


def _selectors(width: np.ndarray) -> np.ndarray:
    """The selector of a word that would start at each place: the one that holds most values.

    A run that fits a selector fits every selector of fewer values, so each selector looks
    only at the places that the one before it left.
    """
    n = len(width)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.int16)
    best = np.where(width <= 60, 15, 0).astype(np.uint8)
    most, held = width.copy(), 1
    places = None
    for s in range(14, 0, -1):
        c, b = int(COUNTS[s]), int(BITS[s])
        if places is None:
            for k in range(held, c):
                np.maximum(most[: n - k], width[k:], out=most[: n - k]) if n > k else None
            fits = (most <= b) & (left >= c)
            if s <= 12:
                places = np.flatnonzero(fits)
                best[places] = s
                most = most[places]
            else:
                best[fits] = s
        else:
            room = left[places] >= c
            places, most = places[room], most[room]
            for k in range(held, c):
                most = np.maximum(most, width[places + k])
            fits = most <= b
            places, most = places[fits], most[fits]
            best[places] = s
        held = c
        if places is not None and not len(places):
            break
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block with one past the end, and escaped values."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    best = _selectors(_widths(v))
    step = COUNTS[best]
    first = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    while len(at):
        first[at] = True
        at = at + step[at]
        going = at < end
        at, end = at[going], end[going]
    starts = np.flatnonzero(first)
    chosen = best[starts]
    words = np.zeros(len(starts), np.uint64)
    escaped = np.zeros(0, np.uint64)
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        at = starts[which]
        if s == 0:
            escaped = v[at]
            words[which] = np.arange(len(which), dtype=np.uint64)
            continue
        word = np.full(len(which), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for k in range(int(COUNTS[s])):
                word |= v[at + k] << np.uint64(k * int(BITS[s]))
        words[which] = word
    index = np.searchsorted(starts, np.append(np.arange(0, n, BLOCK), n)).astype(np.uint64)
    return words, index, escaped


def decode(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values of whole blocks."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        w = words[which]
        if s == 0:
            out[starts[which]] = escaped[(w & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            b = int(BITS[s])
            for k in range(int(COUNTS[s])):
                out[starts[which] + k] = (w >> np.uint64(k * b)) & np.uint64((1 << b) - 1)
    return out


@dataclass
class Shard:
    doc_ids: list
    lengths: np.ndarray
    index: np.ndarray
    words: np.ndarray
    escaped: np.ndarray

    def ids(self) -> np.ndarray:
        return decode(self.words, self.escaped)

    def block(self, k: int) -> np.ndarray:
        """Block k alone."""
        return decode(self.words[int(self.index[k]) : int(self.index[k + 1])], self.escaped)


def write_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, index, escaped = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(index) - 1, len(words), len(escaped), BLOCK, 0], "<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [head, keys, valid, np.asarray(lengths).astype("<u8"), index.astype("<u8"), words.astype("<u8"), escaped.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def read_shard(data: bytes) -> Shard:
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n_docs, _, n_blocks, n_words, n_escaped, block, _ = np.frombuffer(data, "<u8", 7, 8).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block}")
    at = 64

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    keys, valid = take("<i8", n_docs), take("u1", n_docs)
    doc_ids = [k if v else None for k, v in zip(keys.tolist(), valid.tolist())]
    return Shard(doc_ids, take("<u8", n_docs).astype(np.int64), take("<u8", n_blocks + 1), take("<u8", n_words), take("<u8", n_escaped))
