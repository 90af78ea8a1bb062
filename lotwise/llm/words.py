"""Vectorised word splitting, word hashes, word n-gram hashes and winnowing over Arrow text columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes (UTF-8), compared after folding ASCII
and Latin-1 capitals; everything else separates words. Nulls and empty texts have no words. Whole texts are read,
whatever their length; batches are cut into slices of half a MB of text, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_POW_N = 1 << 12
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_GRAM_INV = pow(_GRAM, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW = _powers(_BASE, _POW_N)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_gram_pow = {"n": 0, "up": None, "down": None}


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Words of a slice of documents: word i is raw[start[i]:end[i]] and hashes to h[i]; document d owns words
    at[d]:at[d + 1] and bytes byte_at[d]:byte_at[d + 1]; first is the slice's first row in its batch."""

    raw: np.ndarray
    folded: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    at: np.ndarray
    byte_at: np.ndarray
    first: int

    @property
    def docs(self) -> int:
        return len(self.at) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs, dtype=np.int64), np.diff(self.at))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row) of a string column, without copying the text; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer text is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def split(col: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Words]:
    raw_all, off = text_buffers(col)
    for a, b in slices(off, most):
        raw = raw_all[off[a] : off[b]]
        at_bytes = off[a : b + 1] - off[a]
        yield words_of(raw, at_bytes, a)


def words_of(raw: np.ndarray, byte_at: np.ndarray, first: int = 0) -> Words:
    folded = _FOLD[raw]
    if len(raw) > 1:
        c = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        folded[1:][c] += 0x20
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _IS_WORD[raw]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    cut = byte_at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts[cut] = inside[cut]  # a word never crosses from one document into the next
    start = np.flatnonzero(starts)
    ends = inside[:-1] & ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    end = np.flatnonzero(ends) + 1
    h = np.zeros(0, _U)
    if len(start):
        size = end - start
        held = np.flatnonzero(inside[:-1])
        first_of = np.zeros(len(start), np.int64)
        np.cumsum(size[:-1], out=first_of[1:])
        k = np.arange(len(held)) - np.repeat(first_of, size)
        if size.max() >= _POW_N:
            k &= _POW_N - 1
        h = np.add.reduceat((folded[held].astype(_U) + _U(1)) * _POW[k], first_of)
        h = mix(h + size.astype(_U) * _U(0xA24BAED4963EE407))
    at = np.searchsorted(start, byte_at)
    at[-1] = len(start)
    return Words(raw, folded, start, end, h, at, byte_at, first)


def _gram_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _gram_pow["n"] < n:
        _gram_pow.update(n=n, up=_powers(_GRAM, n), down=_powers(_GRAM_INV, n))
    return _gram_pow["up"][:n], _gram_pow["down"][:n]


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Running sums that range_hash() turns into the hash of any word range."""
    up, _ = _gram_powers(len(h) + 1)
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[:-1], dtype=_U, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of words a..b-1, the same wherever these words stand."""
    _, down = _gram_powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * down[a])


def gram_hash(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word, whether they all belong to one document)."""
    n = len(w.h)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, bool)
    p = prefix_hash(w.h)
    i = np.arange(n - k + 1)
    g = range_hash(p, i, i + k)
    ok = i + k <= np.repeat(w.at[1:], np.diff(w.at))[: n - k + 1]
    return g, ok


def _sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over a[i:i + w] for every i with a full window."""
    have, cur = 1, a
    while have * 2 <= w:
        cur = op(cur[:-have], cur[have:])
        have *= 2
    if have < w:
        cur = op(cur[: len(cur) - (w - have)], cur[w - have :])
    return cur


def winnow(w: Words, k: int, window: int, thin: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word indices in the slice) and hashes of the winnowed k-grams: of any `window` k-grams in a row in
    one document at least one is chosen, by content alone. So any k + window - 1 shared words share a chosen gram.
    A document with fewer grams than a window gives its smallest. Of equal grams less than a window apart, as in
    repetitive text, the first is kept and then one in each further window, unless `thin` is off; thinned() does that."""
    g, ok = gram_hash(w, k)
    n = len(g)
    if not n:
        return np.zeros(0, np.int64), g
    big = _U(0xFFFFFFFFFFFFFFFF)
    v = np.where(ok, g, big)
    # between documents there are k - 1 invalid grams at least; pad so that every window lies inside one document's reach
    pos = np.flatnonzero(ok)
    if not len(pos):
        return pos, g[:0]
    doc = np.repeat(np.arange(w.docs), np.diff(w.at))[pos]
    val = g[pos]
    size = np.bincount(doc, minlength=w.docs)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    keep = np.zeros(len(pos), bool)
    m = len(val)
    if m >= window:
        low = _sliding(val, window, np.minimum)  # m - window + 1
        i = np.arange(len(low))
        crosses = i + window > (first + size)[doc[: len(low)]]
        low[crosses] = 0  # a window over a border chooses nothing
        pad = np.concatenate([np.zeros(window - 1, _U), low, np.zeros(window - 1, _U)])
        keep = _sliding(pad, window, np.maximum) == val
    short = np.flatnonzero((size > 0) & (size < window))
    if len(short):
        a = first[short]
        inside = np.repeat(short, size[short])
        idx = np.repeat(a - np.concatenate([[0], np.cumsum(size[short])[:-1]]), size[short]) + np.arange(size[short].sum())
        least = np.zeros(w.docs, _U)
        least[short] = np.minimum.reduceat(val[idx], np.concatenate([[0], np.cumsum(size[short])[:-1]]))
        keep[idx] = val[idx] == least[inside]
    chosen = np.flatnonzero(keep)
    p, hv = pos[chosen], val[chosen]
    if thin:
        keep = thinned(p, hv, doc[chosen], window)
        p, hv = p[keep], hv[keep]
    return p, hv


def thinned(p: np.ndarray, hv: np.ndarray, d: np.ndarray, window: int) -> np.ndarray:
    """Which of the grams of winnow() are kept where equal ones stand less than a window apart."""
    same = np.zeros(len(p), bool)
    if len(p) > 1:
        same[1:] = (hv[1:] == hv[:-1]) & (d[1:] == d[:-1]) & (p[1:] - p[:-1] < window)
    drop = np.zeros(len(p), bool)
    last = {}
    for j in np.flatnonzero(same).tolist():
        base = last.get(j - 1, p[j - 1])
        if p[j] - base < window:
            drop[j] = True
            last[j] = base
        else:
            last[j] = p[j]
        last.pop(j - 1, None)
    return ~drop
