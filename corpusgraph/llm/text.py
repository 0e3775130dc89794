"""Vectorised word hashing over Arrow string columns.

A batch of texts is one byte buffer, so words are found and hashed for all of
its documents at once with numpy.  Work is cut into slices of about ``SLICE``
bytes at white space, which bounds the memory of a very long text; a longer
word is a slice of its own and is hashed piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: tuple[np.ndarray, np.ndarray] | None = None

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        n = SLICE + 1
        with np.errstate(over="ignore"):
            up, down = np.full(n, _MULT), np.full(n, inverse)
            up[0] = down[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and ends in them; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(raw: np.ndarray, at: np.ndarray, sep: np.ndarray | None) -> list[tuple[int, int]]:
    """Byte ranges of at most SLICE bytes that end where a text ends or behind a separator; longer only where a single word is.

    Without separators a text is cut anywhere.
    """
    out, lo, end = [], int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + SLICE, end)
        if hi < end:
            k = int(at[np.searchsorted(at, hi, side="right") - 1])
            if k > lo:
                hi = k
            elif sep is not None:
                stop = int(at[np.searchsorted(at, hi, side="left")])
                gaps = np.flatnonzero(sep[raw[lo:hi]])
                while not len(gaps) and hi < stop:
                    lower, hi = hi, min(hi + SLICE, stop)
                    gaps = lower - lo + np.flatnonzero(sep[raw[lower:hi]])[:1]
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        out.append((lo, hi))
        lo = hi
    return out


def spans(raw: np.ndarray, at: np.ndarray, lo: int, hi: int, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw[lo:hi], counted from lo; no word crosses the end of a text."""
    gap = sep[raw[lo:hi]]
    edges = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
    before = np.empty(hi - lo, dtype=bool)
    before[0], before[1:] = True, gap[:-1]
    before[edges[edges < hi - lo]] = True
    after = np.empty(hi - lo, dtype=bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edges[edges > 0] - 1] = True
    word = ~gap
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def hash_spans(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of part[s:e] for each span."""
    up, down = _tables()
    if len(part) > SLICE:
        return np.array([_hash_long(part[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _hash_long(word: np.ndarray) -> int:
    """What hash_spans gives a word, without an array of its length."""
    up, _ = _tables()
    total, shift, step = 0, 1, pow(int(_MULT), SLICE, 1 << 64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(word), SLICE):
            piece = word[lo : lo + SLICE]
            total += shift * int(np.sum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)]))
            shift = shift * step % (1 << 64)
        return int(mix(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))[0])


def word_hashes(texts: pa.Array, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order.

    Returns hashes, the bounds of each text's words in them, and each word's
    byte start and end counted from the start of its own text.
    """
    raw, at = buffer_of(texts)
    found, begin, stop = [], [], []
    for lo, hi in slices(raw, at, sep):
        s, e = spans(raw, at, lo, hi, sep)
        found.append(hash_spans(LOWER[raw[lo:hi]], s, e))
        begin.append(s + lo)
        stop.append(e + lo)
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begin = np.concatenate(begin) if begin else np.zeros(0, np.int64)
    stop = np.concatenate(stop) if stop else np.zeros(0, np.int64)
    bounds = np.searchsorted(begin, at)
    home = np.repeat(at[:-1], np.diff(bounds))
    return hashes, bounds, begin - home, stop - home


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives this word."""
    return int(word_hashes(pa.array([word]))[0][0])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words, without regard to texts' ends."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for j in range(n):
            out = (out + hashes[j : len(hashes) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)
