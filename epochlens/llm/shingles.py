"""Word shingles of whole texts as sorted arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64

WORDS = 5
_rng = np.random.default_rng(20240531)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def hash_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes, none of them empty.

    Each eight bytes are mixed with their place before they are added up, so that no pattern of bytes cancels out as it can in a
    polynomial modulo 2^64.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # Eight bytes from any place on, whatever its alignment.
    eight = np.ndarray((len(raw),), dtype="<u8", buffer=np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        chunks = (lengths + 7) >> 3
        firsts = np.cumsum(chunks) - chunks
        if len(starts) == int(chunks.sum()):
            at, left, within = starts, lengths, 0
        else:
            within = (np.arange(int(chunks.sum())) - np.repeat(firsts, chunks)) << 3
            at, left = np.repeat(starts, chunks) + within, np.repeat(lengths, chunks) - within
        values = eight[at] & _KEEP[np.minimum(left, 8)]
        mixed = mix64(values + np.asarray(within + 8, dtype=np.uint64) * _BASE)
        return mix64(np.add.reduceat(mixed, firsts) ^ (lengths.astype(np.uint64) * _BASE))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and where each text's words begin (one more entry at the end)."""
    data = b" ".join([*texts, b""])
    if lower:
        data = data.translate(_LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    inside = ~_SPACE[raw]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.searchsorted(starts, ends_of_texts)].astype(np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    return hash_runs(raw, starts, ends - starts), offsets


def combine(hashes: np.ndarray, n: int, places: np.ndarray = _PLACE) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    m = len(hashes) - n + 1
    out = np.zeros(max(0, m), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if m > 0 else 0):
            out += hashes[k : k + m] * places[k]
    return mix64(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text: its 5-word shingles, or all its words as one if it has fewer; empty without words.

    Texts are taken about a megabyte at a time, as the arrays need some forty bytes for each byte of text.
    """
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > 1 << 20:
            out += _sets(texts[begin:i])
            begin, size = i, 0
        size += len(t)
    return out + _sets(texts[begin:])


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    hashes, offsets = word_hashes(texts)
    runs = combine(hashes, WORDS)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(hashes[a:b] * _PLACE[:n]).sum(dtype=np.uint64) ^ _SHORT[n]], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
