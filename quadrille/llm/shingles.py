"""Word shingles of whole batches of texts as 64-bit hashes, in numpy: a polynomial over bytes for each word, then over the
words of each window. Sketches and prefixes of sets of them, for similarity joins."""

from __future__ import annotations

import math

import numpy as np

#: Bytes whose powers are kept; a batch is hashed in pieces of about this size that end between words.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, np.bool_)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(43).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bits of a sketch, by the size of its set.
LEAST_BITS, MOST_BITS = 512, 16384
_powers: list[np.ndarray] = []


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, PIECE + 1) - 1, b, np.uint64)))) for b in bases]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(blob: bytes) -> list[bytes]:
    """The bytes in pieces that end between words; only a single word can make a piece longer than PIECE."""
    out, at = [], 0
    while len(blob) - at > PIECE:
        end = at + PIECE
        while end < len(blob) and not _GAP[blob[end]]:
            end += 1
        out.append(blob[at:end])
        at = end
    return [*out, blob[at:]]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, how many words each text has). Words are runs without \\x20\\x09-\\x0D, A-Z
    lower-cased; a null has none."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    first, size = 0, 0
    for i, text in enumerate([*texts, None]):
        length = len(text) + 1 if text else 0
        if i == len(texts) or (size and size + length > PIECE):
            part = [t or b"" for t in texts[first:i]]
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            offset = 0
            for piece in _pieces(b" ".join(part).lower()):
                codes = np.frombuffer(piece, np.uint8)
                edge = np.flatnonzero(np.diff(_GAP[codes], prepend=True, append=True))
                starts, stops = edge[::2], edge[1::2]
                up, down = _power_table(len(codes) + 1)
                total = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(_LETTER[codes] * up[: len(codes)], out=total[1:])
                hashes.append(mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
                counts[first:i] += np.bincount(np.searchsorted(ends, starts + offset, "right"), minlength=len(part))
                offset += len(piece)
            first, size = i, 0
        size += length
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, none if it has no words."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        windows += words[k : k + n] * _PLACE[k]
    windows = mix(windows)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            found = np.sort(windows[at : at + count - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif count:
            out.append(mix((words[at : at + count] * _PLACE[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def needed(n: int, similarity: float) -> int:
    """How many elements of a set of n a similar set has to have, whatever its size."""
    return math.ceil(similarity * n - 1e-9)


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The elements of which two sets at the similarity share one at least: the first n - needed + 1 in an order that has
    the sorted `common` ones last. Any order that is the same for all sets gives every pair; this one gives few others."""
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    last = common[at] == found if len(common) else np.zeros(len(found), np.bool_)
    return np.concatenate((found[~last], found[last]))[: len(found) - needed(len(found), similarity) + 1]


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the elements that fall on each of some 2 n places (LEAST_BITS to MOST_BITS, a power of two), as 64-bit
    words. Two sets differ in at least as many elements as their sketches, folded to the same size, differ in bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(found) - 1).bit_length() if len(found) else 0))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of `size` words of the same set."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def most_apart(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many elements two sets of n together may differ at the similarity."""
    return n * ((1 - similarity) / (1 + similarity)) + 1e-9


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set, from the lowest."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(words), 8192):
        out += np.unpackbits(words[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 1.0
