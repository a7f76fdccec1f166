"""Pairs of texts by partial ratio, in arrays: bounds by shared grams first, then the longest common subsequences of windows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

from quadrille.functions.text import best_window_ratio

#: Columns of a matrix of grams; more grams share columns, which only lets more pairs through. Pairs of a product, and characters.
GRAMS, PAIRS, CHARS = 4096, 1 << 20, 1 << 20
#: Texts that are asked for at once.
ASKED = 64


def shared_least(m: int, q: int, threshold: float) -> int:
    """How many q-grams of a text of m characters, counted as often as they stand there, any longer text with a partial ratio of
    the threshold has at least; 0 or less is no promise.

    A window of w <= m characters with a common subsequence of l has a ratio of 2 l / (m + w), so l >= t (m + w) / 2. Each of
    the m - l characters that are left out of the text breaks q of its grams at most, and each of the w - l that are put
    between its characters q - 1. What is broken is linear in w, between w = m and the shortest window, where w = l.
    """
    t = threshold / 100 - 1e-9
    broken = max((2 * q - 1) * (1 - t) * m, q * (m - m * (t / (2 - t))))
    return int(np.ceil(m - (q - 1) - broken - 1e-6))


def _grams(text: str, q: int) -> list[str]:
    return [text[i : i + q] for i in range(len(text) - q + 1)]


def _counts(texts: list[str], q: int, known: dict[str, int], width: int) -> np.ndarray:
    """How often each known gram stands in each text."""
    at = [(i, known[g] % width) for i, t in enumerate(texts) for g in _grams(t, q) if g in known]
    out = np.zeros((len(texts), width), np.float32)
    if at:
        np.add.at(out, tuple(np.array(at).T), 1)
    return out


def similar(left: list[str], right: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs with a partial ratio of at least the threshold, and the ratios; of texts of one length the left
    one counts as the shorter."""
    found = [np.zeros((3, 0))]
    for a, b, strict in ((left, right, False), (right, left, True)):
        for i, j, score in _one_way(a, b, threshold, strict):
            found.append(np.array([j, i, score] if strict else [i, j, score]))
    i, j, score = np.concatenate(found, axis=1)
    return i.astype(np.int64), j.astype(np.int64), score


def _one_way(shorts: list[str], longs: list[str], threshold: float, strict: bool) -> Iterator[tuple]:
    order = sorted(range(len(longs)), key=lambda j: len(longs[j]))
    sizes = np.array([len(longs[j]) for j in order])
    of: dict[int, list[int]] = {}
    for i, text in enumerate(shorts):
        of.setdefault(len(text), []).append(i)
    blank = of.pop(0, [])
    empty = [] if strict else [j for j in order if not longs[j]]
    yield np.repeat(blank, len(empty)).astype(int), np.tile(np.array(empty, int), len(blank)), np.full(len(blank) * len(empty), 100.0)
    pieces = _pieces(sizes)
    known: dict[int, dict[str, int]] = {}
    for q in (1, 2):
        grams = sorted({g for m, group in of.items() for i in group for g in _grams(shorts[i], q)})
        known[q] = {g: n for n, g in enumerate(grams)}
    widths = {q: min(GRAMS, max(1, len(known[q]))) for q in known}
    for first, last in pieces:
        texts = [longs[j] for j in order[first:last]]
        there: dict[int, np.ndarray] = {}
        for m, group in of.items():
            begin = int(np.searchsorted(sizes[first:last], m, "right" if strict else "left"))
            if begin == len(texts):
                continue
            q = 2 if shared_least(m, 2, threshold) >= 1 else 1
            least = shared_least(m, q, threshold)
            for k in range(0, len(group), 256):
                part = group[k : k + 256]
                if least >= 1:
                    if q not in there:
                        there[q] = np.minimum(_counts(texts, q, known[q], widths[q]), 1)
                    shared = _counts([shorts[i] for i in part], q, known[q], widths[q]) @ there[q][begin:].T
                    i, j = np.nonzero(shared > least - 0.5)
                else:
                    i, j = (x.ravel() for x in np.indices((len(part), len(texts) - begin)))
                score = _ratios([shorts[x] for x in part], texts[begin:], i, j, threshold)
                keep = score >= threshold
                yield np.array(part)[i[keep]], np.array(order[first:last])[begin + j[keep]], score[keep]


def _pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts in order of length, of bounded number and characters when all are as long as the last."""
    out, first = [], 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (i - first >= PAIRS // 256 or (i - first + 1) * n > CHARS):
            out.append((first, i))
            first = i
    return [*out, (first, len(sizes))] if len(sizes) else []


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"U{max(1, width)}").view(np.uint32).reshape(len(texts), -1)


def _ratios(shorts: list[str], longs: list[str], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """best_window_ratio() of pairs of shorts, which are of one length, and longs, in order of length. A pair that is below the
    threshold may get less than its ratio."""
    m, n = len(shorts[0]), np.array([len(x) for x in longs])
    if m > 64:
        return np.array([best_window_ratio(shorts[a], longs[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
    order = np.argsort(-n[j], kind="stable")
    given = _codes(shorts, m)
    alphabet = np.unique(given)
    masks, turned = (np.zeros((len(shorts), len(alphabet) + 1), np.uint64) for _ in range(2))  # the last is of all other characters
    at = np.searchsorted(alphabet, given)
    for p in range(m):
        masks[np.arange(len(shorts)), at[:, p]] |= np.uint64(1 << p)
        turned[np.arange(len(shorts)), at[:, p]] |= np.uint64(1 << m - 1 - p)
    codes = _codes(longs, int(n.max()))
    place = np.searchsorted(alphabet, codes).clip(0, len(alphabet) - 1)
    place = np.where(alphabet[place] == codes, place, len(alphabet)).astype(np.int32)
    out = np.zeros(len(i))
    full = np.uint64((1 << m) - 1)
    stride = masks.shape[1]

    def step(row: np.ndarray, base: np.ndarray, code: np.ndarray, table: np.ndarray = masks) -> np.ndarray:
        hit = row & table.ravel()[base + code]
        return ((row + hit) | (row - hit)) & full

    common = lambda row: m - np.bitwise_count(row).astype(np.int64)
    for k in range(0, len(order), PAIRS // 16):
        some = order[k : k + PAIRS // 16]
        base, text, size = i[some] * stride, j[some], n[j[some]]
        best = np.zeros(len(some))
        row = np.full(len(some), full)
        for p in range(int(size[0])):
            live = int(np.searchsorted(-size, -p, "left"))  # of more than p characters, as they are in falling order
            row[:live] = step(row[:live], base[:live], place[text[:live], p])
            if p + 1 < m:
                best = np.maximum(best, 200.0 * common(row) / (m + p + 1))  # windows at the beginning
        t = threshold / 100 - 1e-9
        ok = np.flatnonzero((common(row) >= m * t / (2 - t) - 1e-6) | (best >= threshold))
        base, text, size, top = base[ok], text[ok], size[ok], best[ok]
        if len(ok):
            row = np.full(len(ok), full)
            for w in range(1, m):  # windows at the end, from the last character on
                row = step(row, base, place[text, size - w], turned)
                top = np.maximum(top, 200.0 * common(row) / (m + w))
            for s in range(int(size[0]) - m + 1):
                live = int(np.searchsorted(-size, -(m + s), "right"))
                row = np.full(live, full)
                for p in range(s, s + m):
                    row = step(row, base[:live], place[text[:live], p])
                top[:live] = np.maximum(top[:live], 200.0 * common(row) / (m + m))
            best[ok] = top
        out[some] = best
    return out


def nearest(asked: list[str], labels: list[str], k: int, threshold: float, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of asked texts and of the k labels (of each group, if the labels' groups are given) of the best partial ratio
    with each, of those of at least the threshold, and the ratios; of equal ratios the earlier label counts as better, of texts of
    one length the label as the shorter.

    Texts of up to 64 characters are compared in arrays, without groups under a threshold that rises to the k-th best ratio
    found; others as by similar(), some at once.
    """
    fits = lambda texts, fit: np.array([n for n, x in enumerate(texts) if (len(x) <= 64) == fit], int)
    of = lambda texts, at: [texts[n] for n in at.tolist()]
    found, few, given = [np.zeros((3, 0))], fits(asked, True), fits(labels, True)
    if len(few) and len(given):
        index = _Index(of(labels, given), None if groups is None else groups[given])
        few = few[sorted(range(len(few)), key=lambda n: (len(asked[few[n]]), asked[few[n]]))]  # like ones have like ratios, and like labels
        for first in range(0, len(few), ASKED):
            part = few[first : first + ASKED]
            i, j, score = index.nearest(of(asked, part), k, threshold)
            found.append(np.array([part[i], given[j], score]))
    for some, others in ((few, fits(labels, False)), (fits(asked, False), np.arange(len(labels)))):
        for first in range(0, len(some) if len(others) else 0, PAIRS // 512):
            part, best = some[first : first + PAIRS // 512], np.zeros((3, 0))
            for begin in range(0, len(others), PAIRS // 256):
                these = others[begin : begin + PAIRS // 256]
                j, i, score = similar(of(labels, these), of(asked, part), threshold)
                best = _first(np.concatenate((best, [part[i], these[j], score]), axis=1), k, groups)
            found.append(best)
    i, j, score = _first(np.concatenate(found, axis=1), k, groups)
    return i.astype(np.int64), j.astype(np.int64), score


def _first(found: np.ndarray, k: int, groups: np.ndarray | None) -> np.ndarray:
    """The k best of each asked text's (and group's) columns (asked, label, ratio)."""
    group = np.zeros(found.shape[1], int) if groups is None else groups[found[1].astype(int)]
    order = np.lexsort((found[1], -found[2], group, found[0]))
    found, group, at = found[:, order], group[order], np.arange(len(order))
    new = (np.diff(found[0], prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)
    return found[:, at - np.maximum.accumulate(np.where(new, at, 0)) < k]


#: Numbers of features; more features share numbers, which only lets more pairs through. Words that have their lowest bits.
FEATURES, LOW = 1 << 16, np.array([(1 << n) - 1 for n in range(65)], np.uint64)


class _Features:
    """Bits for a text's characters, as often as they stand there, or for its 2-grams."""

    def __init__(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: list[tuple[np.ndarray, np.ndarray]], words: int):
        """Features that some parts (characters, sizes) of texts have get columns of which each is set about equally often."""
        self.of = of
        counts = sum(np.bincount(of(*part).ravel(), minlength=FEATURES + 1)[:FEATURES] for part in parts)
        self.bit, heap = np.zeros((words, FEATURES + 1), np.uint64), [(0, c) for c in range(64 * words)]
        for f in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].tolist():
            load, c = heap[0]
            self.bit[c // 64, f] = 1 << c % 64
            heapq.heapreplace(heap, (load + int(counts[f]), c))
        self.strange = np.append(counts == 0, False)

    def bits(self, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and how many of its features no text of the parts has."""
        found = np.ascontiguousarray(self.of(place, sizes).T)
        out = np.zeros((len(self.bit), len(sizes)), np.uint64)
        for f in found:
            for word, bit in zip(out, self.bit, strict=True):
                word |= bit.take(f)
        return out, self.strange.take(found).sum(axis=0)

    def ends(self, place: np.ndarray, sizes: np.ndarray, back: bool) -> Callable[[int], np.ndarray]:
        """Bits of beginnings or ends of a size, of characters only."""
        found = np.ascontiguousarray(self.of(place, sizes, back).T)

        def of(size: int) -> np.ndarray:
            out = np.zeros(len(sizes), np.uint64)
            for p, f in enumerate(found if back else found[:size]):
                out |= np.where(sizes - p <= size, self.bit[0].take(f), 0) if back else self.bit[0].take(f)
            return out

        return of


def _chars(place: np.ndarray, sizes: np.ndarray, back: bool = False) -> np.ndarray:
    """A character and how many like it come before (or after) it."""
    place, at = np.ascontiguousarray(place.T), np.arange(place.shape[1])
    same = np.zeros(place.shape, np.uint8)
    for p in at.tolist():
        for other in range(p + 1, len(place)) if back else range(p):
            same[p] += place[p] == place[other]
    return np.where(at[:, None] < sizes, (place.astype(np.int32) * 64 + same) % FEATURES, FEATURES).T


def _pairs(place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place, base = place.astype(np.int64), max(256, 1 << int(place.max(initial=0)).bit_length())
    return np.where(np.arange(1, place.shape[1]) < sizes[:, None], (place[:, :-1] * base + place[:, 1:]) % FEATURES, FEATURES)


class _Index:
    """Labels of up to 64 characters in order of length, with bits of their characters and 2-grams."""

    def __init__(self, labels: list[str], groups: np.ndarray | None = None):
        self.groups = groups
        sizes = np.array([len(x) for x in labels])
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        texts = [labels[j] for j in self.order.tolist()]
        codes = [_codes(texts[a : a + 16384], int(self.sizes[min(a + 16384, len(texts)) - 1])) for a in range(0, len(texts), 16384)]
        self.alphabet = np.unique(np.concatenate([np.unique(x) for x in codes]))
        self.kind = np.min_scalar_type(len(self.alphabet) + 1)
        self.place = np.full((max(1, int(self.sizes[-1])), len(texts)), len(self.alphabet) + 1, self.kind)
        parts, a = [], 0
        for x in codes:
            b = a + len(x)
            parts.append((self.placed(x, self.sizes[a:b]), self.sizes[a:b]))
            self.place[: x.shape[1], a:b] = parts[-1][0].T
            a = b
        self.chars, self.grams = _Features(_chars, parts, 1), _Features(_pairs, parts, 2)
        self.by_chars, self.by_grams = (np.concatenate([f.bits(*part)[0] for part in parts], axis=1) for f in (self.chars, self.grams))
        self.by_chars = self.by_chars[0]
        self.many_chars = np.bitwise_count(self.by_chars)
        self.many_grams = np.bitwise_count(self.by_grams).sum(axis=0, dtype=np.uint8)
        self.same, self.shared, self.ok = np.empty(16384, np.uint64), np.empty(len(sizes), np.uint8), np.zeros(-(-len(sizes) // 8) * 8, bool)
        self.short, self.least, self.guess = self.sizes.astype(np.uint8), -1.0, 0.0
        self.of_ends = [[self.chars.ends(*part, back) for part in parts] for back in (False, True)]
        self.ends: dict[int, list[np.ndarray]] = {}

    def end(self, size: int) -> list[np.ndarray]:
        """Bits of the characters of the labels' beginnings and ends of a size."""
        if size not in self.ends:
            self.ends[size] = [np.concatenate([of(size) for of in parts]) for parts in self.of_ends]
        return self.ends[size]

    def placed(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Characters by their place in the alphabet; those of no label and what pads a text come after all others."""
        at = np.searchsorted(self.alphabet, codes).clip(0, len(self.alphabet) - 1)
        at = np.where(self.alphabet[at] == codes, at, len(self.alphabet))
        return np.where(np.arange(codes.shape[1]) < sizes[:, None], at, len(self.alphabet) + 1).astype(self.kind)

    def nearest(self, asked: list[str], k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As nearest(), for some texts. Pairs that can reach a guess of the k-th best ratio are compared; where it was too high, again
        from the k-th ratio found."""
        sizes = np.array([len(x) for x in asked])
        place = self.placed(_codes(asked, int(sizes.max())), sizes)
        tables = _Tables(self, place, sizes)
        chars, grams = self.chars.bits(place, sizes), self.grams.bits(place, sizes)
        own = [(np.bitwise_count(x).sum(axis=0, dtype=np.int64) + strange).tolist() for x, strange in (chars, grams)]
        ends = [np.array([of(size) for size in range(int(sizes.max()) + 1)]) for of in (self.chars.ends(place, sizes, back) for back in (False, True))]
        shorter = np.searchsorted(self.sizes, sizes, "right").tolist()

        def able(n: int, least: float) -> np.ndarray:
            """Labels that share characters and grams enough with a text for a ratio."""
            if least != self.least:
                self.least, self.allowed = least, _allowed(least)
                self.needed = self.many_chars - np.minimum(self.many_chars, self.allowed.chars.take(self.sizes))
            b, m, shared, ok, allowed = shorter[n], int(sizes[n]), self.shared, self.ok, self.allowed
            for a in range(0, len(shared), 16384):
                np.bitwise_and(self.by_chars[a : a + 16384], chars[0][0, n], out=self.same[: len(shared) - a])
                np.bitwise_count(self.same[: len(shared) - a], out=shared[a : a + 16384])
            np.greater_equal(shared[:b], self.needed[:b], out=ok[:b])
            np.greater_equal(shared[b:], max(0, own[0][n] - int(allowed.chars[m])), out=ok[b : len(shared)])
            eight = np.flatnonzero(ok.view(np.uint64))  # most have none
            at = np.flatnonzero(ok.reshape(-1, 8).take(eight, axis=0))
            at = (eight << 3).take(at >> 3) + (at & 7)
            lost = self.many_grams.take(at)
            lost[(c := int(at.searchsorted(b))) :] = own[1][n]
            for word, x in zip(self.by_grams, grams[0][:, n], strict=True):
                lost -= np.bitwise_count(word.take(at) & x)
            size = np.minimum(self.short.take(at), m)
            ok = (lost <= allowed.grams.take(size)).nonzero()[0]
            at, lost, size, c = at.take(ok), lost.take(ok), size.take(ok), int(ok.searchsorted(c))
            missed = self.many_chars.take(at)
            missed[c:] = own[0][n]
            missed -= shared.take(at)
            ok = (missed <= allowed.full_chars.take(size)) & (lost <= allowed.full_grams.take(size))
            least_size, most = allowed.size.take(size[:c]), allowed.beyond.take(size)
            bits, given = ~self.by_chars.take(at[:c]), ~chars[0][0, n]
            for end, label_end in zip(ends, self.end(int(allowed.size[m])) if c < len(at) else (None, None), strict=True):
                ok[:c] |= np.bitwise_count(end[:, n].take(least_size) & bits) < most[:c]
                if c < len(at):
                    ok[c:] |= np.bitwise_count(label_end.take(at[c:]) & given) < most[c:]
            return at[ok]

        def reached(found: np.ndarray, low: np.ndarray) -> np.ndarray:
            """The k-th best ratio where it is over the low one."""
            if self.groups is not None:
                return low
            out, last = low.copy(), np.flatnonzero(np.arange(found.shape[1]) - np.searchsorted(found[0], found[0]) == k - 1)
            of = found[0][last].astype(int)
            out[of] = np.maximum(out[of], found[2][last])
            return out

        floor = np.full(len(asked), float(threshold))
        out, which, low = [np.zeros((3, 0))], np.arange(len(asked)), np.full(len(asked), max(threshold, self.guess))
        while len(which):
            found, waiting, n = np.zeros((3, 0)), [], 0
            for x in [*which.tolist(), None]:
                if x is not None:
                    at = able(x, low[x])
                    waiting.append((np.full(len(at), x), at))
                    n += len(at)
                if n and (x is None or n >= PAIRS // 16):
                    i, j, score = tables.ratios(*(np.concatenate(v) for v in zip(*waiting, strict=True)), low)
                    keep = score >= threshold
                    found = _first(np.concatenate((found, [i[keep], self.order[j[keep]], score[keep]]), axis=1), k, self.groups)
                    waiting, n = [], 0
            of = found[0].astype(int)
            done = (np.bincount(of, found[2] >= low[of], len(asked)) >= k) | (low <= threshold)
            out.append(found[:, done[of]])
            low, which = reached(found, floor), which[~done[which]]
        i, j, score = found = _first(np.concatenate(out, axis=1), k, self.groups)
        self.guess = float(np.percentile(reached(found, floor), 8))
        return i.astype(int), j.astype(int), score


class _Allowed(NamedTuple):
    """What may be missing by the length of the shorter text: characters and grams for any window; for windows of its length;
    the length of the shortest windows, and one more than the characters any shorter window may have beyond the common ones."""

    chars: np.ndarray
    grams: np.ndarray
    full_chars: np.ndarray
    full_grams: np.ndarray
    size: np.ndarray
    beyond: np.ndarray


def _allowed(least: float) -> _Allowed:
    """A window of w characters and a text of m with a common subsequence of l have a ratio of 2 l / (m + w). Each of the m - l
    characters that are left out of the text breaks 2 of its grams at most, and each of the w - l that are put between its
    characters 1. Windows of fewer than m characters begin or end the longer text, and so do the shortest of these."""
    m, w = np.arange(65)[:, None], np.arange(65)
    l = np.ceil((least / 100 - 1e-9) * (m + w) / 2 - 1e-6).astype(int)
    fits, full = (w <= m) & (l <= w), w == m
    most = lambda x, of: np.where(of, x, 0).max(axis=1).astype(np.uint8)
    size = np.where(fits, w, 64).min(axis=1)
    return _Allowed(most(m - l, fits), most(2 * (m - l) + w - l, fits), most(m - l, full), most(3 * (m - l), full), size, most(w - l + 1, fits & ~full))


class _Tables:
    """Common subsequences of asked texts and labels by bits of the asked ones, of which each has its characters' masks."""

    def __init__(self, index: _Index, place: np.ndarray, sizes: np.ndarray):
        self.index, self.sizes = index, sizes
        self.stride = len(index.alphabet) + 2
        self.masks, self.turned = (np.zeros((len(sizes), self.stride), np.uint64) for _ in range(2))
        for p in range(place.shape[1]):
            of = np.flatnonzero((sizes > p) & (place[:, p] < len(index.alphabet)))
            self.masks[of, place[of, p]] |= np.uint64(1 << p)
            self.turned[of, place[of, p]] |= np.uint64(1) << (sizes[of] - 1 - p).astype(np.uint64)
        self.masks, self.turned = self.masks.ravel(), self.turned.ravel()

    def ratios(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that can have the least ratio, by the common subsequences of whole texts, and their ratios."""
        kept = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64))]
        order = np.sort(-j << 32 | np.arange(len(j)))  # in falling order of length, and a chunk's characters lie near each other
        order &= (1 << 32) - 1
        i, j = i[order], j[order]
        for a in range(0, len(i), CHARS // 64):
            x, y = i[a : a + CHARS // 64], j[a : a + CHARS // 64]
            m, n = self.sizes[x], self.index.sizes[y]
            t = least[x] / 100 - 1e-9
            need = np.ceil(np.minimum(m, n) * t / (2 - t) - 1e-6).astype(np.int64)
            row, base = np.full(len(x), LOW[64]), x * self.stride
            most, live = int(n[0]) if len(n) else 0, _longer(n)
            for p in range(most):
                if p in (most // 2, most * 3 // 4):  # what is missed already can't be made good
                    ok = np.flatnonzero(m - np.bitwise_count(row & LOW[m]) + (n - p).clip(0) >= need)
                    x, y, m, n, need, row, base = (v[ok] for v in (x, y, m, n, need, row, base))
                    live = _longer(n)
                    if not len(n) or p >= n[0]:
                        break
                c = live[p]
                step(row[:c], self.masks.take(base[:c] + self.index.place[p].take(y[:c])))
            common = m - np.bitwise_count(row & LOW[m])
            ok = np.flatnonzero(common >= need)
            kept.append((x[ok], y[ok], common[ok], row[ok]))
        x, y, common, row = (np.concatenate(v) for v in zip(*kept, strict=True))
        return x, y, self.windows(x, y, common, row, least[x])

    def windows(self, x: np.ndarray, y: np.ndarray, common: np.ndarray, whole: np.ndarray, least: np.ndarray) -> np.ndarray:
        """best_window_ratio() of pairs in falling order of the labels' lengths, whose rows for whole texts are given; one below the
        least may get less than its ratio."""
        m, n = self.sizes[x], self.index.sizes[y]
        t = least / 100 - 1e-9
        out = np.where((m == 0) & (n == 0), 100.0, 0.0)
        for within in (True, False):  # windows of the asked text, or of the label
            of = np.flatnonzero((n <= m) == within)
            if not len(of):
                continue
            base, text, a, b = x[of] * self.stride, y[of], m[of], n[of]
            best, live, size = out[of], _longer(b), np.minimum(a, b)
            low, floor = LOW[a], max(1, int((size * t[of] / (2 - t[of])).min()))  # shorter windows can't have the least
            for turn, masks in ((False, self.masks), (True, self.turned)):  # from the beginnings, from the ends
                row = whole[of] if within and not turn else np.full(len(of), LOW[64])
                for p in range(0 if within and not turn else int(b[0])):
                    c = live[p]
                    at = self.index.place[b[:c] - 1 - p, text[:c]] if turn else self.index.place[p].take(text[:c])
                    step(row[:c], masks.take(base[:c] + at))
                    if not within and p + 1 >= floor:
                        ratio = 200.0 * (a[:c] - np.bitwise_count(row[:c] & low[:c])) / (a[:c] + (p + 1))
                        np.maximum(best[:c], ratio, out=best[:c], where=a[:c] > p)
                if within:
                    for w in range(floor, int(b[0]) + 1):
                        c = live[w - 1]
                        np.maximum(best[:c], 200.0 * (w - np.bitwise_count(row[:c] & LOW[w]).astype(np.int64)) / (b[:c] + w), out=best[:c])
            out[of] = best
            of = np.flatnonzero((common[of] >= size * t[of] - 1e-6) & (np.abs(a - b) > 1) & (size > 0))
            base, text, size, times, of = base[of], text[of], size[of], np.abs(a - b)[of] - 1, np.flatnonzero((n <= m) == within)[of]
            pair = np.repeat(np.arange(len(of)), times)
            start = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + 1
            order = np.argsort(64 - size[pair].astype(np.uint8), kind="stable")
            for first in range(0, len(pair), CHARS // 64):
                z, o = pair[order[first : first + CHARS // 64]], start[order[first : first + CHARS // 64]]
                begin, label, length, shift = base[z], text[z], size[z], o.astype(np.uint64)
                row, live = np.full(len(z), LOW[64]), _longer(length)
                for p in range(int(length[0])):
                    c = live[p]
                    if within:
                        mask = self.masks.take(begin[:c] + self.index.place[p].take(label[:c])) >> shift[:c]
                    else:
                        mask = self.masks.take(begin[:c] + self.index.place[o[:c] + p, label[:c]])
                    step(row[:c], mask)
                np.maximum.at(out, of[z], 200.0 * (length - np.bitwise_count(row & LOW[length])) / (length + length))
        return out


def _longer(n: np.ndarray) -> list[int]:
    """How many of some numbers up to 64, which fall, are over 0, 1, .."""
    return np.cumsum(np.bincount(n, minlength=66)[::-1])[::-1][1:].tolist()


def step(row: np.ndarray, mask: np.ndarray) -> None:
    """A character more, in place: bits of a text's characters are 0 where they lengthen the common subsequence."""
    mask &= row
    rest = row - mask
    row += mask
    row |= rest
