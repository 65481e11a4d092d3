"""Hash sets of word shingles of whole texts, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import text_buffers


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, text after text, and the n + 1 places where a text's words begin and end.

    A word is a run of bytes other than ASCII blanks. Its hash is a polynomial in its bytes, read off a running sum.
    """
    raw, places = text_buffers(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(places), np.int64)
    blank = _BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[places] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    hashes = _spread((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, places)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct hashes, ascending, of each text's runs of so many words; of the whole sequence if it has fewer words;
    none without words."""
    hashes, places = word_hashes(texts)
    step, out = np.uint64(0xFF51AFD7ED558CCD), []
    chain = hashes.copy()
    for k in range(1, words):
        chain = _spread(chain[: len(hashes) - k] * step + hashes[k:]) if len(hashes) > k else chain[:0]
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(chain[a : b - words + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for x in hashes[a:b]:
                value = _spread(value * step + x)
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit number that equal sets share."""
    a, b = _spread(hashes + np.uint64(0x51)).sum(dtype=np.uint64), _spread(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(_spread(np.array([a], np.uint64) + _spread(np.array([b], np.uint64))).view(np.int64)[0])


class Classes:
    """Size classes of sets and the parts whose equality similar sets share (an exact pigeonhole scheme).

    similar: den x intersection >= num x union. Sets of one class differ from partners in it, or in the class below, by at
    most D elements; the hash range is cut into D + need + spare parts, so at least need + spare parts are equal in both. A
    set emits a number for each part that isn't empty, and for its empty parts only if it has more than ``spare``: then two
    similar sets have at least ``need`` numbers of one class in common. The low bits of a number tell its class and half its need, which is odd, rounded up;
    HASH_BITS above them are mixed: numbers that are equal by chance cost work, and no link.
    """

    NEED_BITS, CLASS_BITS, HASH_BITS = 4, 10, 44

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]
        self.known: dict[int, tuple[int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, (last - 1) * self.den // self.num + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def parts(self, of: int) -> tuple[int, int, int]:
        """(parts, spare, need) of a class; one part stands for equality of the whole set, which needs no search."""
        if of not in self.known:
            while of + 1 >= len(self.starts):
                self.of(self.starts[-1])
            least, most = self.starts[of], self.starts[of + 1] - 1
            apart = (self.den - self.num) * 2 * most // (self.num + self.den)
            need = 1 + 2 * min(14, least // 40)
            empty = lambda spare: (apart + need + spare) * np.exp(-least / (apart + need + spare))
            spare = next((x for x in range(least) if x >= empty(x) + 2 * np.sqrt(empty(x))), 0)  # any value is exact
            self.known[of] = (apart + need + spare, spare, need) if apart else (1, 0, 1)
        return self.known[of]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """What the set emits, as a member of its own class and as the smaller partner of the class above."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        own, out = self.of(len(hashes)), []
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(_spread(hashes + np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
        high = hashes >> np.uint64(32)
        mixed = np.uint64((1 << self.HASH_BITS) - 1 << self.NEED_BITS + self.CLASS_BITS)
        for k in (own, own + 1):
            parts, spare, need = self.parts(k)
            if parts == 1:
                continue
            places = np.searchsorted(high, -(-(np.arange(parts + 1) << 32) // parts).astype(np.uint64))
            empty = places[1:] == places[:-1]
            value = _spread(sums[places[1:]] - sums[places[:-1]] + np.arange(parts, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))
            value = value & mixed | np.uint64((k % (1 << self.CLASS_BITS)) << self.NEED_BITS | need // 2 + 1)
            out.append(value if empty.sum() > spare else value[~empty])
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least intersection with which sets of these sizes are similar."""
    return -(-num * (a + b) // (num + den))


class Search:
    """T-occurrence search (DivideSkip) over sets held in memory, and the links it finds as a forest.

    The inverted list of a hash names the sets that hold it. A query of n hashes wants the sets on at least T of its n
    lists. Its L longest lists are set aside; merging the short ones keeps the sets that occur T - L times there; those are
    looked up in the long lists by binary search, and kept where they reach the overlap that both sizes ask for. The short
    lists are sorted runs, so the merge is one stable sort over them, which counts as a heap of their heads would. Sets are
    numbered by size, so the ones too small or too large for a query are left out of its lists.
    """

    #: Long lists that are probed at once.
    PROBES = 64

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        lengths = np.array([len(x) for x in sets], np.int64)
        self.order = np.argsort(lengths, kind="stable")
        self.sizes = lengths[self.order]
        # Arrays as long as all sets together go as soon as they have served.
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) < 1 << 16 else np.int64), self.sizes)
        hashes = np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.lists, hashes = owners[order], hashes[order]
        del owners, order
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.keys, self.first = hashes[first], np.append(first, len(hashes))
        del hashes, first
        # Where a set is in a list, as one ascending number.
        self.places = np.cumsum(fresh)
        self.places -= 1
        self.places *= len(sets)
        self.places += self.lists

    def similar(self, query: np.ndarray) -> np.ndarray:
        """The sets similar to the query, which may be one of them."""
        n, none = len(query), np.zeros(0, np.int64)
        if not n or not len(self.keys):
            return none
        least = -(-self.num * n // self.den)
        low, high = np.searchsorted(self.sizes, [least, self.den * n // self.num + 1])
        at = np.searchsorted(self.keys, query)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == query]
        if len(at) < least or low == high:
            return none
        lengths = self.first[at + 1] - self.first[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        aside = min(least - 1, int(least / (0.01 * np.log2(lengths[-1] + 1) + 1)))
        short, long, lengths = at[: len(at) - aside], at[len(at) - aside :], lengths[: len(at) - aside]
        ends = np.cumsum(lengths)
        merged = self.lists[np.repeat(self.first[short] - ends + lengths, lengths) + np.arange(ends[-1])]
        merged = np.sort(merged[(merged >= low) & (merged < high)], kind="stable").astype(np.int64)
        if not len(merged):
            return none
        edges = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found, counts = merged[edges], np.diff(np.append(edges, len(merged)))
        need = -(-self.num * (n + self.sizes[found]) // (self.num + self.den))
        for k in range(0, aside + 1, self.PROBES):
            keep = counts + (aside - k) >= need
            found, counts, need = found[keep], counts[keep], need[keep]
            probe = long[k : k + self.PROBES]
            if not len(found) or not len(probe):
                break
            wanted = probe[:, None] * len(self.sets) + found
            spot = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            counts = counts + (self.places[spot] == wanted).sum(0)
        return self.order[found[counts >= need]]

    def forest(self, labels: list) -> list[tuple[int, int]]:
        """Links that, with sets of one label taken as linked, leave any two sets that a chain of links joins joined.

        A link that is still missing has an end outside the largest component, so only those sets are queries.
        """
        root, links, asked = list(range(len(self.sets))), [], [False] * len(self.sets)

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        weight = [1] * len(self.sets)
        largest = 0

        def join(a: int, b: int) -> bool:
            nonlocal largest
            a, b = top(a), top(b)
            if a == b:
                return False
            if weight[a] < weight[b]:
                a, b = b, a
            root[b] = a
            weight[a] += weight[b]
            if weight[a] > weight[top(largest)]:
                largest = a
            return True

        seen: dict = {}
        for i, label in enumerate(labels):
            join(i, seen.setdefault(label, i))
        def ask(i: int) -> None:
            asked[i] = True
            links.extend((i, int(j)) for j in self.similar(self.sets[i]) if join(i, int(j)))

        if self.sets:
            ask(0)
        while rest := [i for i in range(len(self.sets)) if not asked[i] and top(i) != top(largest)]:
            for i in rest:
                if top(i) != top(largest):
                    ask(i)
        return links
