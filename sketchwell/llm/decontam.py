"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Symbols are the bytes of letters and digits, A-Z lowered; white space and ASCII punctuation count for nothing. A
text holds a passage of an item of n symbols if some window of it, of the item's size but for the edits, is within
`max_edits` * n edits of the item.

A CGK walk reads symbols from left to right; at each step a random bit of the current symbol decides whether to
advance. Two strings of small edit distance soon walk in step again, so their embeddings differ in few places
(Hamming). A hash samples some coordinates of a stretch of the embedding; an item-sized window has as many of them
as it has starts on the grid of the texts, times the repeats. Grid, length of the stretch and repeats are the
cheapest for which edited copies of items of that length class, at the largest distance still kept, meet with
probability `target`: found by simulation (`plan_for`), by length alone. Met windows must share as many q-grams with the item as
nearly all edited copies do, and are then verified exactly: the smallest edit distance of the item to any substring
near the window (bit-parallel, all symbols).

Items of fewer than `least` symbols are found only as exact runs of whole words. Items go through in blocks of about
`block_symbols` symbols, each broadcast and held against all texts: any number of items, one way at every size.

Null and blank texts and items without symbols match nothing; items without an id are left out; a document without
an id gives rows of its own (all such documents share them). Ties: the smallest distance, then the first place.
Repeated rows of documents or items: one row per pair of ids. Texts of any length, whole; no windows are skipped.
Empty tables: no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.llm.common import fresh, mix, reachable, slices, text_bytes


@dataclass(frozen=True)
class CgkOptions:
    """max_edits is the share of an item's symbols; target the recall at that distance. The rest is derived or bounds work."""

    max_edits: float = 0.2
    target: float = 0.9
    least: int = 16
    gram: int = 4
    asked: int = 128
    seed: int = 7
    block_symbols: int = 1 << 20


#: Steps of a walk, coordinates sampled, grid of starts, repeats: cheapest first.
STEPS = ((24, 12, 6, 1), (20, 10, 6, 1), (24, 12, 3, 1), (20, 10, 3, 1), (16, 9, 3, 1), (24, 12, 1, 1), (20, 10, 1, 1), (16, 9, 1, 1), (16, 8, 1, 2), (12, 7, 1, 3))
#: Length classes by their least number of symbols.
CLASSES = (16, 20, 26, 34, 44, 56, 72, 92, 120, 156, 200, 260)
BUCKETS = 1 << 13

_SYMBOL = np.array([(c | 32 if 65 <= c < 91 else c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 0 for c in range(256)], np.uint8)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Walk:
    """A CGK walk of so many steps and the coordinates it samples. Symbol 0 ends a text: the walk stays there."""

    def __init__(self, steps: int, samples: int, number: int, seed: int):
        rng = np.random.default_rng([seed, steps, samples, number])
        self.steps = steps
        self.sampled = np.zeros(steps, bool)
        self.sampled[rng.choice(steps, samples, replace=False)] = True
        self.bits = rng.integers(0, 2, (steps, 256)) if samples < steps else np.ones((steps, 256), np.int64)
        self.bits[:, 0] = 0
        self.value = rng.integers(1, 1 << 62, 256, dtype=np.int64).view(np.uint64)

    def hashes(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """symbols ends with a 0. Walks that read a 0 have their end, not what follows, in their hash."""
        return self.run(symbols, starts)[0]

    def run(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and the last symbol that each walk reads; starts ascend."""
        out, end = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
        for a in range(0, len(starts), 1 << 15):  # what lies near is walked together, in the caches
            i = starts[a : a + (1 << 15)].astype(np.int64)
            low = int(i[0])
            near = symbols[low : int(i[-1]) + self.steps + 1].astype(np.int64)
            i, h = i - low, np.zeros(len(i), np.uint64)
            for j in range(self.steps):
                c = near.take(i)
                if self.sampled[j]:
                    h *= _MUL
                    h += self.value.take(c)
                if j + 1 < self.steps:
                    i += self.bits[j].take(c)
            out[a : a + len(i)], end[a : a + len(i)] = mix(h), c
        return out, end


def walk_of(steps: int, samples: int, number: int, seed: int) -> Walk:
    return _walks(steps, samples, number, seed)


_walks = lru_cache(maxsize=64)(Walk)


def symbols_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Symbols of texts, each followed by a 0; where each lies in raw; where each text starts, and where the last ends."""
    n = _SYMBOL.take(raw)
    at = np.flatnonzero(n)
    first = np.searchsorted(at, np.r_[starts, ends[-1:]])
    to = np.repeat(np.arange(len(starts)), np.diff(first))
    to += np.arange(len(at))
    out, place = np.zeros(len(at) + len(starts), np.uint8), np.zeros(len(at) + len(starts), np.int64)
    out[to], place[to] = n.take(at), at
    first += np.arange(len(starts) + 1)
    place[first[1:] - 1] = ends  # the ends
    return out, place, first


def gram_buckets(symbols: np.ndarray, q: int) -> np.ndarray:
    out = np.empty(max(0, len(symbols) - q + 1), np.int32)
    for a in range(0, len(out), 1 << 14):  # in the caches
        part = symbols[a : a + (1 << 14) + q - 1].astype(np.uint64)
        h = np.zeros(len(part) - q + 1, np.uint64)
        for k in range(q):
            h *= _MUL
            h += part[k : k + len(h)]
            h += np.uint64(1)
        out[a : a + len(h)] = mix(h) & np.uint64(BUCKETS - 1)
    return out


def asked_grams(size: int, o: CgkOptions) -> np.ndarray:
    """Places of the q-grams of a window that are looked up: `asked` of them at most, evenly spread."""
    n = max(1, size - o.gram + 1)
    return np.arange(min(n, o.asked)) * n // min(n, o.asked)


def edited(s: np.ndarray, edits: int, rng) -> np.ndarray:
    """s with so many edits at random places: a third each replaced, inserted and removed."""
    out = [bytes([c]) for c in s.tolist()]
    for i in rng.choice(len(s), edits, replace=False).tolist():
        new = bytes([97 + int(rng.integers(26))])
        out[i] = (new, out[i] + new, b"")[int(rng.integers(3))]
    return np.frombuffer(b"".join(out), np.uint8)


@lru_cache(maxsize=256)
def plan_for(size: int, o: CgkOptions, trials: int = 500) -> tuple[int, int, int, int, float]:
    """(steps, samples, grid, repeats, share of q-grams) for items of `size` symbols and more: simulated copies with
    the most edits that are kept, between other symbols, at any place of the grid."""
    rng = np.random.default_rng(o.seed)
    letters = lambda n: rng.integers(97, 117, n).astype(np.uint8)
    items = [letters(size) for _ in range(trials)]
    copies = [edited(x, int(o.max_edits * size), rng) for x in items]
    share = []
    for x, y in zip(items, copies):
        held = np.zeros(BUCKETS, bool)
        held[gram_buckets(x, o.gram)] = True
        at = asked_grams(size, o)
        share.append(held[gram_buckets(np.append(y, np.zeros(size, np.uint8)), o.gram)[at]].mean())
    least = float(np.quantile(share, 0.02))
    texts = [np.concatenate([letters(int(rng.integers(24, 48))), y, letters(24), [0]]).astype(np.uint8) for y in copies]
    one = np.concatenate([np.append(x, 0) for x in items]).astype(np.uint8)
    two, of = np.concatenate(texts), np.repeat(np.arange(trials), [len(t) for t in texts])
    place = np.arange(len(two)) - np.repeat(np.cumsum([0, *(len(t) for t in texts[:-1])]), [len(t) for t in texts])
    for steps, samples, grid, repeats in STEPS:
        met = np.zeros(trials, bool)
        for k in range(repeats):
            w = walk_of(steps, samples, k, o.seed)
            a, last = w.run(one, np.flatnonzero(one))
            a = (a ^ np.repeat(np.arange(trials, dtype=np.uint64), size))[last > 0]
            on = (place % grid == 0) & (two > 0)
            b = w.hashes(two, np.flatnonzero(on)) ^ of[on].astype(np.uint64)
            met[of[on][np.isin(b, a)]] = True
        if met.mean() * 0.98 >= o.target + 0.04:  # 0.98: the q-grams; 0.04: the error of the simulation and of like lengths
            break
    return steps, samples, grid, repeats, least


def fit_distance(item, text) -> tuple[int, int]:
    """Smallest edit distance of item to a substring of text, and where the first such ends. Bit-parallel over
    the item, one step per symbol of the text."""
    m = len(item)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score, best, at = full, 0, m, m, 0
    for k, c in enumerate(text):
        e = eq.get(c, 0)
        x = e | down
        d = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d | up)), d & up
        score += 1 if right & top else -1 if left & top else 0
        right, left = right << 1 & full, left << 1 & full  # a match may start anywhere: no carry into row 0
        up, down = left | (full & ~(x | right)), right & x
        if score < best:
            best, at = score, k + 1
    return best, at


def fit_many(items: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """fit_distance of many pairs at once: a row of 64-bit words for each 64 symbols of the items, a column for each pair."""
    number = {x: k for k, x in enumerate(dict.fromkeys(items))}
    wide = max(1, -(-max(map(len, items)) // 64))
    eq = np.zeros((wide, len(number), 256), np.uint64)
    for x, k in number.items():
        for i, c in enumerate(x):
            eq[i >> 6, k, c] |= np.uint64(1 << (i & 63))
    u, m = np.array([number[x] for x in items]), np.array([len(x) for x in items])
    n = np.array([len(t) for t in texts])
    grid = np.zeros((int(n.max()), len(texts)), np.uint8)
    for k, t in enumerate(texts):
        grid[: len(t), k] = np.frombuffer(t, np.uint8)
    word, bit, one = (m - 1) >> 6, ((m - 1) & 63).astype(np.uint64), np.uint64(1)
    each, high = np.arange(len(m)), np.uint64(63)
    up, down = np.full((wide, len(m)), ~np.uint64(0)), np.zeros((wide, len(m)), np.uint64)
    score, best, at = m.copy(), m.copy(), np.zeros(len(m), np.int64)
    for k, c in enumerate(grid):
        x = eq[:, u, c] | down
        t = x & up
        d = t + up
        over = d < t  # carries go on to the next word
        for w in range(1, wide):
            d[w] += over[w - 1]
            over[w] |= over[w - 1] & (d[w] == 0)
        d = (d ^ up) | x
        right, left = down | ~(d | up), d & up
        score += ((right[word, each] >> bit) & one).astype(np.int64) - ((left[word, each] >> bit) & one).astype(np.int64)
        out = right >> high, left >> high
        right, left = right << one, left << one
        right[1:] |= out[0][:-1]
        left[1:] |= out[1][:-1]
        up, down = left | ~(x | right), right & x
        better = (score < best) & (k < n)
        best[better], at[better] = score[better], k + 1
    return best, at


class Index:
    """A block of items: symbols, q-grams, and per walk the sorted hashes with item and place."""

    def __init__(self, ids: list[int], texts: list[bytes], o: CgkOptions):
        found = {}
        for i, t in zip(ids, texts):
            n = _SYMBOL[np.frombuffer(t, np.uint8)]
            if n.any():
                found[i, n[n > 0].tobytes()] = n[n > 0]
        self.o, self.ids = o, [i for i, _ in found]
        self.items = list(found.values())
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.shares = np.zeros(len(self.items))
        self.grams = np.zeros((len(self.items), BUCKETS // 8), np.uint8)
        parts: dict[tuple, list] = {}
        for k, x in enumerate(self.items):
            if len(x) < o.least:
                parts.setdefault((len(x), len(x), 0, 0), []).append((k, x, np.zeros(1, np.int64)))
                continue
            steps, samples, grid, repeats, self.shares[k] = plan_for(max(c for c in CLASSES if c <= max(len(x), CLASSES[0])), o)
            held = np.zeros(BUCKETS, bool)
            held[gram_buckets(x, o.gram)] = True
            self.grams[k] = np.packbits(held)
            for r in range(repeats):
                parts.setdefault((steps, samples, r, grid), []).append((k, x, np.arange(len(x))))
        self.asked = np.full((len(self.items), o.asked), -1, np.int64)  # -1: fewer than `asked`
        for k in np.flatnonzero(self.shares):
            places = asked_grams(int(self.sizes[k]), o)
            self.asked[k, : len(places)] = places
        self.reach = self.asked.max(axis=1, initial=0)
        self.least = self.shares * (self.asked >= 0).sum(axis=1)
        self.tables = {}  # by (steps, samples, repeat, grid); grid 0: starts of words
        for kind, rows in parts.items():
            base = np.cumsum([0, *(len(x) + 1 for _, x, _ in rows[:-1])])
            every = np.concatenate([np.append(x, 0) for _, x, _ in rows]).astype(np.uint8)
            at = np.concatenate([s for _, _, s in rows])
            item = np.repeat([k for k, _, _ in rows], [len(s) for _, _, s in rows])
            h, last = walk_of(*kind[:3], o.seed).run(every, at + np.repeat(base, [len(s) for _, _, s in rows]))
            h, item, at = h[last > 0], item[last > 0], at[last > 0]  # a walk beyond an item's end would meet the ends of texts
            order = np.lexsort((at, item, h))
            seen = np.zeros(1 << max(16, (16 * len(h)).bit_length()), bool)
            seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)] = True
            self.tables[kind] = h[order], item[order].astype(np.int32), at[order].astype(np.int32), np.packbits(seen)

    def hits(self, s: np.ndarray, place: np.ndarray, first: np.ndarray, most: int = 1 << 16):
        """Met windows of texts of symbols s: arrays (item, start of the window in s), bounded parts."""
        if any(not kind[3] for kind in self.tables):
            new = np.r_[True, place[1:] != place[:-1] + 1]
            new[first[:-1]] = True  # words start here
            new |= s == 0
        walked: dict[tuple, tuple] = {}
        for kind, (h, item, at, packed) in sorted(self.tables.items()):  # of one walk the finest grid comes first
            if not kind[3]:
                starts = np.flatnonzero(new & (s > 0))
                ends = starts + kind[0]
                starts = starts[ends < len(s)]
                starts = starts[new[starts + kind[0]]]
                got = walk_of(*kind[:3], self.o.seed).hashes(s, starts)
            elif kind[:3] in walked:  # each grid is part of the finer ones
                starts, own, got = walked[kind[:3]]
                on = own % kind[3] == 0
                starts, got = starts[on], got[on]
            else:
                n = -(-(np.diff(first) - 1) // kind[3])  # starts of each text
                own = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * kind[3]
                starts = own + np.repeat(first[:-1], n)
                got = walk_of(*kind[:3], self.o.seed).hashes(s, starts)
                walked[kind[:3]] = starts, own, got
            bit = (got & np.uint64(8 * len(packed) - 1)).astype(np.int64)
            on = np.flatnonzero(packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            lo = np.searchsorted(h, got[on], "left")
            known = h.take(lo, mode="clip") == got[on]
            on, lo = on[known], lo[known]
            n = np.searchsorted(h, got[on], "right") - lo
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]) if len(ends) else 0, most):  # postings of frequent hashes, part by part
                each = np.arange(a, min(a + most, int(ends[-1])))
                k = np.searchsorted(ends, each, "right")
                p = lo[k] + each - (ends[k] - n[k])
                yield item[p], starts[on[k]] - at[p]

    def likely(self, item: np.ndarray, start: np.ndarray, row: np.ndarray, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Which windows share as many q-grams with their items as `least` asks; item ascends."""
        out = np.empty(len(item), bool)
        for a in range(0, len(item), 1 << 9):  # in the caches
            k, x, r = item[a : a + (1 << 9)], start[a : a + (1 << 9)], row[a : a + (1 << 9)]
            new = np.r_[True, k[1:] != k[:-1]]
            held = np.unpackbits(self.grams[k[new]], axis=1).ravel()
            lo, hi = first[r], first[r + 1] - 1
            at = self.asked.take(k, axis=0)
            part = np.flatnonzero((x < lo) | (x + self.reach[k] >= hi) | (at[:, -1] < 0))  # windows over the ends of texts
            some = at[part]
            some[some < 0] = len(buckets)  # in no text
            some += x[part, None]
            gone = (some < lo[part, None]) | (some >= hi[part, None])
            at += x[:, None]
            at = buckets.take(at, mode="clip")
            at += ((np.cumsum(new) - 1) * BUCKETS)[:, None]
            got = held.take(at)
            got[part] &= ~gone
            out[a : a + len(k)] = got.sum(axis=1, dtype=np.int32) >= self.least[k]
        return out

    def stretches(self, s: np.ndarray, place: np.ndarray, first: np.ndarray):
        """(row, item, from, to): stretches of the symbols s in which an item may lie."""
        buckets = gram_buckets(np.append(s, np.zeros(self.o.gram, np.uint8)), self.o.gram).astype(np.int64)
        wanted = [np.empty(0, np.int64)]
        for item, start in self.hits(s, place, first):
            keys = np.sort(item.astype(np.int64) << 32 | start + (1 << 31))  # by item, then by place
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
            item, start = keys >> 32, (keys & (1 << 32) - 1) - (1 << 31)
            row = np.searchsorted(first, np.clip(start + self.sizes[item] // 2, 0, len(s) - 1), "right") - 1
            wanted.append(keys[self.likely(item, start, row, first, buckets)])
        keys = np.unique(np.concatenate(wanted))
        item, start = keys >> 32, (keys & (1 << 32) - 1) - (1 << 31)
        row = np.searchsorted(first, np.clip(start + self.sizes[item] // 2, 0, len(s) - 1), "right") - 1
        spans: list[list[int]] = []
        for r, k, x in sorted(zip(row.tolist(), item.tolist(), start.tolist())):
            edits, n = self.edits(k), int(self.sizes[k])
            lo, hi = max(int(first[r]), x - edits), min(int(first[r + 1]) - 1, x + n + edits)
            if spans and spans[-1][:2] == [r, k] and lo <= spans[-1][2] + 2 * edits:
                spans[-1][3] = max(spans[-1][3], hi)
            else:
                spans.append([r, k, lo, hi])
        return spans

    def matches(self, stretches: list[tuple[int, bytes]]):
        """(which, distance, end) of the (item, symbols) within the bound; the longest of those that go together have
        most of their symbols in use."""
        order = sorted(range(len(stretches)), key=lambda i: (self.sizes[stretches[i][0]] - 1 >> 6, len(stretches[i][1])))
        while order:
            most = 1
            while most < min(len(order), 1024) and len(stretches[order[most]][1]) <= 2 * len(stretches[order[0]][1]) and (most + 1) * len(stretches[order[most]][1]) <= 1 << 22:
                most += 1
            part, order = order[:most], order[most:]
            found = fit_many([self.items[stretches[i][0]].tobytes() for i in part], [stretches[i][1] for i in part])
            for i, d, end in zip(part, *(x.tolist() for x in found)):
                if d <= self.edits(stretches[i][0]):
                    yield i, d, end

    def edits(self, item: int) -> int:
        return int(self.o.max_edits * self.sizes[item]) if self.sizes[item] >= self.o.least else 0


_FOUND = "doc_id long, item_id long, distance long, item_symbols long, ends_at long"


def _blocks(items: DataFrame, o: CgkOptions):
    """Blocks of items (ids, texts) of about block_symbols bytes; items are told apart by id and text."""
    known = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    count = -(-total // o.block_symbols)
    for k in range(count):
        t = known.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(count)) == k).toArrow()
        yield t.column(0).to_pylist(), [x.encode("utf-8", "surrogatepass") for x in t.column(1).to_pylist()]


def contaminated(docs: DataFrame, items: DataFrame, o: CgkOptions | None = None) -> DataFrame:
    """(doc_id, item_id, distance, item_symbols, ends_at): passages of items in docs(doc_id, text), one row per pair;
    ends_at is the place in the text, in bytes of UTF-8, where the first best match ends."""
    o = o or CgkOptions()
    spark = reachable(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])

    def against(ids, texts):
        sent = spark.sparkContext.broadcast(Index(ids, texts, o))

        def run(batches):
            fresh("decontamination")
            index = sent.value
            held: list[tuple] = []  # stretches of several batches are verified together: (id, item, symbols, their ends in the text)

            def verified():
                got = [(held[i][0], held[i][1], d, int(held[i][3][end - 1])) for i, d, end in index.matches([h[1:3] for h in held])]
                held.clear()
                columns = [[g[0] for g in got], [index.ids[g[1]] for g in got], [g[2] for g in got], [int(index.sizes[g[1]]) for g in got], [g[3] for g in got]]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

            size = 0
            for b in batches:
                for lo, hi in slices(b.column(1), 1 << 18):  # for the caches
                    raw, off = text_bytes(b.column(1).slice(lo, hi - lo))
                    raw, off = raw[off[0] : off[-1]], off - off[0]
                    s, place, first = symbols_of(raw, off[:-1], off[1:])
                    for r, k, x, z in index.stretches(s, place, first):
                        held.append((b.column(0)[lo + r].as_py(), k, s[x:z].tobytes(), place[x:z] - off[r] + 1))
                        size += z - x
                        if len(held) >= 1024 or size >= 1 << 20:
                            yield verified()
                            size = 0
            if held:
                yield verified()

        return named.mapInArrow(run, _FOUND)

    found = spark.createDataFrame([], _FOUND)
    for ids, texts in _blocks(items, o):
        found = found.unionAll(against(ids, texts))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "ends_at", "item_symbols")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.distance").alias("distance"), F.col("b.item_symbols").alias("item_symbols"), F.col("b.ends_at").alias("ends_at"))


def brute_contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], o: CgkOptions | None = None) -> dict[tuple[int, int], int]:
    """(doc, item) -> distance of every pair within the bound, for small fixtures: no candidate search. Items of fewer
    than `least` symbols are exact runs of whole words."""
    o, out = o or CgkOptions(), {}

    def words(t):
        a = _SYMBOL[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)]
        return bytes(a).replace(b"\0", b" ").split()

    held = [(i, words(t)) for i, t in items if i is not None]
    for d, t in docs:
        mine = words(t)
        for i, w in held:
            item = b"".join(w)
            if len(item) >= o.least:
                distance = fit_distance(item, b"".join(mine))[0]
                if distance <= int(o.max_edits * len(item)):
                    out[d, i] = min(distance, out.get((d, i), distance))
            elif item and any(b"".join(mine[a:z]) == item for a in range(len(mine)) for z in range(a + 1, min(len(mine), a + len(item)) + 1)):
                out[d, i] = 0
    return out
