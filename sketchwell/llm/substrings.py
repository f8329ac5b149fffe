"""Removal of long repeated byte strings: distributed prefix doubling over synchronising positions.

A byte is covered if it lies in a string of `length` bytes that also starts anywhere else. Sorting all
positions at every doubling would move each byte of the corpus as a row of 16 bytes and more, several
times. Instead:

1. Within a text, each window of `length` bytes is owned by the place of its least `gram`-byte rank
   (ranks by doubling 8, 16, 32, gram bytes; the leftmost of equals). Equal windows have equal owners at
   equal distance, so only owners with equal grams need to meet: one row for some 175 bytes.
2. Spark sorts the owners by gram rank; a gram that occurs once drops out (its windows are unique).
   Owners whose whole stretch of windows is equal to another's are repeated throughout.
3. The rest, one owner per distinct stretch, bring their bytes. Spark deals them by gram; each task
   sorts position-rank pairs at offsets 8, 16, ... and re-ranks, dropping positions that became unique,
   until the offset reaches `length`: exact, no hashes. A gram with more than `most` distinct
   stretches is lengthened in Spark first: its windows are ranked by it and as many bytes after or before
   it (50, 100, 200, 300, 350 ... 400 bytes), equal stretches are put together and unique ones dropped, until
   no more than `most` share a rank. So no task ever gathers an unbounded group.
4. Starts become runs, runs become covered spans, texts lose them.

Beside the bytes, `shared_passages` tells which texts hold a passage of over 50 words (runs of bytes that aren't
ASCII white space, as written) that another text holds too, however few bytes it has: the same owners, over ranks
of words instead of bytes; stretches that differ are compared window by window.

Null and empty texts have no windows. Texts of any length (chunks that share length - 1 bytes).
Repeated rows cover one another. Rows are told apart by a 64-bit hash of id and text, so repeated or null
ids are separate texts. Matches never cross texts. Empty input: no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.llm.common import fresh, id_filter, in_filter, mix, reachable, slices, stored, text_bytes, words_of

K1 = np.uint64(0x9E3779B97F4A7C15)
POS = np.uint64(24)  # bits of a place within one block of bytes


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; places beyond the end count as zero bytes."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for k in range(8):  # eight aligned views, one per phase
        part = padded[k : k + (n - k + 7) // 8 * 8] if n > k else padded[:0]
        out[k::8] = part[: (len(out[k::8])) * 8].view("<u8")
    return out


def _then(h: np.ndarray, k: int) -> np.ndarray:
    """Ranks k places on; zero beyond the end."""
    return np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])


def gram_ranks(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit rank of the `gram` bytes from each place, by pairs of ranks at doubling offsets."""
    h, size = mix(words_at(raw)), 8
    while size < gram:
        step = min(size, gram - size)
        h = mix(h * K1 + _then(h, step))
        size += step
    return h


def owners(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """For texts from starts to ends, with the rank of the gram at each place: (text, place, first, last, gram rank) of
    each owner and the window starts it owns."""
    n = len(h)
    packed = (h >> POS << POS) | np.arange(n, dtype=np.uint64)
    reach, span = length - gram + 1, 1
    while span < reach:  # least of `reach` places, by doubling
        step = min(span, reach - span)
        packed = np.minimum(packed, np.concatenate([packed[step:], np.full(min(step, n), ~np.uint64(0))]))
        span += step
    owner = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    on = ends - starts >= length
    np.add.at(valid, starts[on], 1)
    np.add.at(valid, ends[on] - length + 1, -1)
    places = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(places):
        z = np.empty(0, np.int64)
        return z, z, z, z, np.empty(0, np.uint64)
    own = owner[places]
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1)])
    first, last, at = places[cut], places[np.r_[cut[1:], len(places)] - 1], own[cut]
    return np.searchsorted(starts, first, "right") - 1, at, first, last, h[at]


def _blocks(column, length: int, limit: int):
    """Blocks of whole texts, or of chunks of one long text: (rows, offsets in the text, raw, starts, ends)."""
    for lo, hi in slices(column, limit):
        raw, off = text_bytes(column.slice(lo, hi - lo))
        if hi - lo == 1 and off[1] - off[0] > limit:
            for a in range(0, int(off[1] - off[0]) - length + 1, limit - length + 1):
                part = raw[off[0] + a : min(off[1], off[0] + a + limit)]
                yield np.array([lo]), np.array([a]), part, np.array([0]), np.array([len(part)])
        else:
            rows, base = np.arange(lo, hi), off[0]
            some = off[1:] - off[:-1] >= length  # shorter texts hold no window
            yield rows[some], np.zeros(int(some.sum()), np.int64), raw[base : off[-1]], (off[:-1] - base)[some], (off[1:] - base)[some]


def doubled(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of `length` bytes at starts occur more than once among them: prefix doubling.

    Ranks of 8 bytes are the bytes themselves. At each offset the pairs (rank, rank at offset) are sorted
    and re-ranked; a start whose rank is unique drops out, and pairs of dropped places are not needed.
    """
    rank, size = words_at(raw), 8
    live = np.unique(starts)
    places = _reached(live, length - 8 + 1, len(raw))
    dense = np.zeros(len(raw), np.int64)
    dense[places] = np.unique(rank[places], return_inverse=True)[1]
    while True:
        own = dense[live]
        live = live[np.bincount(own)[own] > 1] if len(live) else live
        if size == length or not len(live):
            break
        step = min(size, length - size)
        places = _reached(live, length - size - step + 1, len(raw))
        pair = dense[places] * np.int64(len(raw) + 1) + dense[places + step]
        dense[places] = _ranks_of(pair, (len(raw) + 1) ** 2)
        size += step
    return np.isin(starts, live)


def _reached(starts: np.ndarray, count: int, n: int) -> np.ndarray:
    """The places below n that lie in one of the runs of `count` places at starts, which are different ones."""
    mark = np.zeros(n + 1, np.int32)
    mark[starts] = 1
    stop = starts + count
    mark[stop[stop < n]] -= 1
    return np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int32))


def _ranks_of(keys: np.ndarray, most: int) -> np.ndarray:
    """Ranks of keys from 0 to most; equal keys have equal ranks."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)[1]
    both = np.sort(keys << bits | np.arange(len(keys)))  # key and place in one number
    at, out = both & ((1 << bits) - 1), np.empty(len(keys), np.int64)
    both >>= bits
    out[at] = np.cumsum(np.r_[False, both[1:] != both[:-1]])
    return out


def _runs(places: np.ndarray):
    cut = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1])
    return places[cut], places[np.r_[cut[1:], len(places)] - 1]


_OWNERS = "gram long, whole long, uid long, first long, last long"
_RUNS = pa.schema([("uid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def repeated_starts(named: DataFrame, length: int = 400, gram: int = 50, most: int = 800, block: int = 1 << 18, meeting: int = 1 << 16) -> DataFrame:
    """(uid, first, last): runs of places where a string starts that also starts elsewhere. named: (uid, text)."""
    spark = reachable(named.sparkSession)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _OWNERS.split(", ")])

    def find(batches):
        fresh("owners")
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for rows, shift, raw, starts, ends in _blocks(b.column(1), length, block):
                text, at, first, last, rank = owners(gram_ranks(raw, gram), starts, ends, length, gram)
                if not len(at):
                    continue
                data = raw.tobytes()
                whole = np.fromiter((xxhash.xxh3_64_intdigest(data[f : t + length]) for f, t in zip(first.tolist(), last.tolist())), np.uint64, len(at))
                move = shift[text] - starts[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rank.view(np.int64), whole.view(np.int64), uid[rows[text]], first + move, last + move)], schema=schema)

    own = stored(named.mapInArrow(find, _OWNERS), "owners")
    classes = own.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "last")).alias("r"))
    grams = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1")
    known = stored(classes.join(grams.drop("n"), "gram"), "classes")
    whole = own.join(known.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select("uid", "first", "last")
    open_ = stored(known.where("kinds > 1").select("gram", "n", "kinds", "r.uid", "r.first", "r.last"), "open")

    perhaps = _kept(open_.select("uid").distinct(), "uid")

    cut_schema = pa.schema([("gram", pa.int64()), ("single", pa.int64()), ("kinds", pa.int64()), ("uid", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        for b in batches:
            for i in range(len(b)):
                data, u, rows = b.column(1)[i].as_buffer(), b.column(0)[i].as_py(), b.column(2)[i].values
                gram_, n, kinds, first, last = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                parts = [bytes(data[int(f) : int(t) + length]) for f, t in zip(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(gram_), pa.array((n == 1).astype(np.int64)), pa.array(kinds), pa.array(np.full(len(first), u)), pa.array(first), pa.array(parts, pa.binary())], schema=cut_schema)

    def near(some: DataFrame) -> DataFrame:
        asked = some.groupBy("uid").agg(F.collect_list(F.struct("gram", "n", "kinds", "first", "last")).alias("asked"))
        return named.mapInArrow(perhaps, "uid long, text string").join(asked, "uid").mapInArrow(cut, "gram long, single long, kinds long, uid long, first long, bytes binary")

    def meet(batches):
        """Grams in order; a group is complete before it is ranked."""
        fresh("meetings")
        held, size = [], 0

        def ranked(rows):
            grams_, single, _, uid, first, parts = (rows.column(k) for k in range(6))
            raw, off = text_bytes(parts)
            raw = raw[off[0] : off[-1]]
            off = off - off[0]
            n = np.diff(off) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            twice = doubled(raw, off[row] + place, length) & (single.to_numpy(zero_copy_only=False)[row] == 1)
            if twice.any():
                row, place = row[twice], place[twice]
                key = row * np.int64(1 << 40) + place
                a, z = _runs(key)
                r = a >> 40
                f = first.to_numpy(zero_copy_only=False)[r]
                yield pa.RecordBatch.from_arrays([pa.array(uid.to_numpy(zero_copy_only=False)[r]), pa.array(f + (a & ((1 << 40) - 1))), pa.array(f + (z & ((1 << 40) - 1)))], schema=_RUNS)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += b.column(5).nbytes
            if size < meeting:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = rows.column(0).to_numpy(zero_copy_only=False)
            done = int(np.searchsorted(g, g[-1], "left")) if g[0] != g[-1] else 0  # the last gram may go on
            at = 0
            while at < done:  # whole grams, about a block at once
                _, off = text_bytes(rows.column(5))
                to = max(at + 1, int(np.searchsorted(off, off[at] + meeting, "right")) - 1)
                to = min(done, to)
                if to < done:
                    to = int(np.searchsorted(g, g[to], "left")) if g[to] != g[at] else int(np.searchsorted(g, g[at], "right"))
                yield from ranked(rows.slice(at, to - at))
                at = to
            held = [rows.slice(done)]
            size = int(held[0].column(5).nbytes) if done else 0
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if rows:
                yield from ranked(rows[0])

    few = near(open_.where(F.col("kinds") <= most)).repartition("gram").sortWithinPartitions("gram").mapInArrow(meet, "uid long, first long, last long")

    found, wide = whole.unionAll(few), open_.where(F.col("kinds") > most)
    if not wide.limit(1).count():
        return found
    wide = stored(near(wide).select("gram", F.lit(-1).alias("core"), "single", "uid", "first", "bytes"), "wide")
    size = gram
    while size < length:
        more = min(size, (length + 1 - size) // 2)
        parts = stored(wide.mapInArrow(_extended(size, more, length, gram), _PARTS), "parts")
        size += more
        kept = parts.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min_by(F.struct("core", "single", "uid", "first", "bytes"), F.struct("uid", "first")).alias("r"))
        kinds = kept.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
        twice = kept.where("n > 1").select("gram", "whole")
        found = found.unionAll(parts.where("single = 1").join(twice, ["gram", "whole"], "left_semi").select("uid", "first", (F.col("first") + F.length("bytes") - length).alias("last")))
        one = F.when(F.col("n") == 1, F.col("r.single")).otherwise(0)
        reps = stored(kept.join(kinds, "gram").select("gram", one.cast("long").alias("single"), "kinds", "r.uid", "r.first", "r.bytes", "r.core"), "reps")
        found = found.unionAll(reps.where(F.col("kinds") <= most).drop("core").repartition("gram").sortWithinPartitions("gram").mapInArrow(meet, "uid long, first long, last long"))
        wide = reps.where(F.col("kinds") > most)
        if not wide.limit(1).count():
            return found
        wide = wide.select("gram", "core", "single", "uid", "first", "bytes")
    return found  # at full length each part was one window: equal ones are found


_PARTS = "gram long, whole long, core int, single long, uid long, first long, bytes binary"


def _extended(size: int, more: int, length: int, gram: int):
    """Lengthens the string that a stretch's windows share: those that reach far enough to the right of it share it
    with `more` bytes after it, the others with as many before it. Each part has a rank of its own."""
    schema = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("core", pa.int32()), ("single", pa.int64()), ("uid", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for g, core, single, uid, first, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                if core < 0:  # the owner: the first place of its rank
                    h = gram_ranks(np.frombuffer(data, np.uint8), gram)
                    core = int(np.flatnonzero(h >> POS == np.array([g]).view(np.uint64) >> POS)[0])
                last = len(data) - length
                split = max(0, core + size + more - length)
                for lo, hi, at in ((split, last, core), (0, min(last, split - 1), core - more)):
                    if lo <= hi:
                        part = data[lo : hi + length]
                        key = xxhash.xxh3_64_intdigest(data[at : at + size + more], seed=size + more)
                        rows.append((np.uint64(key).view(np.int64), np.uint64(xxhash.xxh3_64_intdigest(part)).view(np.int64), at - lo, single, uid, first + lo, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


_SPACE = re.compile(rb"\s")


class Words:
    """Texts -> 64-bit ranks of their words; ranks of longer runs by pairs of ranks at doubling offsets."""

    def of(self, text: bytes, piece: int = 1 << 20) -> np.ndarray:
        """A long text is split piece by piece: only ranks are held of all of it."""
        parts, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + piece) if len(text) - at > piece else None
            to = cut.start() if cut else len(text)
            parts.append(self._ranks(np.frombuffer(text, np.uint8, to - at, at), np.array([0, to - at]))[0])
            at = to
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def of_all(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the words of texts from off to off (off starts at 0), and how many words each text has."""
        if len(off) == 2:
            rank = self.of(raw.tobytes())
            return rank, np.array([len(rank)])
        return self._ranks(raw, off)

    def _ranks(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, which, count = words_of(raw, off)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[which], count


def run_ranks(rank: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit rank of the `count` words from each place."""
    size = 1
    while size < count:
        step = min(size, count - size)
        rank = mix(rank * K1 + _then(rank, step))
        size += step
    return rank


def _kept(ids: DataFrame, column: str):
    """A batch filter: rows whose first column may be among the ids, by a filter of bounded size."""
    packed = ids.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    def perhaps(batches):
        for b in batches:
            yield b.filter(pa.array(in_filter(packed.value, b.column(0).to_numpy(zero_copy_only=False))))

    return perhaps


def shared_passages(named: DataFrame, words: int = 51, gram: int = 8, block: int = 1 << 18) -> DataFrame:
    """(uid): texts that hold a passage of `words` words which is in another text too. named: (uid, text)."""
    reachable(named.sparkSession)
    kinds = "gram long, whole long, uid long, first long, last long"
    schema = pa.schema([(c.split()[0], pa.int64()) for c in kinds.split(", ")])

    def find(batches):
        fresh("word owners")
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(b.column(1), block):
                raw, off = text_bytes(b.column(1).slice(lo, hi - lo))
                every, size = Words().of_all(raw[off[0] : off[-1]], off - off[0])
                some = np.flatnonzero(size >= words)
                if not len(some):
                    continue
                every, size = every[np.repeat(size >= words, size)], size[some]
                # a text of many words is cut into chunks that share words - 1 of them
                for a in range(0, max(1, len(every) - words + 1), block) if len(some) == 1 else (0,):
                    rank = every[a : a + block + words - 1] if len(some) == 1 else every
                    ends = np.cumsum(size) if len(some) > 1 else np.array([len(rank)])
                    starts = np.r_[0, ends[:-1]]
                    text, _, first, last, h = owners(run_ranks(rank, gram), starts, ends, words, gram)
                    data = memoryview(rank).cast("B")
                    whole = np.fromiter((xxhash.xxh3_64_intdigest(data[8 * f : 8 * (t + words)]) for f, t in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                    move = a - starts[text]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), whole.view(np.int64), uid[lo + some[text]], first + move, last + move)], schema=schema)

    own = stored(named.mapInArrow(find, kinds), "word-owners")
    met = stored(own.groupBy("gram").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("gram"), "met")
    near = own.mapInArrow(_kept(met, "gram"), kinds).join(met, "gram", "left_semi")
    classes = near.groupBy("gram", "whole").agg(F.min(F.struct("uid", "first", "last")).alias("r"), F.max("uid").alias("hi"))
    classes = stored(classes.select("gram", "whole", "r.uid", "r.first", "r.last", (F.col("r.uid") != F.col("hi")).alias("many")), "word-classes")
    equal = near.join(classes.where("many").select("gram", "whole"), ["gram", "whole"], "left_semi").select("uid")
    several = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    asked = stored(classes.join(several, "gram", "left_semi").groupBy("uid").agg(F.collect_set(F.struct("first", "last", "many")).alias("asked")), "asked")
    out = pa.schema([("window", pa.int64()), ("uid", pa.int64()), ("many", pa.bool_())])

    def each(column):
        for lo, hi in slices(column, block):
            raw, off = text_bytes(column.slice(lo, hi - lo))
            rank, count = Words().of_all(raw[off[0] : off[-1]], off - off[0])
            ends = np.cumsum(count)
            for i in range(hi - lo):
                yield lo + i, rank[ends[i] - count[i] : ends[i]]

    def windows(batches):
        fresh("windows")
        for b in batches:
            for i, rank in each(b.column(1)):
                u = b.column(0)[i].as_py()
                first, last, many = (b.column(2)[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for a in range(0, len(rank), block):
                    lo, hi = np.maximum(first, a), np.minimum(last, a + block - 1)
                    n = np.maximum(hi - lo + 1, 0)
                    if n.any():
                        at = np.repeat(lo - a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        part = run_ranks(rank[a : a + block + words - 1], words)
                        yield pa.RecordBatch.from_arrays([pa.array(part[at].view(np.int64)), pa.array(np.full(len(at), u)), pa.array(np.repeat(many, n))], schema=out)

    texts = named.mapInArrow(_kept(asked.select("uid"), "uid"), "uid long, text string").join(asked, "uid")
    seen = stored(texts.mapInArrow(windows, "window long, uid long, many boolean"), "windows")
    twice = seen.groupBy("window").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.max("many").alias("many")).where("lo <> hi or many").select("window")
    return equal.unionAll(seen.join(twice, "window", "left_semi").select("uid")).distinct()


def brute_shared(texts: list[bytes], words: int = 51) -> list[bool]:
    """Which texts hold a passage of another text, for small fixtures. Equal texts are different ones."""
    seen: dict[tuple, set[int]] = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - words + 1):
            seen.setdefault(tuple(w[i : i + words]), set()).add(k)
    held = set().union(*(v for v in seen.values() if len(v) > 1))
    return [k in held for k in range(len(texts))]


def without_repeats(docs: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage) for docs(doc_id, text). shares_passage: 1 if
    a passage of `words` words is in another text too, however few bytes it has, else 0; nothing is removed for it."""
    spark = reachable(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    runs = stored(repeated_starts(named.select("uid", "text"), length), "runs")
    shared = shared_passages(named.select("uid", "text"), words)
    marks = runs.select("uid", F.struct("first", "last").alias("span"), F.lit(0).alias("shared"))
    marks = marks.unionAll(shared.select("uid", F.lit(None), F.lit(1)))
    marks = stored(marks.groupBy("uid").agg(F.collect_set("span").alias("spans"), F.max("shared").alias("shared")), "marks")
    packed = spark.sparkContext.broadcast(id_filter(runs.select("uid").distinct(), "uid"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("shares_passage", pa.int32())])

    def touched(batches):
        """Whole texts without repeats are done here; the others keep their bytes for the join."""
        for b in batches:
            hit = in_filter(packed.value, b.column(0).to_numpy(zero_copy_only=False))
            for lo, hi in slices(b.column(2), 4 << 20):
                part = b.column(2).slice(lo, hi - lo)
                raw, off = text_bytes(part)
                sums = [None if hit[lo + i] else hashlib.sha256(raw[off[i] : off[i + 1]]).hexdigest() for i in range(hi - lo)]
                keep = [raw[off[i] : off[i + 1]].tobytes() if hit[lo + i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(sums, pa.string()), pa.array(keep, pa.binary())], names=["uid", "doc_id", "n_bytes", "sum", "raw"])

    def strip(batches):
        for b in batches:
            rows = []
            for i in range(len(b)):
                n, found = b.column(1)[i].as_py(), b.column(4)[i]
                if b.column(3)[i].is_valid:
                    data = np.frombuffer(b.column(3)[i].as_buffer(), np.uint8)
                    mark = np.zeros(n + 1, np.int32)
                    if found.is_valid and len(found.values):
                        np.add.at(mark, found.values.field(0).to_numpy(zero_copy_only=False), 1)
                        np.add.at(mark, found.values.field(1).to_numpy(zero_copy_only=False) + length, -1)
                    gone = np.cumsum(mark[:n]) > 0
                    kept = data[~gone]
                    rows.append((b.column(0)[i].as_py(), n, int(gone.sum()), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])), hashlib.sha256(kept).hexdigest(), b.column(5)[i].as_py()))
                else:
                    rows.append((b.column(0)[i].as_py(), n, 0, 0, b.column(2)[i].as_py(), b.column(5)[i].as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    first = named.mapInArrow(touched, "uid long, doc_id long, n_bytes long, sum string, raw binary")
    both = first.join(marks, "uid", "left").select("doc_id", "n_bytes", "sum", "raw", "spans", F.coalesce("shared", F.lit(0)).alias("shared"))
    return both.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage int")


def brute_removed(texts: list[bytes], length: int = 400) -> list[np.ndarray]:
    """Which bytes go, for small fixtures: every window in a dictionary."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out
