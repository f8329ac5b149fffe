"""Similarity join of word-shingle sets: T-occurrence search with DivideSkip, then components.

Plan (everything is keyed and linear until real candidates are left):
1. per text the set of 64-bit shingle hashes; equal sets form one class, its smallest id stands for it;
2. of each class an extended prefix in hash order, minus the most frequent lists that the overlap
   bound allows to skip (DivideSkip: long lists aren't merged);
3. inverted lists of those shingles, by size, cut where sizes are too far apart to link, and into blocks; lists of one
   class vanish;
4. each class that shares many lists with a leader joins its star; a star is joined exactly in one
   task, large stars in several blocks that all hold the leader: short lists are heap-merged, long
   ones probed by binary search;
5. lists that still span several components, of sets that have enough of them, give pairs, unless parity
   bits of the sets show that they differ too much; those that occur together often enough (T-occurrence: linked sets share so many
   prefix lists at least) are probed on whole sets;
6. connected components of all links.

Two sets link when den * |A n B| >= num * |A u B|. Null or blank texts: empty set, linked with
nothing, component is the row's own id. Repeated ids are one document. Null ids: own component null.
Texts of any length. Columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchwell.llm.common import components, fresh, id_filter, in_filter, mix, reachable, released, slices, stored, text_bytes

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xC2B2AE3D27D4EB4F)
C = np.uint64(0x165667B19E3779F9)


#: A posting's size is kept above so many bits, the number of lists its set skips below.
PACK = 24
BITS = 512


class Shingler:
    """Texts -> sorted arrays of shingle hashes. Words: runs of bytes that aren't ASCII white space, A-Z lowered."""

    def __init__(self, width: int = 3, most_words: int = 1 << 18):
        self.width, self.most, self.known = width, most_words, {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def set_of(self, text: bytes) -> np.ndarray:
        """The set of one text, ascending."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w, k = self._ids(words), self.width
        if len(w) < k:  # the whole sequence is one shingle, told apart from longer ones by its length
            h = np.array([len(w)], np.uint64)
            for i in range(len(w)):
                h = mix(h * A + w[i : i + 1])
            return h
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * A + w[i : len(w) - k + 1 + i] * (B if i % 2 else C))
        h.sort()
        return h[np.r_[True, h[1:] != h[:-1]]]


def slack(n: int, num: int, den: int) -> int:
    """How many shingles of a set of n a linked set may lack."""
    return n - -(-num * n // den)


def alone(n: int, num: int, den: int) -> bool:
    """Whether sets of n link with equal sets only: a linked set may lack nothing and not even one more may hold them."""
    return not slack(n, num, den) and den * n < num * (n + 1)


def spare(n: int, num: int, den: int) -> int:
    """By how many lists the prefix of a set of n is extended: linked sets share one list more at least. Small sets
    have no more in common than the overlap asks for."""
    return min(slack(n, num, den) // 2 + 3, max(0, -(-num * n // den) - 1))


def skipped(n: int, num: int, den: int) -> int:
    """How many lists are skipped at most: half of what the smallest linkable set's prefix was extended by."""
    return spare(-(-num * n // den), num, den) // 2


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of some bits. Two sets differ in as many elements at least as bits."""
    return np.packbits(np.bincount((s >> np.uint64(16) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def linked(common: int, n: int, m: int, num: int, den: int) -> bool:
    return den * common >= num * (n + m - common)


def _frame(schema: pa.Schema, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64) if kind == pa.int64() else flat))


def signatures(docs: DataFrame, num: int, den: int, width: int = 3) -> DataFrame:
    """(id, n, key, prefix, odd): size, a 128-bit digest of the set, the extended prefix in hash order, parities."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches):
        fresh("signatures")
        to = Shingler(width)
        for b in batches:
            texts = b.column(1)
            for lo, hi in slices(texts, 2 << 20):
                raw, off = text_bytes(texts.slice(lo, hi - lo))
                ns, keys, prefixes, odd = [], [], [], []
                for i in range(hi - lo):
                    s = to.set_of(raw[off[i] : off[i + 1]].tobytes())
                    n = len(s)
                    e, on = slack(n, num, den), n and not alone(n, num, den)
                    ns.append(n)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    prefixes.append(s[: e + 1 + spare(n, num, den)].view(np.int64) if on else s[:0].view(np.int64))
                    odd.append(parities(s) if on else s[:0].view(np.int64))
                yield _frame(schema, b.column(0).slice(lo, hi - lo), ns, keys, _lists(prefixes, pa.int64()), _lists(odd, pa.int64()))

    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, n long, key binary, prefix array<long>, odd array<long>")


def frequent(sigs: DataFrame, share: float = 0.002, least: int = 24, most: int = 1 << 16) -> dict[int, int]:
    """Shingles that are frequent in some partition's prefixes, with a count: a superset of those frequent
    overall, at most `most` of them. They order the lists to skip; any order gives the same result."""
    schema = pa.schema([("token", pa.int64()), ("hits", pa.int64())])

    def run(batches):
        seen, held = 0, []
        for b in batches:
            seen += len(b)
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).copy())
            if sum(map(len, held)) > 1_000_000:
                yield from report(held, seen)
                seen, held = 0, []
        yield from report(held, seen)

    def report(held, seen):
        if held and seen:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            on = np.flatnonzero(c >= max(least, share * seen))
            on = on[np.argsort(-c[on], kind="stable")][: most // 8]
            yield _frame(schema, t[on], c[on])

    found = sigs.select("prefix").mapInArrow(run, "token long, hits long").groupBy("token").agg(F.sum("hits").alias("hits"))
    return {r.token: r.hits for r in found.orderBy(F.desc("hits"), "token").limit(most).toLocalIterator()}


def inverted(sigs: DataFrame, hot: dict[int, int], num: int, den: int, block: int = 1024, copies=None) -> DataFrame:
    """(token, leader, k, ids, ns): lists of two classes or more, in blocks, smaller sets first; k: length, a block at most.

    A list ends where the next larger set is too large to link with the one before it, and so with any: what follows is a
    list of its own, under a token made of the shingle and the size it begins with. copies: what `_copies` gives; rows that
    its filter holds are left out, and those of its rows come in their place. Each stage has one Python step: a task has one worker."""
    sent = sigs.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.int64), np.array([hot[t] for t in sorted(hot)], np.int64)))
    post = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def keep(batches, packed=None):
        """Postings without the frequent lists that the bound lets a text skip; n holds size and number skipped."""
        fresh("postings")
        tokens, hits = sent.value
        for b in batches:
            if packed is not None:
                b = b.filter(pa.array(~in_filter(packed.value, b.column(3).to_numpy(zero_copy_only=False))))
            if not len(b):
                continue
            ids, ns = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            ends = b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(tokens, flat)
            at[at == len(tokens)] = 0
            heat = np.where(tokens[at] == flat, hits[at], 0) if len(tokens) else np.zeros(len(flat), np.int64)
            on, gone = np.ones(len(flat), bool), np.zeros(len(ids), np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(ends))
            for i in np.unique(owner[heat > 0]):
                lo, hi = ends[i], ends[i + 1]
                k = min(skipped(int(ns[i]), num, den), int((heat[lo:hi] > 0).sum()))
                if k:  # the hottest go; among equals the largest hash
                    on[lo + np.lexsort((flat[lo:hi].view(np.uint64), heat[lo:hi]))[hi - lo - k :]] = False
                    gone[i] = k
            row = owner[on]
            yield _frame(post, flat[on], ids[row], (ns << PACK | gone)[row])

    out = pa.schema([("token", pa.int64()), ("leader", pa.int64()), ("k", pa.int64()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])

    def lists(batches):
        """Streams over postings sorted by token and size: only one block of one list is held."""
        fresh("lists")
        token, leader, ids, ns, more = None, None, [], [], False
        shingle = largest = None
        ready: list = []

        def close():
            if token is not None and (more or len(ids) > 1) and ids:
                ready.append((token, leader, block if more else len(ids), np.array(ids, np.int64), np.array(ns, np.int64)))

        def frame():
            rows, ready[:] = ready[:], []
            return _frame(out, *([r[i] for r in rows] for i in range(3)), _lists([r[3] for r in rows], pa.int64()), _lists([r[4] for r in rows], pa.int64()))

        for b in batches:
            t, i, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(t):
                continue
            size = n >> PACK
            cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (size[:-1] * den < size[1:] * num)])
            names = mix(t[cut].view(np.uint64) ^ (size[cut].view(np.uint64) * A)).view(np.int64).tolist()
            ends = np.r_[cut[1:], len(t)]
            for name, lo, hi in zip(names, cut.tolist(), ends.tolist()):
                if t[lo] != shingle or largest * den < size[lo] * num:
                    close()
                    token, leader, ids, ns, more = name, int(i[lo]), [], [], False
                shingle, largest = t[lo], size[hi - 1]
                for at in range(lo, hi, block):
                    ids += i[at : min(hi, at + block)].tolist()
                    ns += n[at : min(hi, at + block)].tolist()
                    if len(ids) >= block:
                        more = True
                        close()
                        ids, ns = [], []
            if len(ready) > 4096:
                yield frame()
        close()
        if ready:
            yield frame()

    kind = "token long, id long, n long"
    if copies is None:
        postings = sigs.select("id", "n", "prefix").mapInArrow(keep, kind)
    else:
        packed, exact = copies
        postings = sigs.select("id", "n", "prefix", _name()).mapInArrow(lambda batches: keep(batches, packed), kind).unionAll(exact.mapInArrow(keep, kind))
    return postings.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(lists, "token long, leader long, k long, ids array<long>, ns array<long>")


# ---- the exact join of one task's sets ----------------------------------------------------


def merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and in how many each occurs."""
    total = sum(map(len, lists))
    if total <= 64:
        members, counts = [], []
        for x in heapq.merge(*(v.tolist() for v in lists)):
            if members and members[-1] == x:
                counts[-1] += 1
            else:
                members.append(x)
                counts.append(1)
        return np.array(members, np.int64), np.array(counts, np.int64)
    return np.unique(np.concatenate(lists), return_counts=True)  # long runs: the merge is numpy's


def join_sets(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of the list (a spanning forest of them).

    DivideSkip: of the lists of a set, all but the shortest are left aside; candidates from the merged
    short ones must occur there often enough, and are then probed by binary search in the long ones.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(flat, kind="stable")  # a list's members ascend, so do their sizes
    tokens, first = np.unique(flat[by], return_index=True)
    ends = np.r_[first[1:], len(flat)]
    owner = owner[by]
    root = np.arange(len(sets))

    out = []
    for x in range(1, len(sets)):
        n = int(size[x])
        need = -(-num * n // den)  # at least so many of x's shingles are common
        at = np.searchsorted(tokens, sets[x])
        length = ends[at] - first[at]
        rank = np.argsort(length, kind="stable")
        short, long = at[rank[: n - need + 1]], at[rank[n - need + 1 :]]
        got, hits = merge_counts([owner[first[t] : ends[t]] for t in short if ends[t] - first[t] > 1])
        if not len(got):
            continue
        fits = (got < x) & (size[got] * den >= num * n) & (hits >= need - len(long)) & (root[got] != root[x])
        got, hits = got[fits], hits[fits]
        for k in np.argsort(-hits, kind="stable"):
            y = int(got[k])
            if root[y] == root[x]:
                continue
            common = int(hits[k])
            probe, mine = tokens[long], sets[y]
            where = np.searchsorted(mine, probe)
            where[where == len(mine)] = 0
            common += int((mine[where] == probe).sum())
            if linked(common, n, int(size[y]), num, den):
                out.append((ids[x], ids[y]))
                a, b = root[x], root[y]
                root[root == max(a, b)] = min(a, b)
    return out


def _dealt(members: DataFrame, most: int, heads: int = 32) -> DataFrame:
    """(leader, part, id): stars in blocks of about `most` shingles; of a star of several blocks, its leader and
    some more heads are in each, so that blocks of one group of copies find together."""
    size = members.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(float(most))).cast("long").alias("blocks"))
    dealt = members.join(size, "leader").select("leader", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("part"))
    large = dealt.where("blocks > 1").groupBy("leader", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(heads)).alias("slot")).agg(F.min("id").alias("id"))
    more = large.select("leader", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")).select("leader", "part", "id")
    own = dealt.select("leader", "part", F.col("leader").alias("id")).distinct()
    return dealt.select("leader", "part", "id").unionAll(own).unionAll(more).distinct()


def _stars(dealt: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links within each block of each star."""
    rows = dealt.join(sets, "id").select("leader", "part", "id", "tokens")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        fresh("stars")
        key, ids, held, found = None, [], [], []
        for b in batches:
            lead, part, who, tok = (b.column(i) for i in range(4))
            lead, part, who = lead.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False), who.to_numpy(zero_copy_only=False)
            for i in range(len(b)):
                k = (int(lead[i]), int(part[i]))
                if k != key:
                    if len(ids) > 1:
                        found += join_sets(ids, held, num, den)
                    key, ids, held = k, [], []
                ids.append(int(who[i]))
                held.append(np.frombuffer(tok[i].as_buffer(), np.uint64))
            if found:
                yield _frame(schema, [f[0] for f in found], [f[1] for f in found])
                found = []
        if len(ids) > 1:
            found += join_sets(ids, held, num, den)
        if found:
            yield _frame(schema, [f[0] for f in found], [f[1] for f in found])

    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) whose whole sets link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            x, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            on = []
            for i in range(len(b)):
                s, t = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                on.append(linked(int((t[at] == s).sum()), len(s), len(t), num, den))
            on = np.array(on, bool)
            yield _frame(schema, x[on], y[on])

    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("s")), "x").join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("t")), "y")
    return both.select("x", "y", "s", "t").mapInArrow(run, "a long, b long")


def _whole_sets(named: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, tokens): whole sets of the wanted ids, and of some others that the bounded filter lets through; joins follow."""
    ids = stored(ids, "ids")
    packed = named.sparkSession.sparkContext.broadcast(id_filter(ids, "id"))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        fresh("sets")
        to = Shingler(width)
        for b in batches:
            b = b.filter(pc.is_valid(b.column(0)))
            b = b.filter(pa.array(in_filter(packed.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for lo, hi in slices(b.column(1), 2 << 20):
                raw, off = text_bytes(b.column(1).slice(lo, hi - lo))
                yield _frame(schema, b.column(0).slice(lo, hi - lo), [to.set_of(raw[off[i] : off[i + 1]].tobytes()).tobytes() for i in range(hi - lo)])

    return named.mapInArrow(run, "id long, tokens binary")


def _name():
    return F.xxhash64("id", "key").alias("name")


def _copies(sigs: DataFrame, classes: DataFrame):
    """A bounded filter of the rows that don't stand for their class, and (id, n, prefix) of the rows it holds that do.

    Prefixes are most of what a signature weighs, and most rows are no copies: only rows that the filter can't tell from
    copies are moved, to an exact join."""
    reps = classes.select(F.col("rep").alias("id"), "key")
    others = stored(sigs.select("id", "key").join(reps, ["id", "key"], "left_anti").select(_name()).distinct(), "copies")
    packed = sigs.sparkSession.sparkContext.broadcast(id_filter(others, "name"))

    def held(batches):
        fresh("copies")
        for b in batches:
            b = b.filter(pa.array(in_filter(packed.value, b.column(4).to_numpy(zero_copy_only=False))))
            if len(b):
                yield b.select([0, 1, 2, 3])

    like = sigs.select("id", "n", "key", "prefix", _name()).mapInArrow(held, "id long, n long, key binary, prefix array<long>")
    return packed, stored(like.join(reps, ["id", "key"], "left_semi").select("id", "n", "prefix"), "copies")


def near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, width: int = 3, star: int = 1_500_000, short: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    spark = reachable(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sigs = stored(signatures(named, num, den, width), "signatures")
    classes = sigs.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"))
    reps = classes.select(F.col("rep").alias("id"), "key")
    own = sigs.where(F.size("prefix") > 0).join(reps, ["id", "key"], "left_semi")
    some = sigs.where(F.size("prefix") > 0)
    lists = stored(inverted(some, frequent(sigs), num, den, copies=_copies(some, classes)), "lists")
    least = lambda n: f"(({num} * {n} + {den - 1}) div {den})"  # noqa: E731  the smallest size that links with n
    spares = lambda n: f"least(({n} - {least(n)}) div 2 + 3, greatest(0, {least(n)} - 1))"
    may_skip = f"({spares(least('n'))} div 2)"
    size = [F.shiftright("p.ns", PACK).alias("n"), (F.col("p.ns").bitwiseAND((1 << PACK) - 1)).alias("gone")]
    posts = lists.select("token", "leader", "k", F.explode(F.arrays_zip("ids", "ns")).alias("p")).select("token", "leader", "k", F.col("p.ids").alias("id"), *size)
    often = posts.where("id <> leader").groupBy("id", "leader", "n").count().where(f"count >= {spares('n')}")
    members = stored(often.groupBy("id", "n").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader")), "members")
    dealt = stored(_dealt(members, star), "stars")
    sets = _whole_sets(named, dealt.select("id").distinct(), width)
    stars = stored(_stars(dealt, sets, num, den), "links")

    # DivideSkip with exact lengths: what the bound still allows is skipped, longest lists first
    longest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k"), "token"))
    ranked = posts.drop("leader").withColumn("skip", (longest <= F.expr(may_skip) - F.col("gone")) & (F.col("k") > short))
    ranked = ranked.withColumn("gone", F.col("gone") + F.sum(F.col("skip").cast("int")).over(Window.partitionBy("id"))).where("not skip")
    home = members.select("id", "leader", "n").join(dealt.withColumnRenamed("leader", "l"), "id").where("l = leader").groupBy("id").agg(F.min("leader").alias("leader"), F.min("part").alias("part"))
    at = ranked.join(components(stars).withColumnRenamed("node", "id"), "id", "left").join(home, "id", "left")
    at = stored(at.select("token", "id", "n", "gone", F.coalesce("component", "id").alias("comp"), "leader", "part"), "open")
    released(lists, members, dealt)
    # a set links with another component only by so many open lists; fewer than that, and none of its lists matter
    need = f"1 + {spares(least('n'))} - {spares('n')} div 2"
    for last in (False, True):
        still = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        left = at.join(still, "token").withColumn("lists", F.count("*").over(Window.partitionBy("id"))).where(f"lists >= {need}").drop("lists")
        if last:
            left = left.join(own.select("id", "odd").dropDuplicates(["id"]), "id").select(*at.columns, *(F.col("odd")[i].alias(f"o{i}") for i in range(BITS // 64)))
        before, at = at, stored(left, "open")
        released(before)
    # columns keep their names on both sides, so that the rows are dealt out once for both
    differ = "+".join(f"bit_count(x.o{i} ^ y.o{i})" for i in range(BITS // 64))  # linked sets differ in (n + m)(den - num)/(den + num) at most
    apart = "coalesce(x.leader <> y.leader or x.part <> y.part, true)"
    met = at.alias("x").join(at.alias("y"), F.expr(f"x.token = y.token and ({differ}) * {den + num} <= (x.n + y.n) * {den - num} and x.comp <> y.comp and struct(x.n, x.id) < struct(y.n, y.id) and x.n * {den} >= y.n * {num} and {apart}"))
    met = met.selectExpr("x.id as x", "y.id as y", "x.n as n", "x.gone as gx", "y.gone as gy").groupBy("x", "y", "n", "gx", "gy").count()
    met = stored(met.where(f"count > {spares('n')} - greatest(gx, gy)").select("x", "y"), "pairs")
    released(at)
    more = stored(_whole_sets(named, met.select(F.col("x").alias("id")).unionAll(met.select("y")).distinct(), width), "sets")
    rest = stored(_checked(met, more, num, den), "links")
    released(met, more)
    comp = components(stars.unionAll(rest))
    grouped = classes.join(comp, classes.rep == comp.node, "left").select("key", F.coalesce("component", "rep").alias("c"))
    out = sigs.select("id", "n", "key").join(grouped, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def brute_components(rows: list[tuple[int, str | None]], num: int = 90, den: int = 100, width: int = 3) -> dict[int, tuple[int, int]]:
    """Quadratic check for small fixtures: id -> (size, component)."""
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}
