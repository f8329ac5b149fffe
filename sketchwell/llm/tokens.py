"""Token ids as directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k of a shard holds the k-th chunks of all ids
that have one, a bitmap of which of them go on, and a rank directory (ones before every 512 bits).
Token i: chunk i of level 0; if its bit is set, the place in level 1 is the rank of i, and so on: a
few reads for any token, no block is decoded. A shard also has its documents' ids and first places.

Shards are rows of a Parquet table in the shared folder (bucket, seq, tokens, documents, body);
bucket and seq ascend with doc_id, so start offsets are sums of narrow counts.

Null texts are empty: only the end id. Null ids come first. Repeated ids are kept, in the order of
their ids' bytes. Texts of any length (a shard takes whole documents). Empty input: no shards.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchwell.llm.common import CACHES, fresh, parallelism, reachable, slices, stored, text_bytes, words_of

MAGIC = b"DAC1"
RANK = 64  # bytes of bitmap for each entry of the rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, places: np.ndarray) -> bytes:
    """A shard of uint32 ids; doc_ids has a row per document, places one more."""
    body, levels, rest = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(rest):
        chunk = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % RANK, np.uint8))
        ones = _ONES[bits].reshape(-1, RANK).sum(axis=1, dtype=np.uint32)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        body += [struct.pack("<QQ", len(chunk), len(bits)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return b"".join([MAGIC, struct.pack("<IQQ", levels, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), places.astype("<u8").tobytes(), *body])


class Shard:
    """Reads a packed shard in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        levels, self.n, docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.places = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            n, width = struct.unpack_from("<QQ", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at := at + 16)
            bits = np.frombuffer(data, np.uint8, width, at := at + n)
            ranks = np.frombuffer(data, "<u4", width // RANK, at := at + width)
            at += 4 * (width // RANK)
            self.levels.append((chunk, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place i."""
        byte = i >> 3
        block = byte // RANK
        if block >= len(ranks):
            return (int(ranks[-1]) + int(_ONES[bits[-RANK:]].sum(dtype=np.int64))) if len(ranks) else 0
        found = int(ranks[block]) + int(_ONES[bits[block * RANK : byte]].sum(dtype=np.int64))
        return found + int(_ONES[int(bits[byte]) & ((1 << (i & 7)) - 1)])

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids of places lo to hi, as uint32, by rank at each level."""
        out, on, shift = np.zeros(hi - lo, np.uint32), None, 0
        for chunk, bits, ranks in self.levels:
            part = chunk[lo:hi].astype(np.uint32) << np.uint32(shift)
            if on is None:
                out |= part
                on = np.arange(hi - lo)
            else:
                out[on] |= part
            first = lo >> 3
            go = np.unpackbits(bits[first : -(-hi // 8)], bitorder="little")[lo - 8 * first : hi - 8 * first].astype(bool)
            if not go.any():
                break
            on = on[go]
            lo = self._rank(bits, ranks, lo)
            hi, shift = lo + len(on), shift + 8
        return out


#: A boundary that no token spans: a letter of ASCII or Latin-1, then one of these marks.
_MARK = np.isin(np.arange(256), list(b".,;:!?|#$%&*"))
_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
_LATIN = np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])  # after 0xC3: letters, but for two signs
_LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
#: Words that the pre-tokenizer below keeps whole and that no normalizer changes but for their case.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_CASED = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Numbered(dict):
    """Pieces by number; one that is asked for the first time gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of whole texts by way of pieces that no token spans: cut at ASCII white space and after words.

    Ids of pieces are kept, `most` of them at once. Texts that might hold a special token are cut at
    white space alone and keep their case; others are lowered first where the vocabulary does so. New words of
    plain letters go to the tokenizer's model without the normalizers and patterns that leave them as they are.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok, self.most = Tokenizer.from_file(path), most
        form = json.loads(self.tok.to_str())
        self.lower = any(x.get("type") == "Lowercase" for x in (form.get("normalizer") or {}).get("normalizers", []))
        suffix = form["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.model = None
        if self.ends is not None and _leaves_words(form):
            self.model = Tokenizer(self.tok.model)  # the same model, shared
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self):
        self.known = _Numbered()
        self.held = 0
        self.flat, self.used, self.at, self.n = np.empty(1 << 16, np.uint32), 0, np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, new: list[bytes]):
        """Encode pieces in the order of their numbers. Runs of plain words, each closed by one word-end token, go as one text."""
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        plain = _CASED if self.lower else _PLAIN
        for i in range(0, len(new), 4096):  # encodings are large
            words = [w.decode("utf-8", "replace") for w in new[i : i + 4096]]
            n, flat = np.zeros(len(words), np.int64), []
            by_model = [k for k, w in enumerate(words) if plain.fullmatch(w)] if self.model else []
            known = set(by_model)
            rest = [k for k in range(len(words)) if k not in known]
            together = [k for k in rest if words[k].isalpha()] if self.ends is not None else []
            order = []
            for tok, some in ((self.model, by_model), (self.tok, together)):
                if some:
                    text = " ".join([words[k] for k in some])
                    ids = np.array(getattr(tok, "encode_batch_fast", tok.encode_batch)([text.lower() if tok is self.model and self.lower else text], add_special_tokens=False)[0].ids, np.int64)
                    stop = np.flatnonzero(self.ends[ids]) + 1
                    if len(stop) == len(some) and stop[-1] == len(ids):
                        n[some] = np.diff(stop, prepend=0)
                        flat.append(ids)
                        order += some
            held = set(order)
            rest = [k for k in range(len(words)) if k not in held]
            for k, e in zip(rest, encode([words[k] for k in rest], add_special_tokens=False)):
                n[k] = len(e.ids)
                flat.append(np.array(e.ids, np.int64))
            self._keep(np.array(order + rest, np.int64), n, np.concatenate(flat))

    def _keep(self, order: np.ndarray, n: np.ndarray, ids: np.ndarray):
        """The next len(n) pieces, which have n ids each; ids holds theirs in another order."""
        k, total = self.held, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + len(n) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.n))
        self.flat[self.used : self.used + total] = ids
        self.at[k + order] = self.used + np.cumsum(n[order]) - n[order]
        self.n[k : k + len(n)] = n
        self.used += total
        self.held += len(n)

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        cut = np.zeros(len(raw), bool)
        letter = _LETTER.take(raw)
        if len(raw) > 1:
            letter[1:] |= _LATIN.take(raw[1:]) & (raw[:-1] == 0xC3)
            cut[1:] = letter[:-1] & _MARK.take(raw[1:])
        plain = _LOWER.take(raw) if self.lower else raw
        data = raw.tobytes()
        at = data.find(b"<|")
        while at >= 0:  # perhaps a special token
            i = int(np.searchsorted(off, at, "right")) - 1
            a, z = int(off[i]), int(off[i + 1])
            if at + 2 <= z:
                cut[a:z] = False
                plain = plain.copy() if plain is raw else plain
                plain[a:z] = raw[a:z]
                at = z - 1
            at = data.find(b"<|", at + 1)
        return words_of(raw, off, plain, cut)

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each starts (one more entry than texts)."""
        return self.encode_bytes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), end)

    def encode_bytes(self, raw: np.ndarray, off: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same for the texts that lie in raw from off to off."""
        pieces, of, n = self._pieces(raw, off)
        if len(self.known) > self.most:
            self.clear()
        known = self.known
        which = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        if known.new:
            self._learn(known.new)
            known.new = []
        which = which[of]
        size = self.n[which]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        starts = total[np.r_[0, np.cumsum(n)]]
        shift = np.repeat(self.at[which] - total[:-1], size)
        shift += np.arange(len(shift))
        ids = self.flat[shift]
        if end is not None:
            out = np.full(len(ids) + len(n), end, np.uint32)
            hold = np.ones(len(out), bool)
            hold[starts[1:] + np.arange(len(n))] = False
            out[hold] = ids
            ids, starts = out, starts + np.arange(len(starts))
        return ids, starts


def _leaves_words(form: dict) -> bool:
    """Whether a tokenizer (its JSON) takes a word of lower-case letters of ASCII and Latin-1 to its model as it is, as UTF-8 bytes."""
    steps = (form.get("normalizer") or {}).get("normalizers", [])
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    pre = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in (form.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return all(x in known for x in steps) and pre == [split, level] and all(x["content"].isascii() and not x["content"].isalpha() for x in form["added_tokens"])


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """This worker's encoder: its pieces serve later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, end: int | None, bounds: list[int]) -> DataFrame:
    """(bucket, doc_id, ids): ids as little-endian uint16 (uint32 for vocabularies beyond 65,536)."""
    reachable(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        fresh("encoding")
        to = encoder(path)
        kind = "<u2" if max(to.tok.get_vocab_size(), end or 0) <= 1 << 16 else "<u4"
        edge = np.array(bounds, np.int64)
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                raw, off = text_bytes(b.column(1).slice(lo, hi - lo))
                ids, at = to.encode_bytes(raw[off[0] : off[-1]], off - off[0], end)
                ids = ids.astype(kind)
                who = b.column(0).slice(lo, hi - lo)
                bucket = np.where(who.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edge, who.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), who, pa.array([ids[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket int, doc_id long, ids binary")


def write_shards(docs: DataFrame, path: str, end: int | None = 1, shard_tokens: int = 1 << 20, name: str = "tokens") -> DataFrame:
    """Encode docs(doc_id, text) and write the shards in ascending doc_id order; returns the written table."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.lit([i / (2 * parts) for i in range(1, 2 * parts)]), F.lit(10000))).first()[0]
    coded = encode(docs, path, end, sorted(set(bounds or [])))
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(path).get_vocab_size(), end or 0) > 1 << 16
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64()), ("body", pa.binary())])

    def run(batches):
        fresh("shards")
        bucket, seq, ids, who, size, held = None, 0, [], [], [], 0

        def shard():
            places = np.r_[0, np.cumsum(size)]
            flat = np.frombuffer(b"".join(ids), "<u4" if wide else "<u2")
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, seq, len(flat), len(who), pack(flat, np.array(who, np.int64), places)), schema)], schema=schema)

        for b in batches:
            for k, d, x in zip(*(b.column(i) for i in range(3))):
                k, d, x = k.as_py(), d.as_py(), x.as_py()
                if who and (k != bucket or held >= shard_tokens):
                    yield shard()
                    seq, ids, who, size, held = (seq + 1 if k == bucket else 0), [], [], [], 0
                bucket = k
                ids.append(x)
                who.append(NULL_ID if d is None else d)
                size.append(len(x) // (4 if wide else 2))
                held += size[-1]
        if who:
            yield shard()

    ordered = coded.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return stored(ordered.mapInArrow(run, "bucket int, seq int, tokens long, documents long, body binary"), name)


#: How a null doc_id is written.
NULL_ID = -(1 << 63)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the shards by random access."""
    reachable(shards.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                s = Shard(b.column(2)[k].as_py())
                n = len(s.doc_ids)
                sums = [zlib.crc32(s.tokens(int(s.places[i]), int(s.places[i + 1])).astype("<u4").tobytes()) for i in range(n)]
                who = pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * n, pa.int32()), pa.array([b.column(1)[k].as_py()] * n, pa.int32()), who, pa.array(s.places[:-1]), pa.array(np.diff(s.places)), pa.array(sums, pa.int64())], schema=schema)

    rows = shards.select("bucket", "seq", "body").mapInArrow(run, "bucket int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    sizes = shards.select("bucket", "seq", "tokens")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, a fixed number of them
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bucket = sizes.groupBy("bucket").agg(F.sum("tokens").alias("t")).select("bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    first = sizes.select("bucket", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inner")).join(bucket, "bucket").select("bucket", "seq", (F.col("base") + F.col("inner")).alias("first"))
    return rows.join(first, ["bucket", "seq"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
