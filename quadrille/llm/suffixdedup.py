"""Removal of repeated 50-byte strings by prefix-free parsing (operator 2)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bound_batches, dealt_table, materialize, small_batches, temporary, text_of
from .neardup import mix

U = np.uint64
CHUNK = 1 << 16  # windows hashed at a time, so that work arrays stay in cache
_rng = np.random.default_rng(20250102)
TABLES = [_rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
BASES = [int(x) * 2 + 1 for x in _rng.integers(2**61, 2**62, 2)]
NO_ID = np.iinfo(np.int64).max
SIDE = "part int, kind int, bucket int, rid long, s long, e long, body binary"
COPY, AGAIN, WINDOWS = range(3)  # kinds of rows that a part gets: a copied phrase, bits for its anchors, bits for its windows


def rolling(data: np.ndarray, lengths: list[int], which: int = 0) -> list[np.ndarray]:
    """Polynomial hashes mod 2^64 of every substring of each length, by doubling."""
    base = BASES[which]
    power = lambda n: U(pow(base, n, 2**64))
    two = [TABLES[which][data]]
    while 1 << len(two) <= max(lengths):
        h, n = two[-1], 1 << (len(two) - 1)
        two.append(h[: max(0, len(h) - n)] * power(n) + h[n:])
    out = []
    for length in lengths:
        a = length.bit_length() - 1
        cur, held = two[a], 1 << a
        for b in range(a - 1, -1, -1):
            if length >> b & 1:
                n = max(0, len(data) - held - (1 << b) + 1)
                cur = cur[:n] * power(1 << b) + two[b][held : held + n]
                held += 1 << b
        out.append(cur[: max(0, len(data) - length + 1)])
    return out


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data that begin at starts, compared to `depth` bytes, and the LCP array.

    Bytes are compared eight at a time, as big-endian numbers.  lcp[i] is the length, at most `depth`, of
    what the suffixes of order[i - 1] and order[i] have in common; lcp[0] is 0.  Every suffix must have
    `depth` bytes.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    wide[:, :depth] = np.lib.stride_tricks.sliding_window_view(data, depth)[starts]
    words = wide.view(">u8").astype(U)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    apart = words[1:] ^ words[:-1]
    at = np.argmax(apart != 0, 1)
    differs = apart[np.arange(n - 1), at]
    same = np.zeros(n - 1, np.int64)
    for k in range(1, 8):  # equal leading bytes of the first word that differs
        same += differs < U(1 << 8 * k)
    lcp = np.where(differs == 0, depth, at * 8 + same)
    return order, np.concatenate([[0], np.minimum(lcp, depth)])


def sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    n = 1
    while 2 * n <= span:
        v = np.minimum(v[:-n], v[n:]) if len(v) > n else v[:0]
        n *= 2
    rest = span - n
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


class Texts:
    """Concatenated texts of a group of rows, and which window starts count."""

    def __init__(self, ids, texts, width: int):
        self.raw, self.off = arrow_bytes(texts)
        self.width = width
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        step = np.zeros(len(self.raw) + 1, np.int32)
        s, e = self.off[:-1], self.off[1:]
        bad = np.where(self.ids == NO_ID, s, np.maximum(s, e - (width - 1)))
        np.add.at(step, bad, 1)
        np.add.at(step, e, -1)
        self.valid = np.cumsum(step, dtype=np.int32)[:-1] == 0

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def chunks(self, need: np.ndarray):
        """(first window, window count, bytes) of the stretches that hold a needed window."""
        for lo in range(0, len(self.raw), CHUNK):
            n = min(CHUNK, len(self.raw) - lo - self.width + 1)
            if n > 0 and need[lo : lo + n].any():
                yield lo, n, self.raw[lo : lo + n + self.width - 1]

    def triggers(self, modulus: int) -> np.ndarray:
        """Window starts at which the parse is cut: those whose hash is 0 in the modulus."""
        least = U((1 << 64) // modulus)
        found = [lo + np.flatnonzero((mix(rolling(data, [self.width])[0]) < least) & self.valid[lo : lo + n]) for lo, n, data in self.chunks(self.valid)]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def phrases(self, modulus: int):
        """(row, start, end) of all phrases: neighbours overlap in the trigger string, so every window lies in one."""
        cut = self.triggers(modulus)
        at = np.searchsorted(cut, self.off)
        for r in range(len(self.off) - 1):
            s, e = int(self.off[r]), int(self.off[r + 1])
            if e - s < self.width or self.ids[r] == NO_ID:
                continue
            t = cut[at[r] : at[r + 1]].tolist()
            starts = t if t and t[0] == s else [s, *t]
            for a, b in zip(starts, [*(x + self.width for x in starts[1:]), e]):
                yield r, a, b


class Part(Texts):
    """The rows of one part with what earlier passes found about them."""

    def __init__(self, left: pa.Table, side: pa.Table, width: int, gram: int):
        left = left.sort_by("rid").combine_chunks()
        super().__init__(left.column("doc_id"), left.column("text"), width)
        self.gram, self.doc_ids = gram, left.column("doc_id")
        rids = left.column("rid").to_numpy()
        kind = side.column("kind").to_numpy()
        copied = side.filter(pa.array(kind == COPY))
        base = self.off[np.searchsorted(rids, copied.column("rid").to_numpy())]
        self.copied = (base + copied.column("s").to_numpy(), base + copied.column("e").to_numpy())
        replies = side.filter(pa.array(kind != COPY))
        self.replies: dict[int, dict[int, bytes]] = {AGAIN: {}, WINDOWS: {}}
        for k, b, body in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "body"))):
            self.replies[k][b] = body
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, self.copied[0], 1)
        np.add.at(step, self.copied[1] - (width - 1), -1)
        self.fine = self.valid & (np.cumsum(step, dtype=np.int32)[:-1] == 0)
        self.runs = self.anchors()

    def anchors(self):
        """Runs of windows that share their least-hashed gram: (hash, row, first window, end)."""
        span = self.width - self.gram + 1
        hashes, begin, end = [], [], []
        for lo, n, data in self.chunks(self.fine):
            g = mix(rolling(data, [self.gram])[0])
            v = (g & ~U(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
            at = (sliding_min(v, span)[:n] & U(0xFFFFFF)).astype(np.int64)
            ok = self.fine[lo : lo + n]
            change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]))
            stop = np.append(change[1:], n)
            keep = ok[change]
            hashes.append(mix(g[at[change[keep]]] ^ U(0x5851F42D4C957F2D)))  # the least hashes of their windows are small: spread them anew
            begin.append(lo + change[keep])
            end.append(lo + stop[keep])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        begin = cat(begin, np.int64)
        return cat(hashes, U), self.row_of(begin), begin, cat(end, np.int64)

    def anchor_list(self):
        """Distinct anchor hashes in order, which of them several documents of this part have, how many runs have each, and each run's entry."""
        distinct, inverse, count = np.unique(self.runs[0], return_inverse=True, return_counts=True)
        doc = self.ids[self.runs[1]]
        low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -(2**63), np.int64)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        return distinct, low != high, count, inverse

    def wanted(self, buckets: int):
        """The runs whose anchor several documents have: those that are sent whole, and those of common anchors."""
        distinct, again, _, inverse = self.anchor_list()
        common = np.zeros(len(distinct), bool)
        for b, i, j in slices(distinct, buckets):
            if b in self.replies[AGAIN]:
                bits = np.unpackbits(np.frombuffer(self.replies[AGAIN][b], np.uint8), count=2 * (j - i)).astype(bool)
                again[i:j] |= bits[: j - i]
                common[i:j] = bits[j - i :]
        return np.flatnonzero(again[inverse] & ~common[inverse]), np.flatnonzero(again[inverse] & common[inverse])

    def strings(self, buckets: int):
        """What this part sends to the dictionary: [(entries, first window and entry of each of this part's strings, first bucket)].

        Runs of windows are sent whole, by anchor; the windows of common anchors one by one, by their own
        hash.  Each distinct string is sent once, with the least document that has it here.
        """
        whole, single = self.wanted(buckets)
        h, _, begin, end = self.runs
        begin, end = begin[whole], end[whole]
        runs = Entries.of(self, h[whole], begin, end - begin, 2 * self.width - self.gram)
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, self.runs[2][single], 1)
        np.add.at(step, self.runs[3][single], -1)
        need = np.cumsum(step, dtype=np.int32)[:-1] > 0
        pos, key = [np.empty(0, np.int64)], [np.empty(0, U)]
        for lo, n, data in self.chunks(need):
            own = np.flatnonzero(need[lo : lo + n])
            pos.append(lo + own)
            key.append(mix(rolling(data, [self.width])[0][own]))
        pos = np.concatenate(pos)
        windows = Entries.of(self, np.concatenate(key), pos, np.ones(len(pos), np.int64), self.width)
        return [(runs, 0), (windows, buckets)]


class Entries:
    """Distinct strings of a part, ordered by hash: the part of the dictionary that may occur elsewhere.

    hash, windows (how many window starts each has), least (document), at (where it stands in the part's
    bytes); and begin, inverse: the first window and the entry of each string that was put in.
    """

    @classmethod
    def of(cls, part: Part, h: np.ndarray, begin: np.ndarray, windows: np.ndarray, longest: int) -> Entries:
        out = cls()
        out.width, out.begin, out.inverse = part.width, begin, np.empty(len(h), np.int64)
        order = np.argsort(h, kind="stable")
        fresh = np.zeros(len(h), bool)
        at, entries = np.arange(longest), 0
        for lo in range(0, len(h), 8192):  # a string that is met in two of these is sent twice, which does no harm
            own = order[lo : lo + 8192]
            grid = part.raw[np.minimum(begin[own, None] + at, len(part.raw) - 1)]
            grid[at >= (windows[own] + part.width - 1)[:, None]] = 0
            key = np.concatenate([h[own].astype(">u8").view(np.uint8).reshape(-1, 8), windows[own, None].astype(np.uint8), grid], 1)
            _, first, inverse = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
            out.inverse[own] = entries + inverse.ravel()
            fresh[own[first]] = True
            entries += len(first)
        number = np.empty(entries, np.int64)
        number[out.inverse[fresh]] = np.flatnonzero(fresh)
        out.hash, out.windows, out.at = h[number], windows[number], begin[number]
        out.least = np.full(len(number), NO_ID)
        out.doc = part.ids[part.row_of(begin)]
        np.minimum.at(out.least, out.inverse, out.doc)
        return out

    def messages(self, raw: np.ndarray, own: int, buckets: int, first: int):
        for b, i, j in slices(self.hash, buckets):
            n = self.windows[i:j] + self.width - 1
            yield first + b, own, (j - i).to_bytes(8, "little") + self.least[i:j].tobytes() + self.windows[i:j].astype(np.uint8).tobytes() + raw[spread(self.at[i:j], n)].tobytes()

    def gone(self, replies: dict[int, bytes], buckets: int, first: int) -> np.ndarray:
        """Window starts of the part's strings that an earlier document has too."""
        before = np.concatenate([[0], np.cumsum(self.windows)])
        hit = np.zeros(before[-1], bool)
        for b, i, j in slices(self.hash, buckets):
            if first + b in replies:
                n = int(before[j] - before[i])
                hit[before[i] : before[j]] = np.unpackbits(np.frombuffer(replies[first + b], np.uint8), count=n).astype(bool)
        n = self.windows[self.inverse]
        later = np.repeat(self.doc > self.least[self.inverse], n)
        return spread(self.begin, n)[later | hit[spread(before[self.inverse], n)]]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) for each start."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def slices(h: np.ndarray, buckets: int):
    """(bucket, first, end) of the non-empty buckets of sorted hashes."""
    b = bucket_of(h, buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(h) else np.empty(0, np.int64)
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cut, [*cut[1:], len(h)])]


def message(parts: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([x[0] for x in parts], pa.int32()), "part": pa.array([x[1] for x in parts], pa.int32()), "body": pa.array([x[2] for x in parts], pa.binary())})


def reply(kind: int, bucket: int, parts: list[int], bodies: list[bytes]) -> pa.Table:
    n = len(parts)
    null = pa.nulls(n, pa.int64())
    return pa.table([pa.array(parts, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), null, null, null, pa.array(bodies, pa.binary())], names=["part", "kind", "bucket", "rid", "s", "e", "body"])


def meet_anchors(table: pa.Table, common: int) -> pa.Table:
    """For each part's anchors of a bucket: a bit for those that another part has too, then one for those of more than `common` runs in all."""
    parts, bodies = table.column("part").to_pylist(), table.column("body").to_pylist()
    counts = [len(b) // 10 for b in bodies]
    every = np.concatenate([np.frombuffer(b, U, n) for b, n in zip(bodies, counts)])
    runs = np.concatenate([np.frombuffer(b, np.uint16, n, 8 * n) for b, n in zip(bodies, counts)]).astype(np.int64)
    _, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    often = np.bincount(inverse, runs)[inverse] > common
    out, at = [], 0
    for p, n in zip(parts, counts):
        bits = np.concatenate([again[at : at + n], often[at : at + n]])
        at += n
        if bits.any():
            out.append((p, np.packbits(bits).tobytes()))
    return reply(AGAIN, table.column("bucket")[0].as_py(), [x[0] for x in out], [x[1] for x in out])


def meet_strings(table: pa.Table, width: int) -> pa.Table:
    """For each part's strings of a bucket: a bit for each window that a document before the string's own first has.

    The strings are a piece of the dictionary; its suffix array, to a depth of `width` bytes, puts equal
    windows side by side, where the LCP array is `width`.
    """
    parts, bodies = table.column("part").to_pylist(), table.column("body").to_pylist()
    least, windows, text = [], [], []
    for b in bodies:
        n = int.from_bytes(b[:8], "little")
        least.append(np.frombuffer(b, np.int64, n, 8))
        windows.append(np.frombuffer(b, np.uint8, n, 8 + 8 * n).astype(np.int64))
        text.append(np.frombuffer(b, np.uint8, offset=8 + 9 * n))
    every = np.concatenate(windows)
    length = every + width - 1
    starts = spread(np.cumsum(length) - length, every)
    doc = np.repeat(np.concatenate(least), every)
    order, lcp = suffix_array(np.concatenate(text), starts, width)
    first = np.flatnonzero(lcp < width)
    lowest = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    hit = np.empty(len(order), bool)
    hit[order] = lowest < doc[order]
    out, at = [], 0
    for p, w in zip(parts, windows):
        n = int(w.sum())
        if hit[at : at + n].any():
            out.append((p, np.packbits(hit[at : at + n]).tobytes()))
        at += n
    return reply(WINDOWS, table.column("bucket")[0].as_py(), [x[0] for x in out], [x[1] for x in out])


def remove_repeats(docs: DataFrame, width: int = 50, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 256, gram: int = 20, part_bytes: int = 4 << 20, bucket_bytes: int = 1 << 20, common: int = 1 << 12) -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts in a document with a smaller id.

    1. Parse: a rolling hash over `width`-byte windows cuts texts into phrases that overlap in the trigger
       string, so that every window lies in one phrase.  The dictionary has each distinct phrase once, in
       the first document that has it; the parse, sorted by phrase, gives each phrase's interval of
       documents, and one that a smaller document has too goes as a whole.  As triggers are as wide as the
       strings sought, each lies in one phrase: corpus order to that depth is that of the dictionary's
       suffixes, each with the interval of its phrase, and later phrases don't matter.
    2. Dictionary: its suffix array, to a depth of `width` bytes, is made in pieces that hold equal suffixes
       together.  A window's piece is that of its least-hashed gram, its anchor.  Parts of the documents
       first learn which anchors occur elsewhere; the rest of their windows is unique.
    3. Runs of windows of such an anchor go to the anchor's piece as strings of bytes, each distinct one
       once a part, with the first document that has it there.  A piece sorts their suffixes and finds
       equal neighbours in the LCP array; each part learns which windows an earlier document has.
    An anchor with more than `common` runs, such as one in a line that a third of all documents share, is
    split: its windows go singly, to pieces by their own hash, each once a part.  So a piece holds
    about `bucket_bytes` windows at most, however often a string occurs.  Texts cross the network once, to
    parts that are written so that later passes find them in place; only bits come back.

    Returns doc_id, n_bytes, spans (array of start, end: maximal removed runs of bytes) and kept (the
    remaining bytes).  Cases: a null text is empty; texts shorter than `width` are kept whole; a text of
    any length is one row of one part; a null id neither removes nor loses anything; rows that repeat an
    id don't remove each other, and equal rows are dealt to parts like any others; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    if not gram <= width < gram + 255:
        raise ValueError("width must be at least gram and less than gram + 255")
    bound_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(8, -(-total // part_bytes))
    n_buckets = max(8, -(-total // bucket_bytes))
    files = min(n_parts, max(-(-n_parts // 4), spark.sparkContext.defaultParallelism), 100_000)
    dealt = slim.withColumn("rid", F.monotonically_increasing_id()).select(F.pmod(F.xxhash64("rid"), F.lit(n_parts)).cast("int").alias("part"), "rid", "doc_id", "text")
    with temporary(spark):
        dealt = dealt_table(dealt, "pfp-parts", "part", files, keep=True)

        def parse(batches):
            for b in small_batches(batches, 3):
                t = Texts(b.column(2), b.column(3), width)
                row, start, end, key = [], [], [], []
                for r, s, e in t.phrases(modulus):
                    row.append(r), start.append(s - int(t.off[r])), end.append(e - int(t.off[r]))
                    key.append(hashlib.blake2b(t.raw[s:e].tobytes(), digest_size=16).digest())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(b.column(i).take(at) for i in (2, 0, 1)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["key", "doc_id", "part", "rid", "s", "e"])

        phrases = materialize(dealt.mapInArrow(parse, "key binary, doc_id long, part int, rid long, s long, e long"), "pfp-parse")
        owners = materialize(phrases.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "pfp-owner")
        none = lambda t: F.lit(None).cast(t)
        copied = phrases.join(owners, "key").where("doc_id > owner")
        side = materialize(copied.select("part", F.lit(COPY).alias("kind"), none("int").alias("bucket"), "rid", "s", "e", none("binary").alias("body")), "pfp-copied", keep=True)

        def send_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return message([])
            distinct, _, count, _ = Part(left, right, width, gram).anchor_list()
            count = np.minimum(count, 65535).astype(np.uint16)
            return message([(b, left.column("part")[0].as_py(), distinct[i:j].tobytes() + count[i:j].tobytes()) for b, i, j in slices(distinct, n_buckets)])

        def send_strings(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return message([])
            p = Part(left, right, width, gram)
            return message([m for e, first in p.strings(n_buckets) for m in e.messages(p.raw, left.column("part")[0].as_py(), n_buckets, first)])

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            longs = pa.list_(pa.int64())
            if not left.num_rows:
                return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "starts": pa.array([], longs), "ends": pa.array([], longs), "kept": pa.array([], pa.binary())})
            p = Part(left, right, width, gram)
            step = np.zeros(len(p.raw) + 1, np.int32)
            np.add.at(step, p.copied[0], 1)
            np.add.at(step, p.copied[1], -1)
            for e, first in p.strings(n_buckets):
                hit = e.gone(p.replies[WINDOWS], n_buckets, first)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + width, -1)
            gone = np.cumsum(step, dtype=np.int32)[:-1] > 0
            starts, ends, kept = [], [], []
            for s, e in zip(p.off[:-1].tolist(), p.off[1:].tolist()):
                own = gone[s:e]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                starts.append(edge[::2])
                ends.append(edge[1::2])
                kept.append((p.raw[s:e] if not len(edge) else p.raw[s:e][~own]).tobytes())
            return pa.table({"doc_id": p.doc_ids, "n_bytes": pa.array(np.diff(p.off), pa.int64()), "starts": pa.array(starts, longs), "ends": pa.array(ends, longs), "kept": pa.array(kept, pa.binary())})

        def with_side(f, schema, *sides: DataFrame) -> DataFrame:
            every = sides[0]
            for s in sides[1:]:
                every = every.unionByName(s)
            return dealt.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(f, schema)

        sent = "bucket int, part int, body binary"
        anchors = with_side(send_anchors, sent, side).groupBy("bucket").applyInArrow(lambda t: meet_anchors(t, common), SIDE)
        anchors = materialize(anchors, "pfp-anchors", keep=True)
        windows = with_side(send_strings, sent, side, anchors).groupBy("bucket").applyInArrow(lambda t: meet_strings(t, width), SIDE)
        windows = materialize(windows, "pfp-windows", keep=True)
        out = with_side(finish, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary", side, anchors, windows)
    return out.select("doc_id", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
