"""Benchmark decontamination by latent semantic retrieval (operator 1)."""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bound_batches, each_bytes, materialize, small_batches, temporary, text_of

#: Words: runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased; the rest separates them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW, STRIDE = 24, 12
KEEP = 8  # of each passage of an item, so many of its rarest words are features
RANK, EXTRA = 384, 16
ITEM_WEIGHT = 8.0
COSINE = 0.4
LEAK, PARAPHRASE = 0.8, 0.6
SAMPLE = 3_000  # so many documents weigh as much in the fit as all of a larger table do, so that items keep their part at any size
UNIT = 1 << 24
BLOCK_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def answer_of(text: str | None) -> list[bytes]:
    """The words of an item's last sentence, which stand for its answer where the table has no answer of its own; of a single sentence, its last quarter."""
    parts = [w for p in re.split(r"[.!?]\s", text or "") if (w := words_of(p))]
    if not parts:
        return []
    return parts[-1] if len(parts) > 1 else parts[0][-max(1, len(parts[0]) // 4) :]


def windows(n: int) -> list[tuple[int, int]]:
    """Passages of n words: WINDOW words every STRIDE, the last one flush with the end."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def masks(a: list[bytes]) -> dict[bytes, int]:
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def lcs(where: dict[bytes, int], n: int, b: list[bytes]) -> int:
    """Length of the longest common subsequence of b and the n words that `where` has, bit-parallel."""
    full = v = (1 << n) - 1
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Items:
    """A block of benchmark items: vocabulary, passages, and the words and answers to check."""

    def __init__(self, rows: list[tuple[int, str]], answers: dict[int, str] | None = None):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.answers = [words_of(answers[i]) if answers and answers.get(i) else answer_of(t) for i, t in rows]
        self.vocab = {w: n for n, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.passages = [(k, a, b) for k, ws in enumerate(self.words) for a, b in windows(len(ws))]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary number of each word; len(vocab) for others."""
        other = len(self.vocab)
        get = self.vocab.get
        return np.fromiter(map(get, words, repeat(other)), np.int32, len(words))

    def narrowed(self, idf: np.ndarray) -> tuple[Items, np.ndarray]:
        """The same items with only the KEEP rarest words of each passage as features, and the features' weights."""
        rare: set[bytes] = set()
        for k, a, b in self.passages:
            rare.update(sorted(set(self.words[k][a:b]), key=lambda w: (-idf[self.vocab[w]], w))[:KEEP])
        out = copy.copy(self)
        out.vocab = {w: n for n, w in enumerate(sorted(rare))}
        return out, np.array([idf[self.vocab[w]] for w in out.vocab])


def window_sums(x: np.ndarray, spans: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[spans[:, 1]] - total[spans[:, 0]]


def document_frequency(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each benchmark word occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        it = shared.value
        known = frozenset(it.vocab)
        for b in batches:
            seen: Counter = Counter()
            n = 0
            raw, off = arrow_bytes(b.column(0))
            folded, off = raw.tobytes().translate(FOLD), off.tolist()
            for s, e in zip(off[:-1], off[1:]):
                seen.update(known.intersection(folded[s:e].split()))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([-1, *(it.vocab[w] for w in seen)], pa.int32()), pa.array([n, *seen.values()], pa.int64())], ["w", "n"])

    df = np.zeros(len(items.vocab))
    total = 0
    for r in docs.mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        if r.w < 0:
            total = r["n"]
        else:
            df[r.w] = r["n"]
    return df, total


def summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of each one's values."""
    if not len(codes):
        return codes, values
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(values, first)


def passage_pairs(flat: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A'A of the passages A of texts given by their word numbers, one after another: codes a * features + b with a <= b, and sums in units of 1 / UNIT.

    A passage is a TF-IDF row of length 1 over the features that occur in it.  Products are rounded to
    whole units one by one, so that sums are the same in any order.
    """
    none = len(weight)
    hits = np.flatnonzero(flat < none)
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, hits, "right")
    at = hits - (ends - lengths)[doc]
    last = np.maximum(0, -((WINDOW - lengths) // STRIDE))  # of each text, the number of its last passage
    first = np.cumsum(last + 1) - last - 1
    within = [(at // STRIDE - back, (at // STRIDE >= back) & (at // STRIDE - back < last[doc]) & (at < (at // STRIDE - back) * STRIDE + WINDOW)) for back in range(-(-WINDOW // STRIDE))]
    within.append((last[doc], at >= lengths[doc] - WINDOW))
    key, n = np.unique(np.concatenate([((first[doc] + w) * none + flat[hits])[ok] for w, ok in within]), return_counts=True)
    row, feature = np.divmod(key, max(1, none))
    x = n * weight[feature]
    own = np.cumsum(np.append(False, row[1:] != row[:-1])) if len(row) else row
    x = x / np.maximum(np.sqrt(np.bincount(own, x * x)), 1e-12)[own]
    codes, values = [key[:0]], [key[:0]]
    for d in range(WINDOW):
        same = np.flatnonzero(row[d:] == row[: len(row) - d])
        if not len(same):
            break
        codes.append(feature[same] * none + feature[same + d])
        values.append(np.rint(x[same] * x[same + d] * UNIT).astype(np.int64))
    return summed(np.concatenate(codes), np.concatenate(values))


def gram(docs: DataFrame, own: DataFrame, items: Items, weight: np.ndarray, share: float) -> DataFrame:
    """A'A (a, b, v; both triangles) over the TF-IDF passages A of all documents, counted `share` times, and of the items; each column holds texts.

    Each task sums its own passages, and sends on its sums when they are many; small arrays, as a Python worker keeps what it once took.
    """
    shared = docs.sparkSession.sparkContext.broadcast((items, weight))
    most, rows = 1 << 18, 1 << 14

    def run(batches):
        it, weight = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent():
            codes, values = summed(*map(np.concatenate, zip(*held)))
            for i in range(0, len(codes), rows):
                a, b = np.divmod(codes[i : i + rows], len(weight))
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(values[i : i + rows])], ["a", "b", "n"])

        for b in small_batches(batches, 0, 1 << 19):
            raw, off = arrow_bytes(b.column(0))
            folded, off = raw.tobytes().translate(FOLD), off.tolist()
            words = [folded[s:e].split() for s, e in zip(off[:-1], off[1:])]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            held.append(passage_pairs(it.numbers(list(chain.from_iterable(words))), lengths, weight))
            size += len(held[-1][0])
            if size > most:
                held[:] = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > most // 2:
                    yield from sent()
                    held.clear()
                    size = 0
        if size:
            yield from sent()

    parts = [d.mapInArrow(run, "a int, b int, n long").withColumn("own", F.lit(of_items)) for d, of_items in ((docs, False), (own, True))]
    n = [F.sum(F.when(F.col("own") == of_items, F.col("n")).otherwise(F.lit(0))) for of_items in (False, True)]
    v = (n[0] * F.lit(share) + n[1] * F.lit(ITEM_WEIGHT**2)) / F.lit(UNIT)
    half = parts[0].union(parts[1]).groupBy("a", "b").agg(v.alias("v"))
    there, back = F.struct("a", "b", "v"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "v")
    return half.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))))


def gram_times(a: DataFrame, q: np.ndarray, step: int = 64) -> np.ndarray:
    """The product of the matrix a (a, b, v) and q, by blocks of rows of a."""
    shared = a.sparkSession.sparkContext.broadcast(q)

    def times(t: pa.Table) -> pa.Table:
        at = t.column("at")[0].as_py()
        row, column, v = (t.column(c).to_numpy() for c in ("a", "b", "v"))
        known, column = np.unique(column, return_inverse=True)
        block = np.zeros((step, len(known)))
        block[row - at * step, column] = v
        return pa.table({"at": pa.array([at], pa.int32()), "body": pa.array([(block @ shared.value[known]).tobytes()], pa.binary())})

    out = np.zeros(q.shape)
    for r in a.withColumn("at", F.floor(F.col("a") / step).cast("int")).groupBy("at").applyInArrow(times, "at int, body binary").collect():
        own = out[r.at * step : (r.at + 1) * step]
        own[:] = np.frombuffer(bytes(r.body)).reshape(step, -1)[: len(own)]
    return out


def latent_space(a: DataFrame, features: int, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages A, from a = A'A, by randomised subspace iteration."""
    wide = min(features, rank + EXTRA)
    y = q = np.linalg.qr(np.random.default_rng(0).standard_normal((features, wide)))[0]
    before = q
    for _ in range(rounds):
        y = gram_times(a, q)
        before, q = q, np.linalg.qr(y)[0]
    small = before.T @ y  # the matrix in the last basis, whose eigenvectors order the directions
    values, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[: min(rank, wide)]
    basis = y @ turn[:, keep]
    return np.linalg.qr(basis)[0]


class Searcher:
    """Candidate search by cosine in the latent space, and the checks of candidates."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float, leak: float = LEAK, paraphrase: float = PARAPHRASE):
        self.items, self.cosine, self.least, self.paraphrase = items, cosine, min(leak, paraphrase), paraphrase
        self.weight = np.append(idf, 0.0).astype(np.float32)
        self.table = (np.vstack([space, np.zeros(space.shape[1])]) * self.weight[:, None]).astype(np.float32)
        numbers = [items.numbers(items.words[k][a:b]) for k, a, b in items.passages]
        mass = np.array([float(self.weight[n].sum()) for n in numbers])
        # no document has a word of a passage without weight
        self.passages = [p for p, m in zip(items.passages, mass) if m > 0]
        rows = np.array([self.table[n].sum(0) for n, m in zip(numbers, mass) if m > 0]).reshape(-1, space.shape[1])
        self.queries = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        # a passage whose features weigh less than a third of the lightest item passage can't be one
        self.mass = float(mass[mass > 0].min(initial=np.inf)) / 3
        self.own = [masks(w) for w in items.words]
        self.answers = [masks(w) for w in items.answers]

    def check(self, words: list[bytes], k: int, at: int) -> tuple[float, bool]:
        """Best share of an item's words that stand in order in a part near a passage, and whether any part has the paraphrase's share and the answer."""
        n, answer = len(self.items.words[k]), len(self.items.answers[k])
        region = words[max(0, at - n) : at + WINDOW + n]
        most = lcs(self.own[k], n, region) / n  # no stretch of the region can have more
        if most < self.least:
            return most, False
        best, found = 0.0, False
        width = n + n // 4 + 2
        last = max(0, len(region) - width)
        for s in [*range(0, last, max(1, n // 8)), last]:
            part = region[s : s + width]
            share = lcs(self.own[k], n, part) / n
            best = max(best, share)
            found = found or (bool(answer) and share >= self.paraphrase and lcs(self.answers[k], answer, part) == answer)
        return best, found

    def search(self, words: list[bytes]) -> dict[int, tuple[float, bool, float, int]]:
        """Of each item met: best share of words in order, whether the answer is found with a paraphrase's share, cosine and first word of the best passage."""
        n = self.items.numbers(words)
        spans = np.array(windows(len(n)), np.int64).reshape(-1, 2)
        if not len(spans):
            return {}
        heavy = spans[window_sums(self.weight[n], spans) >= self.mass]
        if not len(heavy):
            return {}
        width = min(WINDOW, len(n))
        vec = self.table[n[heavy[:, :1] + np.arange(width)]].sum(1)
        norm = np.linalg.norm(vec, axis=1, keepdims=True)
        cos = (vec / np.maximum(norm, 1e-12)) @ self.queries.T
        found: dict[int, tuple[float, bool, float, int]] = {}
        tried: set[tuple[int, int]] = set()
        for i, j in zip(*np.nonzero(cos >= self.cosine)):
            k = self.passages[j][0]
            at = int(heavy[i, 0])
            if (k, at) in tried:
                continue
            tried.add((k, at))
            share, answer = self.check(words, k, at)
            if k in found:
                answer = answer or found[k][1]
            if k not in found or (share, cos[i, j]) > (found[k][0], found[k][2]):
                found[k] = (share, answer, float(cos[i, j]), at)
            else:
                found[k] = (found[k][0], answer, *found[k][2:])
        return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, rank: int = RANK, cosine: float = COSINE, leak: float = LEAK, paraphrase: float = PARAPHRASE, sample_docs: int = SAMPLE, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (document, item) that leaks: doc_id, item_id, share, answer, cosine, word, kind; then the document's `carry` columns.

    The benchmark is taken in blocks of about `block_words` words, or of one longer item, all against all
    documents.  For a block: document frequencies of its words over all documents, which pick the rarest
    words of each item passage as features; a randomised SVD of TF-IDF passages, fitted on all passages of
    all documents and of the items (beyond `sample_docs` documents, all together weigh as much as so many,
    so that the items don't fade as the table grows; none is left out); then one scan that projects every
    passage of every document, takes as candidates those whose cosine with a passage of an item is `cosine`
    or more, and compares words: a candidate leaks if at least `leak` of the item's words stand in order
    near the passage, or at least `paraphrase` of them and its answer too.  No row is shuffled, but sums
    of pairs of features are; only the model is broadcast, whose size the block bounds.

    Cases: null texts are empty and match nothing; texts of any length are searched whole, passage by
    passage; an item without words is never found; of passages of a document that tie for an item the
    first is reported, and items that tie are all reported; null ids and repeated rows are reported like
    others; an empty benchmark or table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    extra = [f"_c{i}" for i in range(len(carry))]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, extra)])
    known = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    n_words = known.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x80-\x{10FFFF}]+")))).first()[0] or 0
    n_docs = slim.count()
    blocks = max(1, math.ceil(n_words / block_words))
    schema = "doc_id long, item_id long, share double, answer boolean, cosine double, word long, kind string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema += "".join(f", {c} {kinds[c]}" for c in extra)
    out = spark.createDataFrame([], schema)
    own_names = [*names, *[F.col(n).alias(c) for c, n in zip(carry, extra)]]
    if not n_words or not n_docs:
        return out.select(*own_names)
    with temporary(spark):
        for block in range(blocks):
            own = known.where(F.pmod(F.xxhash64("item_id", F.lit(23)), F.lit(blocks)) == block) if blocks > 1 else known
            rows = sorted((r for r in own.collect()), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
            keyed = [r for r in rows if words_of(r.text)]
            if not keyed:
                continue
            items = Items([(r.item_id, r.text) for r in keyed], {r.item_id: r.answer for r in keyed if r.answer})
            df, total = document_frequency(slim.select("text"), items)
            # a word that no document has can't lead to one
            items, weight = items.narrowed(np.where(df > 0, np.log((total + 1) / (df + 1)) + 1, 0.0))
            pairs = materialize(gram(slim.select("text"), own.select("text"), items, weight, min(1.0, sample_docs / n_docs)), "lsa-pairs")
            search = Searcher(items, weight, latent_space(pairs, len(weight), rank), cosine, leak, paraphrase)
            if not len(search.queries):
                continue
            shared = spark.sparkContext.broadcast(search)

            def run(batches, shared=shared):
                s = shared.value
                for b in batches:
                    cols: list[list] = [[] for _ in names]
                    at_row: list[int] = []
                    for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), each_bytes(b.column(1)))):
                        for k, (share, answer, cos, at) in sorted(s.search(text.translate(FOLD).split()).items()):
                            if share >= leak or (share >= paraphrase and answer):
                                at_row.append(i)
                                for c, v in zip(cols, (doc, s.items.ids[k], share, answer, cos, at, "leak" if share >= leak else "paraphrase")):
                                    c.append(v)
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.int64(), pa.string()]
                    more = [b.column(2 + i).take(pa.array(at_row, pa.int64())) for i in range(len(extra))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + more, names + extra)

            out = out.union(slim.mapInArrow(run, schema))
    return out.select(*own_names)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
