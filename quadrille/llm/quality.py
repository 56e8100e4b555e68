"""Quality rules: document statistics and gradient-boosted trees (operator 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, arrow_bytes, bound_batches, small_batches, text_of

#: The symbols that count.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_lines", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "top_word", "words_a_line")
#: The score may only fall as these features rise.
FALLING = ("symbol_share", "dup_lines", "repeat_share", "upper_share", "top_word")
IS_WHITE, IS_SYMBOL, IS_UPPER, IS_DIGIT, IS_PUNCT = (np.zeros(256, np.uint8) for _ in range(5))
IS_WHITE[list(WHITE)] = 1
IS_SYMBOL[list(SYMBOLS)] = 1
IS_UPPER[65:91] = 1
IS_DIGIT[48:58] = 1
IS_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def repeats(words: list[bytes]) -> tuple[int, int, int]:
    """(words in 3-word windows found twice or more, distinct words, count of the commonest word)."""
    n = len(words)
    if not n:
        return 0, 0, 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    top = int(np.bincount(a).max())
    if n < 4:
        return 0, len(ids), top
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0, len(ids), top
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum()), len(ids), top


def statistics(texts) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES (floats) of each text of an Arrow string column."""
    raw, off = arrow_bytes(texts)

    def share(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    white = IS_WHITE[raw]
    chars = share(((raw & 0xC0) != 0x80) & (white == 0))
    symbols, upper, digit, punct = (share(t[raw]) for t in (IS_SYMBOL, IS_UPPER, IS_DIGIT, IS_PUNCT))
    whole, ends = raw.tobytes(), off.tolist()
    n = len(ends) - 1
    words, dup, repeat, distinct, top, lines = (np.zeros(n, np.int64) for _ in range(6))
    for i in range(n):
        text = whole[ends[i] : ends[i + 1]]
        own = text.split()
        words[i] = len(own)
        repeat[i], distinct[i], top[i] = repeats(own)
        full = [x for x in text.split(b"\n") if x.strip(WHITE)]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    counts = np.stack([words, chars, symbols, dup, repeat], 1)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    features = np.stack([np.log1p(words), chars / w, symbols / c, dup / np.maximum(lines, 1), repeat / w, distinct / w, upper / c, digit / c, punct / c, top / w, words / np.maximum(lines, 1)], 1)
    return counts, features


@dataclass
class Trees:
    """Boosted trees as flat node arrays: feature (-1: leaf), threshold (go left if <=), left child, value; right is left + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + right)
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10, falling=FALLING, names=FEATURES) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    A split on a falling feature is refused if its right child would be worth more than its left; the
    children's values are then bounded by the middle of the two, so that no deeper split can break the
    order either.
    """
    sign = np.array([-1 if n in falling else 0 for n in names])
    feature, threshold, left, value, roots = [], [], [], [], []
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    f = np.full(len(y), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, x.shape[1]), int)

    def leaf() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    worth = lambda g, h, lo, hi: np.clip(-g / (h + l2), lo, hi)
    gain = lambda g, h, w: -(g * w + 0.5 * (h + l2) * w * w)

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)
        root = leaf()
        roots.append(root)
        queue = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while queue:
            node, rows, lo, hi, d = queue.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            w = float(worth(gs, hs, lo, hi))
            best = (1e-6, None)
            for j in range(x.shape[1]) if d < depth and len(rows) >= 2 * least else ():
                k = len(edges[j])
                if not k:
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, a, k + 1))[:k] for a in (g[rows], h[rows], np.ones(len(rows))))
                wl, wr = worth(gl, hl, lo, hi), worth(gs - gl, hs - hl, lo, hi)
                got = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - gain(gs, hs, w)
                got[(nl < least) | (len(rows) - nl < least)] = -np.inf
                if sign[j] < 0:
                    got[wr > wl] = -np.inf
                i = int(np.argmax(got))
                if got[i] > best[0]:
                    best = (got[i], (j, i, float(wl[i]), float(wr[i])))
            if best[1] is None:
                value[node] = rate * w
                f[rows] += rate * w
                continue
            j, i, wl, wr = best[1]
            a, b = leaf(), leaf()
            feature[node], threshold[node], left[node] = j, float(edges[j][i]), a
            go = binned[rows, j] <= i
            mid = (wl + wr) / 2
            lows, highs = ((mid, lo), (hi, mid)) if sign[j] < 0 else ((lo, lo), (hi, hi))
            queue += [(a, rows[go], lows[0], highs[0], d + 1), (b, rows[~go], lows[1], highs[1], d + 1)]
    arrays = [np.array(v, t) for v, t in ((feature, np.int64), (threshold, float), (left, np.int64), (value, float), (roots, np.int64))]
    return Trees(*arrays, base=base, depth=depth)


def train(docs: DataFrame, labels: DataFrame, *, most: int = 20_000, label_col: str = "quality") -> Trees:
    """Trees fitted on at most `most` labelled documents, those with the smallest hash of doc_id.

    The bound keeps the ids that are broadcast, and the rows that reach the driver, of fixed size: one a
    label, of several texts under its id that with the least statistics.  A document labelled twice
    counts with its worst label; unlabelled documents don't count.  Without
    labels of both kinds the model keeps what the base rules keep.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).join(F.broadcast(sample), "_id").select("_id", "_y", "text")

    def run(batches):
        for b in small_batches(batches, 2):
            _, x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["_id", "_y", "x"])

    one = texts.mapInArrow(run, "_id long, _y double, x array<double>").groupBy("_id").agg(F.min(F.struct("_y", "x")).alias("a"))
    rows = sorted((r._id, r.a._y, r.a.x) for r in one.collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Trees(*(np.zeros(0, np.int64) for _ in range(5)), base=1.0, depth=0)
    return fit_trees(x, y)


def quality_rules(docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), least_words: int = 50, cut: float = 0.5, model: Trees | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, score (the trees' probability of good) and kept; then the `carry` columns.

    Base rules: fewer than `least_words` words, or more than half of the words in repeated 3-word
    windows, fail.  What passes them is kept if its score is at least `cut`.  One pass over the
    documents, no shuffle.

    Cases: a null text has no words and fails; null ids and repeated rows are kept as rows; texts of any
    length are read whole; a score that ties with `cut` is kept; an empty table gives no rows; columns not
    in `carry` are ignored.
    """
    bound_batches(docs.sparkSession)
    model = model or train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    extra = [f"_c{i}" for i in range(len(carry))]

    def run(batches):
        trees = spread.value
        for b in small_batches(batches, 1):
            counts, x = statistics(b.column(1))
            p = 1 / (1 + np.exp(-trees.score(x)))
            failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > 50 * counts[:, 0])
            cols = [b.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= cut))]
            yield pa.RecordBatch.from_arrays(cols + [b.column(2 + i) for i in range(len(extra))], ["doc_id", *COUNTS, "base_failed", "score", "kept", *extra])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean" + "".join(f", {c} {kinds[c]}" for c in extra)
    return slim.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels)
