"""Minimax contiguous sharding of atomic groups (operator 8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, numbered_rows, text_of

BITS = 63


class Cells:
    """A partition of the group-key space in key order: first key, bytes, whether one group fills it, log2 of its width."""

    def __init__(self, start, size, atomic, shift):
        self.start, self.size, self.atomic, self.shift = start, size, atomic, shift
        self.cum = np.concatenate([[0], np.cumsum(size)]).astype(object if size.sum() > 2**62 else np.int64)

    @property
    def total(self) -> int:
        return int(self.cum[-1])

    def index(self, position: int) -> int:
        """The cell in which a byte position lies; at a boundary, the cell that starts there."""
        return int(np.searchsorted(self.cum, position, "right")) - 1

    def fill(self, capacity: int, shards: int, fluid: bool) -> list[int] | None:
        """Greedy end positions of the shards, or None if they don't hold everything.

        fluid: cells that hold several groups may be cut anywhere, which bounds the true optimum from
        below; else every cell is kept whole, which bounds it from above.
        """
        p, ends = 0, []
        for _ in range(shards):
            if p < self.total:
                goal = min(p + capacity, self.total)
                i = self.index(goal)
                floor = int(self.cum[i])
                p = goal if floor == goal or (fluid and not self.atomic[i]) else max(p, floor)
            ends.append(p)
        return ends if p >= self.total else None

    def least(self, shards: int, fluid: bool) -> int:
        """Smallest feasible capacity, by binary search with a greedy check."""
        lo, hi = max(1, -(-self.total // shards)), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, shards, fluid) is not None:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def unsettled(self, low: int, high: int, shards: int) -> np.ndarray:
        """Cells of several groups in which a cut may fall for some capacity in [low, high]."""
        mark = np.zeros(len(self.size), bool)
        a = b = 0
        for _ in range(shards):
            i = self.index(min(a + low, self.total - 1))
            a = max(a, int(self.cum[i])) if not self.atomic[i] or self.cum[i] > a else a
            b = min(b + high, self.total)
            j = self.index(min(b, self.total - 1))
            mark[min(i, j) : j + 1] = True
        return mark & ~self.atomic


def read_cells(groups: DataFrame, runs: list[tuple[int, int]] | None, shift: int) -> list[tuple]:
    d = groups
    if runs is not None:
        keep = F.lit(False)
        for a, b in runs:
            keep = keep | F.col("h").between(F.lit(a), F.lit(b))
        d = d.where(keep)
    d = d.groupBy(F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b"))
    return [(r.cell << shift, int(r["size"]), r.a == r.b) for r in d.collect()]


def spans(cells: Cells, mark: np.ndarray, shift: int, most: int = 64) -> tuple[list[list[int]], np.ndarray]:
    """Key ranges that hold the marked cells, at most `most` (the others' turn comes in a later pass), and all cells in them.

    A range also takes in the settled cells between two marked ones, if those are of the same width.
    """
    runs: list[list[int]] = []
    taken = np.zeros_like(mark)
    last = -1
    for i in np.flatnonzero(mark).tolist():
        if runs and (cells.shift[last:i] == shift).all():
            runs[-1][1] = int(cells.start[i]) + (1 << shift) - 1
            taken[last : i + 1] = True
        elif len(runs) < most:
            runs.append([int(cells.start[i]), int(cells.start[i]) + (1 << shift) - 1])
            taken[i] = True
        else:
            break
        last = i
    return runs, taken


def minimax_cells(groups: DataFrame, shards: int, budget: int = 1 << 13) -> tuple[Cells, int]:
    """Cells fine enough to know the optimum exactly, and that optimum.

    Each pass sums sizes over at most `budget` key ranges (all that the driver ever holds, whatever the
    input), brackets the optimum between its fluid and its whole-cell value, and splits only the cells
    in which a cut may still fall.  It ends when both values agree.
    """
    step = budget.bit_length() - 1
    shift = BITS - step
    rows = sorted(read_cells(groups, None, shift))
    cells = Cells(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool), np.full(len(rows), shift))
    while len(rows):
        low, high = cells.least(shards, True), cells.least(shards, False)
        mark = cells.unsettled(low, high, shards)
        if low == high or not mark.any():
            return cells, high
        large = ~cells.atomic & (cells.size > low)  # no cut is feasible before these are split
        mark = large if large.any() else mark
        widest = int(cells.shift[mark].max())
        runs, mark = spans(cells, mark & (cells.shift == widest), widest)
        step = max(1, min(widest, (budget // int(mark.sum())).bit_length() - 1))
        finer = read_cells(groups, [tuple(r) for r in runs], widest - step)
        rest = ~mark
        start = np.concatenate([cells.start[rest], np.array([r[0] for r in finer], np.int64)])
        order = np.argsort(start, kind="stable")
        cells = Cells(
            start[order],
            np.concatenate([cells.size[rest], np.array([r[1] for r in finer], np.int64)])[order],
            np.concatenate([cells.atomic[rest], np.array([r[2] for r in finer], bool)])[order],
            np.concatenate([cells.shift[rest], np.full(len(finer), widest - step)])[order],
        )
    return cells, 0


def even_cuts(cells: Cells, capacity: int, shards: int) -> list[int]:
    """First group key of shards 1.. : every shard within the capacity, and the smallest as large as cell boundaries allow.

    A lower bound is feasible if boundaries can be reached one shard at a time, each shard between the
    bounds; the largest such bound is found by binary search.  Work is shards times cells a step.
    """
    cum, last = cells.cum, len(cells.cum) - 1

    def reach(least: int) -> list[np.ndarray] | None:
        at = np.zeros(last + 1, bool)
        at[0] = True
        steps = [at]
        lo, hi = np.searchsorted(cum, cum - capacity, "left"), np.searchsorted(cum, cum - least, "right")
        for _ in range(shards):
            count = np.concatenate([[0], np.cumsum(steps[-1])])
            steps.append((hi > lo) & (count[hi] > count[np.minimum(lo, hi)]))
        return steps if steps[-1][last] else None

    low, high = 0, cells.total // shards
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if reach(mid) else (low, mid - 1)
    steps = reach(low)
    keys, b = [], last
    for i in range(shards - 1, 0, -1):
        ok = np.flatnonzero(steps[i] & (cum >= cum[b] - capacity) & (cum <= cum[b] - low))
        b = int(ok[np.argmin(np.abs(cum[ok] - int(cum[b]) * i / (i + 1)))])
        keys.append(int(cells.start[b]) if b < len(cells.start) else 2**BITS - 1)
    return keys[::-1]


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deal documents to shards of near-equal bytes, equal texts always together.

    Atomic groups are documents with equal texts (null counts as empty), ordered by a 63-bit hash of the
    text; a shard is a contiguous run of groups.  The capacity is the smallest for which such a cut
    exists (binary search over capacities with a greedy check, see minimax_cells), so no shard is larger
    than it must be; within it the smallest shard is made as large as can be.  A group larger than an even share sets the
    capacity and stays whole.

    Cases: null ids are kept and ordered first; repeated rows are rows of their own, of equal rows any may
    come first; texts of any length count whole; of several cuts as even as each other the one nearest to
    even shares is taken; an empty table gives an empty result; other columns are ignored, whatever their
    names.  Returns id, size, text_crc32,
    group_key, shard, slot (0.. without gaps in each shard).
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + overhead).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1).alias("h"),
    )
    slim = numbered_rows(slim, "shard-slim", keep=True)
    cells, capacity = minimax_cells(slim.select("h", "size"), shards)
    cuts = even_cuts(cells, capacity, shards) if len(cells.size) else [0] * (shards - 1)
    shard = F.size(F.filter(F.array(*[F.lit(key).cast("long") for key in cuts]), lambda c: c <= F.col("h"))) if cuts else F.lit(0)
    placed = slim.withColumn("shard", shard)
    rows = {r.shard: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return gapless(placed, "shard", ["doc_id", "h"], rows, "slot").withColumnRenamed("h", "group_key")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")
