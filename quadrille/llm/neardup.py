"""Near-duplicate documents by min-max hashing, banding and exact confirmation (operator 7)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bound_batches, materialize, small_batches, temporary, text_of
from .components import connected_components

U = np.uint64
ROWS = 5  # signature values a band
MISS = 1e-8  # chance that no band has a pair just at the threshold
BLOCK = 128


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of concatenated texts, and the n+1 word offsets of the texts."""
    if not len(raw):
        return np.empty(0, U), np.zeros(len(off), np.int64)
    word = ~IS_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = off[:-1][off[:-1] < len(raw)]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = word[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros(len(s), U)
    bytes_ = BYTE[FOLD[raw]]
    step = 1 << 16  # powers of the base start again for each stretch, which keeps them in cache
    power, inverse = _powers(BASE, step * 2), None
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + step, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        if hi - lo > len(power):
            power = _powers(BASE, hi - lo)
            inverse = None
        if inverse is None:
            inverse = _powers(INVERSE, len(power))
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(bytes_[lo:hi] * power[: hi - lo], out=total[1:])
        out[i:j] = (total[e[i:j] - lo] - total[s[i:j] - lo]) * inverse[s[i:j] - lo]
        i = j
    return mix(out ^ (e - s).astype(U)), np.searchsorted(s, off)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words, where there are fewer than k."""
    n = len(words)
    if not n:
        return np.empty(0, U)
    k = min(k, n) if n < k else k
    h = words[: n - k + 1] * STEP[0]
    for i in range(1, k):
        h = h + words[i : n - k + 1 + i] * STEP[i]
    return np.unique(mix(h + U(k)))


def sets_of(col, k: int):
    raw, off = arrow_bytes(col)
    hashes, at = word_hashes(raw, off)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield shingle_set(hashes[a:b], k)


def plan_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_hash, low (a byte of each signature value), bands.

    Each multiplier gives two values, the least and the greatest product over the set, so half as many
    hash evaluations are made as the signature has values.
    """
    bands = plan_bands(threshold)
    half = -(-bands * ROWS // 2)
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, half, dtype=np.uint64) * U(2) + U(1)
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))

    def run(batches):
        for b in small_batches(batches, 1):
            size, digest, low, keys = [], [], [], []
            for s in sets_of(b.column(1), k):
                size.append(len(s))
                if not len(s):
                    digest.append(None), low.append(None), keys.append([])
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least, most = np.full(half, 2**64 - 1, U), np.zeros(half, U)
                for i in range(0, len(s), 512):
                    h = s[i : i + 512, None] * factors
                    np.minimum(least, h.min(0), out=least)
                    np.maximum(most, h.max(0), out=most)
                v = mix(np.concatenate([least, most]))
                low.append((v & U(255)).astype(np.uint8).tobytes())
                grid = v[np.argsort(ORDER[: len(v)], kind="stable")][: bands * ROWS].reshape(bands, ROWS)
                key = salts.copy()
                for r in range(ROWS):
                    key = mix(key * STEP[r] + grid[:, r])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "low", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, low binary, bands array<long>")


#: A fixed shuffle of signature positions, so that a band has values of both kinds.
ORDER = np.random.default_rng(11).permutation(1 << 12)


def linked(size_a, size_b, both, percent: int):
    return 100 * both >= percent * (size_a + size_b - both)


def confirm_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The pairs of an a are dealt to shares of about `block`, and shares to groups of about four blocks of pairs; a's text goes to a
    group once a share and b's text to the groups of its pairs, so a hub with a third of all rows is in as many groups
    as any others, and its text travels once for every `block` members.
    """
    size = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "nd-size")
    total = size.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // (4 * block)))
    shares = F.ceil(F.col("n") / block)
    group = F.pmod(F.xxhash64("a", "share"), F.lit(groups)).cast("int").alias("group")
    dealt = pairs.join(size, "a").withColumn("share", F.pmod(F.xxhash64("b", F.lit(3)), shares))
    own = size.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    hubs = own.select(group, F.col("a").alias("id")).distinct().join(texts, "id").select("group", F.lit(None).cast("long").alias("a"), "id", "text")
    others = dealt.select(group, "a", F.col("b").alias("id")).join(texts, "id").select("group", "a", "id", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, sets = table.column("id").to_pylist(), list(sets_of(table.column("text"), k))
        hub = table.column("a").to_pylist()
        known = {i: s for i, s, h in zip(ids, sets, hub) if h is None}
        keep = [(h, i) for i, s, h in zip(ids, sets, hub) if h is not None and linked(len(known[h]), len(s), len(np.intersect1d(known[h], s, True)), percent)]
        return pa.table({"a": pa.array([h for h, _ in keep], pa.int64()), "b": pa.array([i for _, i in keep], pa.int64())})

    return hubs.union(others).groupBy("group").applyInArrow(run, "a long, b long")


def cut_blocks(d: DataFrame, key: list[str], size: DataFrame, block: int) -> DataFrame:
    """Deals the rows of each key to blocks of about `block` rows; adds blocks (their number) and block."""
    return d.join(size, key).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks").cast("long")).cast("int")).drop("n")


def bucket_candidates(members: DataFrame, values: int, threshold: float, block: int) -> DataFrame:
    """Pairs of members of a bucket, of different components and clusters, whose signatures may belong to linked sets.

    members: key, id, comp, hub, low.  Members outside a bucket's main component are loose; blocks of
    loose members meet blocks of all members in groups of their own, so no task holds more than two blocks
    however large the bucket, and a bucket that is nearly one component costs little.  A pair is dropped
    only if its signatures agree more than six standard errors below the threshold.
    """
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / values)
    least = math.floor(values * max(0.0, least))
    each = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    size = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", (-F.col("comp")).alias("neg"))).alias("top"))
    part = lambda rows, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(rows) / block))
    whole = lambda rows: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(rows) / block) - 1)
    size = materialize(size.select("key", "n", (F.col("n") - F.col("top.c")).alias("u"), (-F.col("top.neg")).alias("main")), "nd-size")
    dealt = materialize(members.join(size, "key"), "nd-dealt")
    columns = ["key", "i", "j", "loose", "id", "comp", "hub", "low"]
    loose = dealt.where("comp != main").withColumn("loose", F.lit(True)).withColumn("i", part("u", 5)).withColumn("j", F.explode(whole("n")))
    every = dealt.withColumn("loose", F.lit(False)).withColumn("j", part("n", 9)).withColumn("i", F.explode(whole("u")))
    grouped = loose.select(*columns).union(every.select(*columns))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, hub = (table.column(c).to_numpy() for c in ("id", "comp", "hub"))
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
        loose = table.column("loose").to_numpy(zero_copy_only=False).astype(bool)
        right = np.flatnonzero(~loose)
        a, b = [], []
        for x in np.flatnonzero(loose).tolist():
            y = right[(comp[right] != comp[x]) & (hub[right] != hub[x])]
            if len(y):
                y = y[(low[y] == low[x]).sum(1) >= least]
                a += [min(ids[x], q) for q in ids[y]]
                b += [max(ids[x], q) for q in ids[y]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return grouped.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def cluster_links(cluster: DataFrame, texts: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links inside clusters (hub, id, loose): of every loose member with every other, exactly, block by block."""
    size = cluster.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("loose").cast("long")).alias("u")).where("u > 0 and n > 2").drop("u")
    size = materialize(size, "nd-size")
    dealt = cut_blocks(cluster, ["hub"], size, block).join(texts, "id")
    dealt = materialize(dealt.withColumn("ublock", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks").cast("long")).cast("int")), "nd-cluster")
    loose = dealt.where("loose").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    present = dealt.where("loose").select("hub", "ublock").distinct()
    against = dealt.join(materialize(present.withColumnRenamed("ublock", "u"), "nd-present"), "hub").select("hub", "block", F.col("u").alias("ublock"), "id", F.lit(False).alias("loose"), "text")
    rows = loose.select("hub", "block", "ublock", "id", "loose", "text").union(against)

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, loose_ = table.column("id").to_numpy(), table.column("loose").to_numpy(zero_copy_only=False).astype(bool)
        sets = list(sets_of(table.column("text"), k))
        sizes = np.array([len(s) for s in sets])
        right = np.flatnonzero(~loose_)
        a, b = [], []
        if len(right):
            every = np.concatenate([sets[i] for i in right])
            owner = np.repeat(np.arange(len(right)), sizes[right])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for x in np.flatnonzero(loose_).tolist():
                lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(right))
                for y in right[linked(sizes[x], sizes[right], both, percent)].tolist():
                    if ids[y] != ids[x]:
                        a.append(ids[x])
                        b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("hub", "block", "ublock").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    1. One scan makes sets and signatures; documents with equal sets (128-bit digests) become one class,
       so copies cost nothing further, however many.
    2. Bands deal classes to buckets.  A bucket's hub is its class with the most copies; each class is
       confirmed against the hub it meets most often.  That links most groups in linear work.
    3. What stays loose in a hub's cluster is confirmed against the whole cluster, in blocks.
    4. Members of one bucket that are still in different components are compared by signature, in
       blocks, and confirmed on full sets.
    5. Components are found with large-star and small-star steps.
    Nothing is capped or sampled; a pair at the threshold is missed by all bands with a chance of 1e-8.

    Cases: null or blank texts have no set and are linked with nothing; a text of fewer than k words is one
    shingle; texts of any length are compared whole; of classes that tie for a bucket's hub the smallest id is taken; a null id is linked with nothing, has a null component and is kept; rows that repeat an id
    are kept or dropped alike (an id stands for one text: of several texts under one id, one is linked); an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    threshold = percent / 100
    values = 2 * -(-plan_bands(threshold) * ROWS // 2)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with temporary(docs.sparkSession):
        sig = materialize(signatures(slim, k, threshold), "nd-sig", keep=True)
        have = sig.where("n_shingles > 0 and doc_id is not null")
        classes = materialize(have.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "nd-classes")

        reps = materialize(have.join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "set_hash"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "copies", "low", "bands"), "nd-reps")
        rows = reps.select("id", "copies", F.explode("bands").alias("key"))
        hubs = rows.groupBy("key").agg(F.max(F.struct("copies", (-F.col("id")).alias("neg"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        hubs = materialize(hubs.select("key", (-F.col("top.neg")).alias("hub")), "nd-hubs")
        members = materialize(rows.select("key", "id").join(hubs, "key"), "nd-members")

        chosen = members.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times")).groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("neg"))).alias("top"))
        chosen = materialize(chosen.select("id", (-F.col("top.neg")).alias("hub")), "nd-chosen")
        texts = materialize(slim.join(chosen.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text"), "nd-texts")
        stars = chosen.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        first = materialize(confirm_pairs(stars, texts, k, percent, block), "nd-links")

        held = first.select(F.col("b").alias("id"), F.lit(True).alias("held"))
        cluster = chosen.where("id != hub").union(chosen.select(F.col("hub").alias("id"), "hub").distinct()).join(held, "id", "left").withColumn("loose", F.col("held").isNull() & (F.col("id") != F.col("hub"))).drop("held")
        second = materialize(cluster_links(cluster, texts, k, percent, block), "nd-links")
        links = first.union(second)

        comp = materialize(connected_components(links), "nd-comp")
        label = materialize(
            reps.select("id", "low").join(chosen, "id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "low", "hub", F.coalesce("component", "id").alias("comp")), "nd-label"
        )
        placed = members.select("key", "id").join(label, "id")
        open_ = materialize(placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key"), "nd-open")
        placed = materialize(placed.join(open_, "key"), "nd-placed")
        pairs = materialize(bucket_candidates(placed, values, threshold, block), "nd-pairs")
        third = materialize(confirm_pairs(pairs, texts, k, percent, block), "nd-links")
        if not third.isEmpty():
            comp = materialize(connected_components(links.union(third)), "nd-comp")

        named = classes.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
        named = materialize(named, "nd-named", keep=True)
    out = sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(named, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
