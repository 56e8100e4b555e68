import hashlib
import os
import random

import numpy as np
import pytest

from quadrille.llm.suffixdedup import op2_suffix_dedup, remove_repeats, suffix_array


def brute(texts, width=50):
    data = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - width + 1):
            first.setdefault(data[i][p : p + width], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans, kept = [], bytes(c for c, g in zip(b, gone) if not g)
        for p in range(len(b)):
            if gone[p] and not (p and gone[p - 1]):
                spans.append(p)
        out[i] = (len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 8)))
    texts, shared = [], [" ".join(word() for _ in range(r.choice([8, 10, 12, 60, 400]))) for _ in range(12)]
    for _ in range(90):
        texts.append(" ".join(r.choice(shared) if r.random() < 0.3 else word() for _ in range(r.randint(0, 40))))
    return [*texts, *texts[:20], "x" * 200, "x" * 49, "x" * 50, "x" * 5000, "ab" * 300, "ab" * 25, None, "", "short"]


@pytest.mark.parametrize("options", [{}, {"modulus": 16, "part_bytes": 2000, "bucket_bytes": 500}, {"modulus": 1 << 40, "part_bytes": 3000}, {"part_bytes": 2000, "common": 2}])
def test_equals_brute_force(spark, options):
    texts = dict(enumerate(corpus()))
    order = list(texts.items())
    random.Random(1).shuffle(order)
    d = spark.createDataFrame([(i, t, "c") for i, t in order], "doc_id long, text string, part string")
    assert result(remove_repeats(d, **options)) == brute(texts)


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 50])
def test_suffix_array_and_common_prefixes(depth):
    data = np.frombuffer(bytes(random.Random(depth).choices(b"ab\x00\xff", k=400)) + b"ab" * 120, np.uint8)
    starts = np.random.default_rng(1).permutation(len(data) - depth + 1)[:300]
    order, lcp = suffix_array(data, starts, depth)
    suffix = [data[i : i + depth].tobytes() for i in starts[order]]
    assert suffix == sorted(suffix) and sorted(order) == list(range(300))
    assert list(lcp[1:]) == [len(os.path.commonprefix([a, b])) for a, b in zip(suffix, suffix[1:])]


def test_other_widths(spark):
    texts = dict(enumerate(corpus()[:40]))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(remove_repeats(d, 33, gram=9)) == brute(texts, 33)


def test_query_equals_brute_force(spark, sf001):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in op2_suffix_dedup(spark, sf001).collect()} == brute(texts)


def test_cases(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    t = "the same text in every row, which is longer than fifty bytes"
    rows = remove_repeats(spark.createDataFrame([(None, t), (2, t), (2, t), (3, t), (3, t)], schema)).collect()
    assert sorted((r.doc_id or -1, len(r.kept)) for r in rows) == [(-1, len(t)), (2, len(t)), (2, len(t)), (3, 0), (3, 0)]
