import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadrille.llm.packing import binary_pieces, pack, pieces

TEXTS = ["", None, "a", "Hello world, it's <|endoftext|> here", "日本語 テキスト", "word " * 3000, "été être\n\n  x", "a b c " * 11, "a b c " * 11]


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_pieces_cover_once(n):
    p = binary_pieces(n, 1024)
    assert [s for s, _ in p] == [sum(k for _, k in p[:i]) for i in range(len(p))] and sum(k for _, k in p) == n
    assert all(k & (k - 1) == 0 and k <= 1024 for _, k in p)


def test_ids_and_sequences(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = pack(d, 1024).collect()
    for i, x in enumerate(TEXTS):
        want = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == want.tobytes()
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)


def test_fast_encoder_gives_the_reference_ids(spark, sf001):
    d = spark.read.parquet(f"{sf001}/documents.parquet")
    a = {(r.doc_id, r.start): bytes(r.ids) for r in pieces(d).collect()}
    b = {(r.doc_id, r.start): bytes(r.ids) for r in pieces(d, ranks=None).collect()}
    assert a == b


def test_empty_table_and_repeated_rows(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_equal_rows_are_numbered_in_many_buckets(spark):
    """A third of all rows equal in everything: the numbering deals them by row, not by what they hold."""
    from pyspark.sql import functions as F

    from quadrille.llm.common import gapless, numbered_rows

    d = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(0).alias("start"), (F.col("id") % 2).cast("int").alias("length"))
    out = gapless(numbered_rows(d, "rows"), "length", ["doc_id", "start"], {0: 15_000, 1: 15_000}, "slot", 1_000)
    got = out.groupBy("length").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n")).collect()
    assert sorted((r.length, r.a, r.b, r.n) for r in got) == [(0, 0, 14_999, 15_000), (1, 0, 14_999, 15_000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(length" in plan and "_nb" in plan
