import zlib

import pytest

from quadrille.llm.sharding import Cells, minimax_cells, shard_documents

ROWS = [(i, t, "x") for i, t in enumerate(["a" * (37 * i % 211) + str(i % 23) for i in range(150)] + ["hot " * 50] * 60 + [None, "", "é", "z" * 5000])]


def brute(sizes, k):
    """Minimax contiguous partition by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [min([best[i], *(max(best[j], sum(sizes[j:i])) for j in range(i))]) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("k", [1, 3, 7])
def test_capacity_is_the_optimum(spark, k):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, h string")
    out = shard_documents(d, k).collect()
    groups = {}
    for r in out:
        groups[r.group_key] = groups.get(r.group_key, 0) + r.size
    sizes = [v for _, v in sorted(groups.items())]
    g = spark.createDataFrame([(r.group_key, r.size) for r in out], "h long, size long")
    for budget in (1 << 4, 1 << 12):
        assert minimax_cells(g, k, budget)[1] == brute(sizes, k)
    loads = {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) <= brute(sizes, k)


def test_rows_slots_and_groups(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, h string")
    out = shard_documents(d, 5).collect()
    texts = dict((i, t or "") for i, t, _ in ROWS)
    assert sorted(r.doc_id for r in out) == sorted(texts)
    shard_of, slots = {}, {}
    for r in out:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
        assert shard_of.setdefault(b, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert shard_documents(spark.createDataFrame([], schema)).count() == 0
    out = shard_documents(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], schema), 2).collect()
    assert len(out) == 3 and len({(r.shard, r.slot) for r in out}) == 3
