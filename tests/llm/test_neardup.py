import random
import re

import pytest

from quadrille.llm.components import connected_components
from quadrille.llm.neardup import near_duplicates, op7_neardup


def brute(texts, k=3, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(texts) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= percent * large and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def family(seed, n=60):
    """Near copies of a hub, some of them at the threshold, and chains of small edits."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    base = [word() for _ in range(80)]
    out = []
    for _ in range(n):
        w = list(r.choice([base, out[-1].split() if out else base]))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_links_equal_brute_force(spark, block):
    texts = dict(enumerate([t for s in range(4) for t in family(s)] + ["A b", "a B", "a", "", None, " \n", "x y z", "X Y  Z", "w " * 50000]))
    d = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(d, block=block).collect()}
    assert got == brute(texts)


def test_query_equals_brute_force(spark, sf001):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = op7_neardup(spark, sf001).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts) and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_five_words_at_080(spark):
    texts = dict(enumerate(family(9, 120)))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(d, k=5, percent=80).collect()} == brute(texts, 5, 80)


def test_cases(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (5, "A B C")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, None, True), (2, 2, True), (2, 2, True), (5, 2, False)]


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1100)}
