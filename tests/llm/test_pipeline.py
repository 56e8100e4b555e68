import re
import zlib

import corpus_pipeline as cp
from quadrille.llm import decontaminate
from quadrille.llm.decontaminate import words_of
from quadrille.llm.secrets import find_secrets
from quadrille.llm.packing import binary_pieces
from test_neardup import brute as near_brute
from test_quality import brute as quality_brute
import numpy as np


def test_stages_against_brute_force(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    state = docs
    got = {}
    for name, f in cp.STAGES:
        state = f(spark, state, sf001)
        state.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        got[name] = state
        if f is not cp.packing:
            assert state.columns == list(cp.COLUMNS)
    first = {r.doc_id for r in got["quality rules"].collect()}
    base_ok = {i for i, r in rows.items() if (q := quality_brute(r.text))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert first <= base_ok
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    assert sum(labels[i] == 1 and i not in first for i in base_ok & set(labels)) <= 1

    second = {r.doc_id for r in got["near-dedup"].collect()}
    near = near_brute({i: rows[i].text for i in first}, 5, 80)
    assert second == {i for i in first if near[i][1] == i}

    third = {r.doc_id for r in got["decontamination"].collect()}
    flat = lambda t: b" " + b" ".join(words_of(t)) + b" "
    items = [flat(r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    exact = {i for i in second if any(x in flat(rows[i].text) for x in items)}
    assert third <= second - exact and len(second - exact - third) <= 1

    fourth = {r.doc_id: r for r in got["secret scan"].collect()}
    assert set(fourth) == third
    for i, r in fourth.items():
        if find_secrets(rows[i].text):
            assert not find_secrets(r.text) and r.n_chars == len(r.text)
        else:
            assert tuple(r) == tuple(rows[i])

    packed = got["packing"].collect()
    for i, r in fourth.items():
        own = sorted((p for p in packed if p.doc_id == i), key=lambda p: p.start)
        assert [(p.start, p.length) for p in own] == binary_pieces(own[0].doc_tokens, 1024)
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length for p in own)
    assert {p.doc_id for p in packed} == third
    assert cp.run(spark, sf001).count() == len(packed)


def test_cases(spark, sf001):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for _, f in cp.STAGES:
        assert f(spark, empty, sf001).count() == 0
    t = " ".join(f"word{i}" for i in range(80))
    d = spark.createDataFrame([(1, t, "en", "s", 9), (1, t, "en", "s", 9), (2, t.upper(), None, None, None), (None, None, None, None, None), (None, t, "x", "y", None)], schema)
    assert sorted((r.doc_id or -1) for r in cp.near_dedup(spark, d, sf001).collect()) == [-1, -1, 1]
    kept = cp.secrets(spark, d, sf001).collect()
    assert sorted(map(str, kept)) == sorted(map(str, d.collect()))
    assert cp.decontaminate(spark, d, sf001).count() == 5


def test_every_stage_takes_odd_rows(spark, sf001):
    """A null id, repeated rows, a very long text, columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _c0 string, part int, redacted string, _text_hash long"
    extra = ("k", "c", 1, "r", 2)
    t = " ".join(f"word{i}" for i in range(80))
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(150_000))
    rows = [(1, t), (1, t), (None, t), (None, None), (3, ""), (4, long), (None, long)]
    d = spark.createDataFrame([(i, x, "en", "s", len(x or ""), *extra) for i, x in rows], schema)
    want = {"near-dedup": 6, "decontamination": 7, "secret scan": 7}
    for name, f in cp.STAGES:
        out = f(spark, d, sf001)
        got = out.collect()
        if name == "packing":
            assert sum(p.start == 0 for p in got) == 7 and {p.sequence_id for p in got} == set(range(len(got)))
            continue
        assert out.columns == list(cp.COLUMNS)
        assert len(got) == want.get(name, len(got)) and all(r.text for r in got) == (name == "quality rules")


def test_leaks_go_by_row_and_not_by_id_alone(spark, sf001):
    item = spark.read.parquet(f"{sf001}/benchmark.parquet").orderBy("item_id").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    other = " ".join(f"word{i}" for i in range(80))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((None, item), (1, item), (1, other), (None, other), (2, other + " " + item))], schema)
    assert sorted((r.doc_id or -1, r.text) for r in cp.decontaminate(spark, d, sf001).collect()) == [(-1, other), (1, other)]


def test_decontamination_fits_on_every_document(spark, sf001, monkeypatch):
    """More documents than weigh singly in the fit: the model is the same whatever their ids, so none is left out by its id."""
    items = [r.text for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    words = [w for t in items for w in t.split()]
    texts = [" ".join(words[(7 * i + 13 * j) % len(words)] for j in range(6)) for i in range(4_000)]
    spaces = []
    fit = decontaminate.latent_space

    def seen(*given, **named):
        spaces.append(fit(*given, **named))
        return spaces[-1]

    monkeypatch.setattr(decontaminate, "latent_space", seen)
    for shift in (0, 10_000):
        d = spark.createDataFrame([(i + shift, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        cp.decontaminate(spark, d, sf001)
    assert len(spaces) == 2 and np.array_equal(*spaces)
