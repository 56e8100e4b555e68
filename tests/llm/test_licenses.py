import random
import re
import time

from quadrille.llm.license_texts import TEMPLATES, TEXTS
from quadrille.llm.licenses import BASE, LicenseIndex, agreed, op6_licenses, scan_licenses, words_of

TEXT = {t.label: t.text for t in TEXTS}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, lab) for p, lab in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({lab for _, lab in places}))


CASES = [None, "", "Under the MIT license under the mit License.", "x cc-by-nc cc by cc by nc", "APACHE LICENSE, Version 2.0", "under\nthe   mit; license é", "underthe mit license", TEXT["bsd-3"].upper(), "all rights\nreserved", "word " * 100000 + "cc by nc"]


def test_base_places(spark):
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(CASES)], "doc_id long, text string, places string")
    got = {r.doc_id: r for r in scan_licenses(d).collect()}
    for i, t in enumerate(CASES):
        n, k, first, last, labels = brute(t)
        w = [p.word for p in got[i].places]
        assert (got[i].n_words, len(w), min(w, default=None), max(w, default=None)) == (n, k, first, last), t
        assert ",".join(sorted({p.label for p in got[i].places})) == labels
    assert [x.label for x in got[7].licenses] == ["bsd-3"] and got[7].licenses[0].score == 1.0
    assert not got[8].licenses


def labels_of(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{x.label: x.score for x in r.licenses} for r in sorted(scan_licenses(d).collect())]


def test_every_template_finds_itself_alone(spark):
    texts = [f"some words before. {t.text}. and after" for t in TEMPLATES]
    for t, got in zip(TEMPLATES, labels_of(spark, texts)):
        assert set(got) == {t.label} and got[t.label] == 1.0, t.label


def test_edited_copies_are_found(spark):
    rng = random.Random(1)
    texts = []
    for t in TEXTS:
        words = t.text.split()
        must = {w.lower().strip('".,;()') for p in t.must for w in p.split()}
        edited = [w for w in words if w.lower().strip('".,;()') in must or rng.random() > 0.08]
        texts.append("# " + "\n# ".join(" ".join(edited[i : i + 9]) for i in range(0, len(edited), 9)))
    for t, got in zip(TEXTS, labels_of(spark, texts)):
        assert t.label in got and 0.8 <= got[t.label], t.label


def test_no_false_labels(spark):
    rng = random.Random(2)
    scrambled = []
    for t in TEXTS:
        words = t.text.split()
        rng.shuffle(words)
        scrambled.append(" ".join(words))
    near = [
        "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
        "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        TEXT["lgpl-3"],
        "the license of this software and the source of all public work",
        "permission granted",
        "All rights reserved.",
        "I read the MIT license and the Mozilla Public License yesterday",
    ]
    got = labels_of(spark, near + scrambled)
    assert [set(g) for g in got] == [{"cc-by-nc"}, {"cc-by-sa"}, {"lgpl-3"}] + [set()] * (len(near) - 3 + len(scrambled))


def test_postings_must_agree_on_the_start():
    assert agreed([(10, b"a"), (10, b"a"), (12, b"b"), (40, b"c")], 2) == [10]
    assert agreed([(10, b"a"), (16, b"b")], 2) == [] and agreed([(10, b"a")], 1) == [10]
    ix = LicenseIndex({}, 10)
    text = TEXT["mit"].lower().split()
    assert ix.scan(words_of(" ".join(text)))[1] == {"mit": 1.0}
    t = time.process_time()
    assert ix.scan(words_of("software license " * 200_000)) == ([], {})
    assert time.process_time() - t < 20


def test_query_and_empty(spark, sf001):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = op6_licenses(spark, sf001).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == {i: brute(t) for i, t in texts.items()}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert scan_licenses(spark.createDataFrame([(None, "cc by nc"), (None, "cc by nc")], "doc_id long, text string")).count() == 2
