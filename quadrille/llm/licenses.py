"""Licence scan with a positional index of rare words (operator 6)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bound_batches, small_batches, text_of
from .decontaminate import lcs, masks
from .license_texts import TEMPLATES, Template

#: Base phrases and their labels; every place counts.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words: runs of digits, lower-case letters and non-ASCII bytes, after A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ANCHORS = 12  # rarest words of a template that are indexed
AGREE = 2  # of them, so many different ones must name one start
DRIFT = 4  # words that may be lost or added between two that agree


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w.decode() for t in [*base, *(x.text for x in templates)] for w in words_of(t)})


def document_frequencies(docs: DataFrame, vocab: list[str]) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, over all documents; as many rows as the fixed vocabulary has words."""
    known = {w.encode() for w in vocab}

    def count(batches):
        for b in small_batches(batches, 0):
            raw, off = arrow_bytes(b.column(0))
            folded, off = raw.tobytes().translate(FOLD), off.tolist()
            seen: Counter = Counter()
            for i in range(len(off) - 1):
                seen.update(known.intersection(folded[off[i] : off[i + 1]].split()))
            seen[b""] += len(off) - 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    rows = docs.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.w): r["n"] for r in rows}
    return df, df.pop(b"", 0)


class LicenseIndex:
    """Postings (template, position) of the rarest words of base phrases and templates, and what a match must show."""

    def __init__(self, df: dict[bytes, int], n_docs: int, base=BASE, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS):
        idf = lambda w: math.log((n_docs + 1) / (df.get(w, 0) + 1))
        rarest = lambda words: sorted(set(words), key=lambda w: (-idf(w), w))
        self.base = [(words_of(p), label) for p, label in base.items()]
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.masks = [masks(w) for w in self.words]
        self.must = [[words_of(p) for p in t.must] for t in templates]
        self.never = [[words_of(p) for p in t.never] for t in templates]
        self.agree: list[int] = []
        self.phrases: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (words, _) in enumerate(self.base):
            w = rarest(words)[0]
            self.phrases[w] += [(k, i) for i, x in enumerate(words) if x == w]
        for t, words in enumerate(self.words):
            rare = rarest(words)[:anchors]
            self.agree.append(min(AGREE, len(rare)))
            for i, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, i))
        self.rare = frozenset(self.phrases) | frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places (first word, label) of base phrases, and the best score of each label.

        Each occurrence of an indexed word names a start (its place less its position in the template) for
        every posting.  Postings are intersected: a start counts only where AGREE different rare words of
        the template name it, give or take DRIFT words.  There the template's mandatory phrases must stand
        word by word, forbidden ones must not, and the score is the share of the template's words that the
        text has in the template's order (longest common subsequence).
        """
        places, starts = [], defaultdict(list)
        for i, w in enumerate(words):
            if w in self.rare:
                for k, p in self.phrases.get(w, ()):
                    phrase, label = self.base[k]
                    if i >= p and words[i - p : i - p + len(phrase)] == phrase:
                        places.append((i - p, label))
                for t, p in self.postings.get(w, ()):
                    starts[t].append((i - p, w))
        scores = {label: 1.0 for _, label in places}
        for t, named in starts.items():
            template = self.templates[t]
            for s in agreed(sorted(named), self.agree[t]):
                n = len(self.words[t])
                region = words[max(0, s - DRIFT) : s + n + n // 8 + 2 * DRIFT]
                if not all(self.holds(region, k) for k in self.must[t]) or any(self.holds(region, k) for k in self.never[t]):
                    continue
                score = lcs(self.masks[t], n, region) / n
                if score >= template.least:
                    scores[template.label] = max(scores.get(template.label, 0.0), score)
        return sorted(places), scores

    @staticmethod
    def holds(window: list[bytes], phrase: list[bytes]) -> bool:
        n = len(phrase)
        return any(window[i] == phrase[0] and window[i : i + n] == phrase for i in range(len(window) - n + 1))


def agreed(named: list[tuple[int, bytes]], least: int) -> list[int]:
    """Starts, more than DRIFT apart, that `least` different words name within DRIFT of each other; named is sorted."""
    out: list[int] = []
    inside: Counter = Counter()
    first = 0
    for s, w in named:
        inside[w] += 1
        while named[first][0] < s - DRIFT:
            v = named[first][1]
            inside[v] -= 1
            if not inside[v]:
                del inside[v]
            first += 1
        if len(inside) >= least and (not out or named[first][0] > out[-1] + DRIFT):
            out.append(named[first][0])
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (array of word, label: the base phrases), licenses (array of label, score).

    Two passes and no shuffle of rows: one counts in how many documents each licence word occurs (a fixed
    vocabulary), which picks each template's rarest words; one scans whole texts through the index.

    Cases: a null text has no words and no licence; null ids and repeated rows are kept; texts of any
    length are scanned whole, in linear time; of words equally rare the first in order is indexed; every
    label whose template fits is reported, and a label's best score counts; an empty table gives no rows;
    other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    df, n_docs = document_frequencies(slim.select("text"), vocabulary(templates, base))
    index = docs.sparkSession.sparkContext.broadcast(LicenseIndex(df, n_docs, base, templates))
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    def run(batches):
        ix = index.value
        for b in small_batches(batches, 1):
            raw, off = arrow_bytes(b.column(1))
            folded = np.frombuffer(raw.tobytes().translate(FOLD), np.uint8)
            inside = folded != 32
            begins = inside.copy()
            if len(folded):
                begins[1:] &= ~inside[:-1]
                at = off[:-1][off[:-1] < len(folded)]
                begins[at] = inside[at]
            total = np.concatenate([[0], np.cumsum(begins)])
            n_words = total[off[1:]] - total[off[:-1]]
            text, ends = folded.tobytes(), off.tolist()
            places, licenses = [], []
            for i in range(len(ends) - 1):
                own = text[ends[i] : ends[i + 1]]
                words = own.split()
                p, s = ([], {}) if ix.rare.isdisjoint(words) else ix.scan(words)
                places.append([{"word": w, "label": lab} for w, lab in p])
                licenses.append([{"label": k, "score": s[k]} for k in sorted(s)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(places, place), pa.array(licenses, found)], ["doc_id", "n_words", "places", "licenses"])

    return slim.mapInArrow(run, "doc_id long, n_words long, places array<struct<word:long,label:string>>, licenses array<struct<label:string,score:double>>")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.col("licenses.label")).alias("labels"), F.coalesce(F.array_max("licenses.score"), F.lit(0.0)).alias("score"),
    )
