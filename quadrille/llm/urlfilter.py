"""URL filter: rules first, then host word segmentation and naive Bayes (operator 10)."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, temporary

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LABEL, NAME = 63, 253  # letters that a label of a host name, and characters that the name, can have
UNKNOWN = 13_000_000  # cost of a letter that no word covers; costs and log odds are whole millionths, so that sums have no order
FOLDS = 5
SHARE, SPACE = 0.1, 1 << 16  # smoothing: so much of each class is spread evenly over so many tokens
PRECISION = 0.9
FAR = 40_000_000  # beyond this score no threshold is looked for
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """host and path of each url: the host after the first :// and lower-cased in A-Z, the path up to ? or #."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_of(rules=RULES):
    """(rule text, verdict) columns: of the rules that fit host and path, the one with the longest text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def viterbi(length: int, words: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run of letters whose costs have the least sum; words are (start, letters, cost), other letters stand alone."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, n, c in words:
        ends.setdefault(i + n, []).append((i, c))
    best, back = [0], [0]
    for j in range(1, length + 1):
        cost, at = min([(best[j - 1] + UNKNOWN, j - 1), *((best[i] + c, i) for i, c in ends.get(j, ()))])
        best.append(cost)
        back.append(at)
    out, j = [], length
    while j:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


def micro(x):
    return F.round(x * 1_000_000).cast("long")


def unigrams(pages: DataFrame, title_col: str) -> DataFrame:
    """word, cost: every word of two letters or more of all titles and url paths, and minus the log of its share."""
    title = F.regexp_extract(F.coalesce(F.col(title_col), F.lit("")), r"(?is)<title>([^<]*)</title>", 1)
    words = pages.select(F.explode(F.split(F.lower(F.concat_ws(" ", title, "path")), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, LABEL))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("word", micro(F.log(F.lit(float(total)) / F.col("n"))).alias("cost"))


def segment_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, words: each run of letters of a host name, its top-level domain left out, split by unigram Viterbi.

    Only distinct runs are split.  Their substrings meet the words in an equi-join, so the vocabulary is
    never cut or broadcast.  What is longer than a host name can be stays unsplit.
    """
    name = F.regexp_replace("host", r"\.[^.]*$", "")
    runs = hosts.select("host", F.regexp_extract_all(name, F.lit(r"(\p{L}+)"), 1).alias("runs"))
    each = materialize(runs.where(F.length("host") <= NAME).select(F.explode("runs").alias("run")).distinct(), "url-runs")
    parts = each.select("run", F.explode(F.expr("sequence(1, length(run))")).alias("i")).select("run", "i", F.explode(F.expr(f"sequence(1, least({LABEL}, length(run) - i + 1))")).alias("n")).where("n > 1")
    met = parts.withColumn("word", F.expr("substring(run, i, n)")).join(words, "word").groupBy("run").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "n", "cost")).alias("met"))

    def split(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            out = [[r[i:j] for i, j in viterbi(len(r), [(w["i"], w["n"], w["cost"]) for w in m or ()])] for r, m in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    table = materialize(each.join(met, "run", "left").select("run", "met").mapInArrow(split, "run string, words array<string>"), "url-split")
    at = runs.select("host", F.posexplode("runs").alias("k", "run")).join(table, "run", "left").select("host", "k", F.coalesce("words", F.array("run")).alias("words"))
    joined = at.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda x: x.words)).alias("words"))
    return hosts.join(joined, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def fit(tokens: DataFrame, decided: DataFrame) -> tuple[DataFrame, list[int]]:
    """token, odds: log odds of block against allow under the model of all decided pages (last) and under each that leaves a fold of hosts out; and their priors.

    A token counts once per page; one that a single host has says nothing of others and is left out.
    Smoothing is a share of each class, so a table several times over gives the same model.
    """
    by_host = tokens.where("y is not null").groupBy("token", "host", "fold").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    cell = [F.sum(F.when(F.col("fold") == f, F.col(f"n{y}")).otherwise(0)).alias(f"c{y}{f}") for y in (0, 1) for f in range(FOLDS)]
    counts = materialize(by_host.groupBy("token").agg(*cell, F.count(F.lit(1)).alias("hosts")).where("hosts > 1"), "url-counts")
    total = counts.agg(*[F.sum(f"c{y}{f}") for y in (0, 1) for f in range(FOLDS)]).first()
    total = np.array([float(x or 0) for x in total]).reshape(2, FOLDS)
    docs = np.zeros((2, FOLDS))
    for r in decided.groupBy("y", "fold").agg(F.sum("n").alias("n")).collect():
        docs[r.y, r.fold] = r["n"]

    def less(x: np.ndarray, f: int) -> np.ndarray:
        return x.sum(1) - (x[:, f] if f < FOLDS else 0)

    odds, priors = [], []
    for f in range(FOLDS + 1):
        of = [sum((F.col(f"c{y}{g}") for g in range(FOLDS) if g != f), F.lit(0)) for y in (0, 1)]
        share = [F.lit((1 - SHARE) / n) * c + F.lit(SHARE / SPACE) if n else F.lit(1 / SPACE) for c, n in zip(of, less(total, f))]
        odds.append(micro(F.log(share[1] / share[0])))
        d = less(docs, f)
        priors.append(round(1_000_000 * math.log(d[1] / d[0])) if d.all() else 0)
    return counts.select("token", F.array(*odds).alias("odds")), priors


def threshold(curve: list[tuple[int, int, int]], precision: float = PRECISION) -> tuple[int | None, float, float]:
    """The lowest score from which held-out precision is at least `precision` (None where no score has that), with precision and recall there.

    curve: (score, allowed pages, blocked pages) by held-out score.
    """
    total = sum(b for _, _, b in curve)
    best, wrong, right = (None, 1.0, 0.0), 0, 0
    for s, a, b in sorted(curve, reverse=True):
        wrong, right = wrong + a, right + b
        if right and right / (right + wrong) >= precision:
            best = (s, right / (right + wrong), right / total)
    return best


def named_tokens(rules) -> list[str]:
    """Labels and path words that the rules name: they say which rule fits and nothing of what a page is, so they are no features."""
    hosts = {"h:" + label for _, host, _ in rules for label in host.lower().split(".")}
    return sorted(hosts | {"p:" + w for _, _, path in rules for w in re.findall(r"[^\W\d_]+", path.lower())})


def url_model(parts: DataFrame, title_col: str, precision: float, rules) -> tuple[DataFrame, tuple[int | None, float, float]]:
    """host, path, score, words of every distinct host and path; and the threshold with its held-out precision and recall.

    parts: host, path, ruled and the page's html, one row a page.
    """
    pairs = parts.groupBy("host", "path").agg(F.first("ruled").alias("ruled"), F.count(F.lit(1)).alias("n"))
    y = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    pairs = materialize(pairs.select("host", "path", y.cast("int").alias("y"), "n", F.pmod(F.xxhash64("host", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")), "url-pairs")
    hosts = materialize(segment_hosts(pairs.select("host").distinct(), unigrams(parts, title_col)), "url-hosts", keep=True)
    tag = lambda c, t: F.transform(c, lambda w: F.concat(F.lit(t), w))
    path_words = F.regexp_extract_all(F.lower("path"), F.lit(r"(\p{L}+)"), 1)
    tokens = pairs.join(hosts, "host").select("host", "path", "y", "n", "fold", F.explode(F.array_distinct(F.concat(tag(F.col("words"), "h:"), tag(path_words, "p:")))).alias("token")).where(~F.col("token").isin(named_tokens(rules)))
    tokens = materialize(tokens, "url-tokens")
    decided = pairs.where("y is not null")
    odds, priors = fit(tokens, decided)
    sums = tokens.join(odds, "token").groupBy("host", "path").agg(F.sum(F.element_at("odds", -1)).alias("own"), F.sum(F.expr("odds[fold]")).alias("held"))
    own = F.coalesce("own", F.lit(0)) + priors[-1]
    held = F.coalesce("held", F.lit(0)) + F.element_at(F.array(*map(F.lit, priors)), F.col("fold") + 1)
    scored = materialize(pairs.join(sums, ["host", "path"], "left").select("host", "path", "y", "n", own.alias("score"), held.alias("held")), "url-scores", keep=True)
    bin_ = F.least(F.greatest(F.floor(F.col("held") / 10_000), F.lit(-FAR // 10_000)), F.lit(FAR // 10_000))
    curve = scored.where("y is not null").groupBy(bin_.alias("s")).agg(F.sum((1 - F.col("y")) * F.col("n")).alias("a"), F.sum(F.col("y") * F.col("n")).alias("b")).collect()
    cut = threshold([(r.s * 10_000, r.a, r.b) for r in curve], precision)
    return scored.join(hosts, "host").select("host", "path", "score", F.array_join("words", " ").alias("words")), cut


def filter_urls(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", title_col: str = "html", precision: float = PRECISION) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by the model), words (the host, segmented).

    A rule that fits decides; the longest wins.  Other urls get the model's verdict.  The model learns
    from the pages that rules decide, from the words of host and path only: top-level domains, and words
    that a rule names, are no features.  It blocks from the score at which, on hosts it has not seen (cross-validation over folds of
    hosts), at least `precision` of what it blocks is blocked by a rule too; if no score has that, it
    allows.  Everything the driver holds is of fixed size: priors, sums and a curve of 8,001 scores.

    Cases: a null url, or one without ://, has an empty host and path, fits no rule and scores the prior;
    of rules of one length that both fit, the later in order of verdict, host and path wins; urls of any
    length are judged whole, but a host longer than 253 characters is not split into words; null ids and
    repeated rows are kept; an empty table gives no rows; other columns are ignored, even if called host,
    path, rule or verdict.
    """
    urls, parts = decided_urls(pages, rules, id_col, url_col, title_col)
    with temporary(pages.sparkSession):
        scored, (cut, _, _) = url_model(parts, "_title", precision, rules)
    method = F.when(F.col("score") >= cut, "block").otherwise("allow") if cut is not None else F.lit("allow")
    out = urls.join(scored, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), (F.col("score") / 1_000_000).alias("score"), "words")


def decided_urls(pages: DataFrame, rules, id_col: str, url_col: str, title_col: str) -> tuple[DataFrame, DataFrame]:
    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url"), F.col(title_col).alias("_title"))
    name, verdict = rule_of(rules)
    urls = split_url(slim, "_url").withColumn("rule", name).withColumn("ruled", verdict)
    return urls.select("page_id", "host", "path", "rule", "ruled"), urls.select("host", "path", "ruled", "_title")


def held_out(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", title_col: str = "html", precision: float = PRECISION) -> tuple[float, float, float]:
    """Threshold (infinite where nothing is blocked), precision and recall of the model on hosts it has not seen."""
    cut, p, r = url_model(decided_urls(pages, rules, id_col, url_col, title_col)[1], "_title", precision, rules)[1]
    return (math.inf if cut is None else cut / 1_000_000), p, r


def op10_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
