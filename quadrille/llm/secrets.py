"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, checksums (operator 9)."""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, text_of

#: Kinds in the order of reports, and the keywords that open a candidate of each kind.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "card")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
    "card": ("card", "visa", "amex", "credit", "payment"),
}
#: The patterns, each anchored at its keyword.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PREFIXED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----")
CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")
NEAR = 100  # characters after a card keyword in which a number may start
TOKEN = re.compile(r"[A-Za-z0-9_-]+")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def crc62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def jwt_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(head, dict) and "alg" in head


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points of all secrets of a text, ordered by start, then kind as listed.

    The automaton runs over the lower-cased bytes, one character each; a pattern is tried only where a
    keyword stands (card: within NEAR characters after one; hex, which the base asks for anywhere, has
    none).  A base kind's matches are leftmost and do not overlap, and one that is too short still uses up
    its characters.  Kinds that carry a checksum count only if it holds.  Time is linear in the text:
    bytes are mapped to code points once, and no stretch is tried again from within.
    """
    raw = text.encode()
    found: list[tuple[int, str, int]] = []
    used = dict.fromkeys(KEYWORDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(raw.lower().decode("latin-1")))
    if hits and len(raw) != len(text):
        point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        hits = [(int(point[at]), kind) for at, kind in hits]
    for at, kind in hits:
        if kind == "card":
            for m in CARD.finditer(text, max(at, used[kind]), min(len(text), at + NEAR + 20)):
                if m.start() <= at + NEAR:
                    used[kind] = m.end()
                    if luhn(m[0]):
                        found.append((m.start(), kind, m.end()))
            continue
        if at < used[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, at)
            ok = m and len(m[2]) >= 12
        elif kind == "access":
            m = ACCESS.match(text, at)
            ok = m and m.end() - at >= 18
        elif kind in ("github", "npm"):
            m = PREFIXED.match(text, at)
            ok = m and crc62(m[1]) == m[2]
        elif kind == "jwt":
            m = JWT.match(text, at)
            ok = m and jwt_header(m[1])
            if not m and (run := TOKEN.match(text, at)):
                used[kind] = run.end()  # what starts within this run ends with it, and fails too
        else:
            m = PEM.match(text, at)
            ok = bool(m)
        if m:
            used[kind] = m.end()
            if ok:
                found.append((at, kind, m.end()))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return found


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each maximal run of secret characters replaced by a mark that names its first kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of every whole text: doc_id, spans (array of kind, start, end in code points), redacted where asked for (null where there is nothing to mask); then the `carry` columns.

    One pass, no shuffle.  Base kinds: assign, access, hex; the method adds github, npm (base-62 CRC-32),
    jwt (decodable header), pem blocks and card (13 to 19 digits alone, near a card keyword, Luhn).

    Cases: a null text is empty and has no spans; null ids and repeated rows are kept; texts of any
    length are scanned whole, in linear time; spans of several kinds at one start are all reported, in
    the order of KINDS; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in small_batches(batches, 1):
            spans, texts = [], []
            for t in b.column(1):
                text = t.as_py()
                s = find_secrets(text)
                spans.append([{"kind": k, "start": a, "end": e} for a, k, e in s])
                texts.append(redact(text, s) if s and with_redacted else None)
            cols = [b.column(0), pa.array(spans, span)] + ([pa.array(texts, pa.string())] if with_redacted else [])
            names = ["doc_id", "spans", "redacted"][: len(cols)]
            yield pa.RecordBatch.from_arrays(cols + [b.column(2 + i) for i in range(len(extra))], names + extra)

    extra = [f"_c{i}" for i in range(len(carry))]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, extra)])
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + (", redacted string" if with_redacted else "") + "".join(f", {c} {kinds[c]}" for c in extra)
    return slim.mapInArrow(run, schema)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
