"""Packing by power-of-two decomposition (operator 5)."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gapless, numbered_rows, text_of

#: Texts with other characters, or with what may be a special token, go to the slower reference library.
UNUSUAL = re.compile(r"[^\x00-ɏ‐-‧€]|<\|")
EOT = 0


@functools.lru_cache(maxsize=4)
def tokenizer(vocabulary: str, ranks: str | None):
    """A function from a list of texts to a list of uint32 arrays, each with the closing id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary)
    fast = None
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("same-vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and not UNUSUAL.search(text):
            ids = fast.encode_ordinary(text)
        else:
            ids = reference.encode(text, add_special_tokens=False).ids
        ids.append(EOT)
        return np.asarray(ids, "<u4")

    return encode


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many of the longest as fit, then one per set bit of the rest, descending."""
    out = [(s, longest) for s in range(0, n - longest + 1, longest)]
    start, rest = n // longest * longest, n % longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, longest: int = 1024, *, vocabulary: str | None = None, ranks: str | None = "same", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, cut into pieces of power-of-two lengths: doc_id, start, length, doc_tokens, ids.

    ids: little-endian unsigned 32-bit ids.  ranks: the vocabulary as ranks for the fast encoder, None for
    the reference library alone; the ids are the same.
    """
    bound_batches(docs.sparkSession)
    import public_tokenizers

    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if ranks == "same" else ranks

    def run(batches):
        encode = tokenizer(vocabulary, ranks)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                for s, n in binary_pieces(len(ids), longest):
                    for c, v in zip(cols, (doc, s, n, len(ids), ids[s : s + n].tobytes())):
                        c.append(v)
                    held += n
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECE.types)], schema=PIECE)
                    cols, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECE.types)], schema=PIECE)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, longest: int = 1024, *, keep_ids: bool = True, **options) -> DataFrame:
    """Sequences for training: each is one piece, of a power-of-two length, so none crosses documents or has padding.

    Sequences are numbered without gaps, longest bucket first, so that sequences of one length lie
    together and a trainer can draw whole batches of a length.  Returns the columns of pieces() and
    ids_crc32, sequence_id, offset (always 0).

    Cases: a null or empty text is the closing id alone; a text of any length is cut whole, in the task
    that reads it; null ids are kept; repeated rows give sequences of their own, and pieces equal in id
    and start are numbered in any order; an empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, longest, **options).withColumn("ids_crc32", F.crc32("ids"))
    cut = numbered_rows(cut if keep_ids else cut.drop("ids"), "pieces", keep=True)
    held = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = F.lit(0), 0
    for length in sorted(held, reverse=True):
        first = F.when(F.col("length") == length, F.lit(at)).otherwise(first)
        at += held[length]
    numbered = gapless(cut, "length", ["doc_id", "start"], held, "_slot")
    return numbered.withColumn("sequence_id", (first + F.col("_slot")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_slot")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1024, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
