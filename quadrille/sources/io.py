"""Readers and writers of tables and images."""

from __future__ import annotations

import html as _html
import json
import math
import struct
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import AxisSizes, Dataset, Refusal, spine


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table from Parquet, CSV, JSON or ORC, by extension unless named."""
    kind = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json", "orc"):
        raise Refusal(f"no reader for {kind!r}")
    if kind == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(kind).options(**options).load(path)


def synthetic(spark: SparkSession, sizes: AxisSizes = AxisSizes(t=6, y=64, x=64), cells: int = 10, seed: int = 0) -> Dataset:
    """A deterministic image of moving bright discs, as a closed-form column over the axes' spine: nothing is stored."""
    rng = np.random.default_rng(seed)
    value = F.lit(100.0)
    for _ in range(cells):
        cy, cx = (float(rng.uniform(8, n - 8)) for n in (sizes.y, sizes.x))
        vy, vx = (float(v) for v in rng.uniform(-1, 1, 2))
        r = float(rng.uniform(3, 6))
        d2 = F.pow(F.col("y") - cy - vy * F.col("t"), 2) + F.pow(F.col("x") - cx - vx * F.col("t"), 2)
        value = value + F.lit(900.0) * F.exp(-d2 / (2 * r * r))
    df = spine(spark, sizes, ("m", "t", "z", "c", "y", "x")).withColumn("value", F.rint(value))
    return Dataset(sizes, {("voxel", "image"): df}, {"pixel_size_um": 0.325, "z_step_um": 1.0, "dt_s": 30.0, "bit_depth": 12})


def long_form(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """All tables under one schema, with domain and layer."""
    out = None
    for (domain, layer), df in sorted(tables.items(), key=lambda kv: kv[0]):
        d = df.select(F.lit(domain).alias("domain"), F.lit(layer).alias("layer"), *df.columns)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise Refusal("no table to write")
    return out


def write_table(data: Dataset, path: str, format: str = "parquet", layout: str = "auto", existing: str = "overwrite") -> Dataset:
    """Writes every structure table, as one long table or one folder a layer; passes the data on."""
    mode = {"overwrite": "overwrite", "refuse": "errorifexists"}[existing]
    tables = {k: v for k, v in data.layers.items() if k[0] in ("label", "point", "track")}
    kind = path.rstrip("/").rsplit(".", 1)[-1] if format == "auto" else format
    if kind not in ("csv", "parquet", "json", "orc"):
        raise Refusal(f"no writer for {kind!r}")
    if layout == "per_table":
        for (domain, layer), df in tables.items():
            df.write.format(kind).mode(mode).option("header", True).save(f"{path}/{domain}/{layer}")
    else:
        long_form(tables).write.format(kind).mode(mode).option("header", True).save(path)
    return data


def write_trial(data: Dataset, path: str, unit: Sequence[str] = ("m",)) -> None:
    """Saves tables for load_analysis: a Parquet folder a layer, and a manifest written last.

    Rows are dealt to files by ranges of the unit and sorted by it, so that a reader of one unit skips the rest by the files'
    statistics; the number of files goes with the data, not with the number of units, and a large unit takes several files.
    """
    rows = []
    for (domain, layer), df in data.layers.items():
        if domain in ("label", "point", "track"):
            keys = [u for u in unit if u in df.columns]
            d = df.repartitionByRange(*keys, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])).sortWithinPartitions(*keys) if keys else df
            d.write.mode("overwrite").parquet(f"{path}/{domain}/{layer}")
            rows.append((domain, layer))
    spark = next(iter(data.layers.values())).sparkSession
    spark.createDataFrame(rows, "domain string, layer string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_analysis(spark: SparkSession, path: str, onto: Dataset | None = None) -> Dataset:
    """Tables of a saved trial on their layers; only layers whose writing finished are in the manifest."""
    out = onto or Dataset()
    for r in spark.read.json(f"{path}/manifest").collect():
        out = out.put(r.domain, r.layer, spark.read.parquet(f"{path}/{r.domain}/{r.layer}"))
    return out


def dock(data: Dataset, path: str) -> Dataset:
    """Checkpoint of a chain: every layer written and read back, so the plan upstream is cut."""
    out = data
    for (domain, layer), df in data.layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{domain}/{layer}")
        out = out.put(domain, layer, df.sparkSession.read.schema(df.schema).parquet(f"{path}/{domain}/{layer}"))
    return out


def tiff_bytes(planes: Sequence[np.ndarray], description: str = "", compress: bool = False) -> bytes:
    """A multi-page little-endian TIFF of 8- or 16-bit or float planes, one strip a page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for i, p in enumerate(planes):
        p = np.ascontiguousarray(p)
        bits, fmt = p.dtype.itemsize * 8, 3 if p.dtype.kind == "f" else 1
        data = p.astype(p.dtype.newbyteorder("<")).tobytes()
        if compress:
            data = zlib.compress(data)
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        text = description.encode() + b"\0" if i == 0 and description else b""
        where = len(out)
        out += text + b"\0" * (len(text) % 2)
        tags = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 3, 1, bits), (259, 3, 1, 8 if compress else 1), (262, 3, 1, 1)]
        if text:
            tags.append((270, 2, len(text), where))
        tags += [(273, 4, 1, at), (277, 3, 1, 1), (278, 4, 1, p.shape[0]), (279, 4, 1, len(data)), (339, 3, 1, fmt)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> list[np.ndarray]:
    """Planes of a TIFF as tiff_bytes writes it."""
    at = struct.unpack_from("<I", data, 4)[0]
    out = []
    while at:
        n = struct.unpack_from("<H", data, at)[0]
        tags = {t[0]: t[3] for t in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}
        raw = data[tags[273] : tags[273] + tags[279]]
        raw = zlib.decompress(raw) if tags[259] == 8 else raw
        kind = {(8, 1): "u1", (16, 1): "<u2", (32, 1): "<u4", (32, 3): "<f4", (64, 3): "<f8"}[tags[258], tags.get(339, 1)]
        out.append(np.frombuffer(raw, kind).reshape(tags[257], tags[256]))
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]
    return out


def write_tiff(df: DataFrame, path: str, dtype: str = "uint16", compress: bool = False) -> DataFrame:
    """One file a position, encoded on the executors and returned as rows (m, content); save_files puts them in a folder.

    Rows of a position meet in one task, as the file needs them in order.
    """
    import pyarrow as pa

    axes = [a for a in ("t", "z", "c") if a in df.columns]

    def encode(t: pa.Table) -> pa.Table:
        cols = [t.column(a).to_numpy() for a in axes]
        y, x, v = (t.column(a).to_numpy() for a in ("y", "x", "value"))
        order = np.lexsort([x, y, *cols[::-1]])
        h, w = int(y.max()) + 1, int(x.max()) + 1
        a = v[order].astype(dtype).reshape(-1, h, w)
        meta = json.dumps({"axes": axes, "shape": [int(c.max()) + 1 for c in cols] + [h, w]})
        return pa.table({"m": pa.array([t.column("m")[0].as_py()], pa.int64()), "content": pa.array([tiff_bytes(a, meta, compress)], pa.binary())})

    return df.groupBy("m").applyInArrow(encode, "m long, content binary")


def save_files(rows: DataFrame, path: str, suffix: str) -> None:
    """Writes (m, content) rows to local or mounted files, one at a time through the driver."""
    import os

    os.makedirs(path, exist_ok=True)
    for r in rows.toLocalIterator():
        part = f"{path}/m{r.m}{suffix}.part"
        with open(part, "wb") as f:
            f.write(bytes(r.content))
        os.replace(part, f"{path}/m{r.m}{suffix}")


def png_bytes(plane: np.ndarray) -> bytes:
    a = np.ascontiguousarray(plane, np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def stretch(a: np.ndarray, low: float = 0.5, high: float = 99.7) -> np.ndarray:
    lo, hi = np.percentile(a, [low, high])
    return (np.clip((a - lo) / ((hi - lo) or 1.0), 0, 1) * 255).astype(np.uint8)


def frames_of(df: DataFrame, most_px: int = 1024, most_frames: int = 500) -> list[tuple[int, np.ndarray]]:
    """Planes of a movie for drawing: block means down to most_px on the cluster, then one frame at a time to the driver."""
    size = df.agg(F.max("y"), F.max("x"), F.countDistinct("t")).first()
    if size[2] > most_frames:
        raise Refusal(f"{size[2]} frames; at most {most_frames}")
    k = max(1, math.ceil(max(size[0], size[1], 1) / most_px))
    small = df.groupBy("t", F.floor(F.col("y") / k).alias("y"), F.floor(F.col("x") / k).alias("x")).agg(F.avg("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in small.orderBy("t").toLocalIterator():
        a = out.setdefault(r.t, np.zeros((size[0] // k + 1, size[1] // k + 1)))
        a[r.y, r.x] = r.value
    return sorted(out.items())


def write_html(df: DataFrame, path: str, title: str = "", most_px: int = 512, budget_mb: float = 250) -> int:
    """A page of frames that needs no other file; refused beyond its size budget.  Returns its bytes."""
    import base64

    parts = [f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1>"]
    for t, a in frames_of(df, most_px):
        parts.append(f"<figure><img alt='frame {t}' src='data:image/png;base64,{base64.b64encode(png_bytes(stretch(a))).decode()}'><figcaption>t = {t}</figcaption></figure>")
    page = "\n".join(parts)
    if len(page) > budget_mb * 1e6:
        raise Refusal(f"the page would take {len(page) / 1e6:.0f} MB; the budget is {budget_mb:g}")
    with open(path, "w") as f:
        f.write(page)
    return len(page)


def write_movie(df: DataFrame, path: str, most_px: int = 1200) -> int:
    """Frames as numbered PNG files; formats that need an encoder are refused."""
    import os

    if path.endswith((".mp4", ".gif", ".jpeg")):
        raise Refusal("mp4, gif and jpeg need an encoder package, which is not installed; give a folder for PNG frames")
    os.makedirs(path, exist_ok=True)
    frames = frames_of(df, most_px)
    for t, a in frames:
        with open(f"{path}/t{t:05d}.png", "wb") as f:
            f.write(png_bytes(stretch(a)))
    return len(frames)


def svg(series: Iterable[tuple[str, Sequence[tuple[float, float]]]], title: str = "", width: int = 640, height: int = 400) -> str:
    """A line chart of already aggregated series."""
    series = [(n, [(x, y) for x, y in p if math.isfinite(x) and math.isfinite(y)]) for n, p in series]
    pts = [q for _, p in series for q in p] or [(0.0, 0.0)]
    lo = [min(q[i] for q in pts) for i in (0, 1)]
    hi = [max(q[i] for q in pts) for i in (0, 1)]
    at = lambda x, y: (50 + (x - lo[0]) / ((hi[0] - lo[0]) or 1) * (width - 70), height - 40 - (y - lo[1]) / ((hi[1] - lo[1]) or 1) * (height - 70))
    colors = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377")
    body = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'><text x='50' y='20'>{_html.escape(title)}</text>"]
    for i, (name, p) in enumerate(series):
        c = colors[i % len(colors)]
        body.append(f"<polyline fill='none' stroke='{c}' points='{' '.join('%.1f,%.1f' % at(*q) for q in p)}'/><text x='{width - 120}' y='{40 + 16 * i}' fill='{c}'>{_html.escape(str(name))}</text>")
    return "".join(body) + "</svg>"


def write_figure(df: DataFrame, path: str, x: str, y: str, series: str | None = None, title: str = "", most: int = 100_000, existing: str = "overwrite") -> None:
    """An SVG of an aggregated table; refused beyond `most` points, since a figure is drawn on the driver."""
    import os

    if existing == "refuse" and os.path.exists(path):
        raise Refusal(f"{path} exists")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(series) if series else F.lit("")).cast("string").alias("s")).limit(most + 1).collect()
    if len(rows) > most:
        raise Refusal(f"more than {most} points; aggregate first")
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.s or "", r.x or 0)):
        by.setdefault(r.s, []).append((r.x if r.x is not None else math.nan, r.y if r.y is not None else math.nan))
    with open(path, "w") as f:
        f.write(svg(by.items(), title))
