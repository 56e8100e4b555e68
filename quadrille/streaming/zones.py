"""State carried along time: simulation zones in batch, and windows and state over event streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def frame(df: DataFrame, index: int) -> DataFrame:
    """The rows of one step of a zone."""
    return df.where(F.col("t") == index)


def simulate(df: DataFrame, step: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str, keys: Sequence[str] = ("m",), order: Sequence[str] = ("t",), start: Callable[[], dict] = dict) -> DataFrame:
    """Simulation zone: each series in order of time, step by step, with a state the step may change.

    Strictly ordered within a series, so a series is one task; series run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        return pd.concat([step(f, state) for _, f in pdf.sort_values(list(order), kind="stable").groupby(order[0], sort=True)])

    return df.groupBy(*keys).applyInPandas(run, schema)


def read_events(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour", keys: Sequence[str] = ("event_type",), value: str = "value") -> DataFrame:
    """Mean, sum and n of values in event-time windows; rows later than the watermark are left out in a stream."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    d = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Runs of events with no longer gap between them."""
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return d.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_track(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """Custom state in a stream: per key, events so far, running mean and greatest value after each batch."""

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, top = state.get if state.exists else (0, 0.0, float("-inf"))
        for b in batches:
            v = b[value].dropna()
            n, total, top = n + len(v), total + float(v.sum()), max(top, float(v.max()) if len(v) else float("-inf"))
        state.update((n, total, top))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else float("nan")], "top": [top]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, mean double, top double", "n long, total double, top double", "update", GroupStateTimeout.NoTimeout)
