"""Domains, axes and the Dataset that operators pass on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("b", "m", "t", "z", "c", "y", "x")
#: Axes of the lattice domains, finest first.
LATTICE = {
    "voxel": ("b", "m", "t", "z", "c", "y", "x"),
    "plane": ("b", "m", "t", "z"),
    "frame": ("b", "m", "t"),
    "timepoint": ("b", "t"),
    "multipoint": ("b", "m"),
    "batch": ("b",),
    "channel": ("c",),
    "global": (),
}
STRUCTURES = ("label", "point", "track", "mesh")
COORDS = ("id", "b", "m", "t", "c", "z", "y", "x")


class Refusal(ValueError):
    """A request that an operator does not carry out; the message says what to change."""


def meet(a: str, b: str) -> tuple[str, ...]:
    """Axes that two lattice domains share."""
    return tuple(x for x in LATTICE[a] if x in LATTICE[b])


def join(a: str, b: str) -> str | None:
    """The domain whose axes are the union, if there is one."""
    axes = tuple(x for x in AXES if x in LATTICE[a] or x in LATTICE[b])
    return next((d for d, own in LATTICE.items() if own == axes), None)


def is_finer(a: str, b: str) -> bool:
    """Whether a has every axis of b, as it has if they are equal."""
    return set(LATTICE[a]) >= set(LATTICE[b])


def dropped_axes(a: str, b: str) -> tuple[str, ...]:
    return tuple(x for x in LATTICE[a] if x not in LATTICE[b])


@dataclass(frozen=True)
class AxisSizes:
    b: int = 1
    m: int = 1
    t: int = 1
    z: int = 1
    c: int = 1
    y: int = 1
    x: int = 1

    def of(self, domain: str) -> dict[str, int]:
        return {a: getattr(self, a) for a in LATTICE[domain]}


@dataclass(frozen=True)
class Dataset:
    """Immutable bundle of layers, each a DataFrame, with axis sizes and metadata; every operator returns a new one.

    layers: (domain, layer name) -> DataFrame.  A lattice layer has its domain's axes that are present and
    one column an attribute; a structure layer has id and coordinates.
    """

    axes: AxisSizes = AxisSizes()
    layers: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def layer(self, domain: str, name: str = "") -> DataFrame:
        """The named layer; a blank name means the only one of its domain."""
        if name:
            if (domain, name) not in self.layers:
                raise Refusal(f"no {domain} layer {name!r}; there are {sorted(n for d, n in self.layers if d == domain)}")
            return self.layers[domain, name]
        own = [v for (d, _), v in self.layers.items() if d == domain]
        if len(own) != 1:
            raise Refusal(f"{len(own)} {domain} layers: name one")
        return own[0]

    def put(self, domain: str, name: str, df: DataFrame) -> Dataset:
        if domain in ("label", "point", "track") and self.axes.b > 1 and "b" not in df.columns:
            raise Refusal(f"{domain} layer {name!r} of a batch needs the column b")
        return replace(self, layers=self.layers | {(domain, name): df})

    def drop(self, domain: str, name: str) -> Dataset:
        return replace(self, layers={k: v for k, v in self.layers.items() if k != (domain, name)})

    def meta(self, **changes) -> Dataset:
        return replace(self, metadata={k: v for k, v in (self.metadata | changes).items() if v is not None})

    def map_layers(self, f) -> Dataset:
        return replace(self, layers={k: f(k[0], v) for k, v in self.layers.items()})


def spine(spark, sizes: AxisSizes, axes: tuple[str, ...]) -> DataFrame:
    """One row for each index of the axes."""
    out = spark.range(1).drop("id")
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(getattr(sizes, a) - 1).cast("long"))))
    return out


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Refusal(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
