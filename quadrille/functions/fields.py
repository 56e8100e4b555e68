"""Deferred field expressions: built without a table, evaluated as a Column on the domain that uses them.

    f = Where(Input("value") > Attr("frame", "mean") * 2, Input("value"), Const(0.0))
    evaluate(f, data, voxels, "voxel", inputs={"value": F.col("value")})

Arithmetic is that of floating point: x / 0 is infinite or NaN, not missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import LATTICE, Dataset, Refusal
from .missing import NAN
from .reducers import reduce_column


class Field:
    """An expression; operators build larger ones."""

    def __add__(self, other):
        return BinOp("+", self, field(other))

    def __radd__(self, other):
        return BinOp("+", field(other), self)

    def __sub__(self, other):
        return BinOp("-", self, field(other))

    def __rsub__(self, other):
        return BinOp("-", field(other), self)

    def __mul__(self, other):
        return BinOp("*", self, field(other))

    def __rmul__(self, other):
        return BinOp("*", field(other), self)

    def __truediv__(self, other):
        return BinOp("/", self, field(other))

    def __rtruediv__(self, other):
        return BinOp("/", field(other), self)

    def __pow__(self, other):
        return BinOp("**", self, field(other))

    def __gt__(self, other):
        return BinOp(">", self, field(other))

    def __ge__(self, other):
        return BinOp(">=", self, field(other))

    def __lt__(self, other):
        return BinOp("<", self, field(other))

    def __le__(self, other):
        return BinOp("<=", self, field(other))

    def __and__(self, other):
        return BinOp("and", self, field(other))

    def __or__(self, other):
        return BinOp("or", self, field(other))

    def __neg__(self):
        return UnaryOp("neg", self)

    def __invert__(self):
        return UnaryOp("not", self)


@dataclass(frozen=True, eq=False)
class Const(Field):
    """The same value everywhere: a literal, so nothing is stored."""

    value: float


@dataclass(frozen=True, eq=False)
class Attr(Field):
    """A column of a layer of a dataset; on another lattice domain it is broadcast, or reduced by the named reducer."""

    domain: str
    name: str
    layer: str = ""
    reducer: str = "mean"


@dataclass(frozen=True, eq=False)
class Input(Field):
    """A value that the user of the field binds."""

    name: str


@dataclass(frozen=True, eq=False)
class UnaryOp(Field):
    op: str
    a: Field


@dataclass(frozen=True, eq=False)
class BinOp(Field):
    op: str
    a: Field
    b: Field


@dataclass(frozen=True, eq=False)
class Where(Field):
    condition: Field
    a: Field
    b: Field


def field(value) -> Field:
    return value if isinstance(value, Field) else Const(float(value))


def quotient(a: Column, b: Column) -> Column:
    """IEEE division."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, F.when(F.isnan(a), float("nan")).otherwise(at_zero)).otherwise(F.try_divide(a, b))


BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": quotient, "**": F.pow, "min": F.least, "max": F.greatest,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}
UNARY = {"neg": lambda a: -a, "abs": F.abs, "sqrt": lambda a: F.sqrt(a), "log": lambda a: F.when(a > 0, F.log(a)).when(a == 0, float("-inf")).otherwise(float("nan")), "exp": F.exp, "not": lambda a: ~a}


def attributes(f: Field) -> list[Attr]:
    if isinstance(f, Attr):
        return [f]
    return [a for part in vars(f).values() if isinstance(part, Field) for a in attributes(part)]


def column(f: Field, inputs: Mapping[str, Column], bound: Mapping[Attr, str]) -> Column:
    if isinstance(f, Const):
        return F.lit(f.value)
    if isinstance(f, Input):
        if f.name not in inputs:
            raise Refusal(f"the field's input {f.name!r} is not bound")
        return inputs[f.name]
    if isinstance(f, Attr):
        return F.col(bound[f])
    if isinstance(f, UnaryOp):
        return UNARY[f.op](column(f.a, inputs, bound))
    if isinstance(f, BinOp):
        return BINARY[f.op](column(f.a, inputs, bound), column(f.b, inputs, bound))
    return F.when(column(f.condition, inputs, bound), column(f.a, inputs, bound)).otherwise(column(f.b, inputs, bound))


def evaluate(f: Field, data: Dataset, target: DataFrame, domain: str, name: str = "field", inputs: Mapping[str, Column] | None = None) -> DataFrame:
    """target (rows of a lattice domain) with the field as a column.

    Attributes of the domain itself, or of a coarser one, are looked up by their axes; finer ones are
    first reduced to the domain's axes.  Each lookup is an equi-join on axes, with one row a place.
    """
    out, bound = target, {}
    for i, a in enumerate(dict.fromkeys(attributes(f))):
        if a.domain not in LATTICE or domain not in LATTICE:
            raise Refusal(f"a field can't move from {a.domain} to {domain}; use a bridge")
        src = data.layer(a.domain, a.layer)
        if a.name not in src.columns:
            raise Refusal(f"no attribute {a.name!r} on {a.domain}")
        on = [x for x in LATTICE[domain] if x in src.columns and x in target.columns]
        finer = [x for x in LATTICE[a.domain] if x in src.columns and x not in LATTICE[domain]]
        if finer:
            src = src.groupBy(*on).agg(reduce_column(a.reducer, a.name, empty_sum=NAN, order=F.struct(*finer)).alias(a.name))
        bound[a] = f"_f{i}"
        one = src.select(*on, F.col(a.name).alias(bound[a]))
        out = out.join(one, on, "left") if on else out.crossJoin(F.broadcast(one))  # a global value is one row
    return out.withColumn(name, column(f, inputs or {}, bound)).drop(*bound.values())
