"""Physical units as exponents of base dimensions, checked when a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

#: Unit -> (base dimension, factor to that base).
TABLE = {
    "um": ("um", 1.0), "nm": ("um", 1e-3), "mm": ("um", 1e3), "m": ("um", 1e6), "px": ("px", 1.0),
    "s": ("s", 1.0), "ms": ("s", 1e-3), "min": ("s", 60.0), "h": ("s", 3600.0),
    "Pa": ("Pa", 1.0), "kPa": ("Pa", 1e3), "deg": ("deg", 1.0), "rad": ("deg", 57.29577951308232),
    "frame": ("frame", 1.0), "count": ("count", 1.0),
}


class UnitError(ValueError):
    """Units that do not fit an operation."""


@dataclass(frozen=True)
class Unit:
    powers: tuple[tuple[str, Fraction], ...] = ()
    factor: float = 1.0

    @classmethod
    def parse(cls, text: str | None) -> Unit | None:
        """A unit such as um2, um/s or Pa*s; None for unknown, the empty string for a plain number."""
        if text is None:
            return None
        powers: dict[str, Fraction] = {}
        factor, sign = 1.0, 1
        for token in re.findall(r"[*/]|[A-Za-zµ]+\^?-?\d*", text.replace("µ", "u")):
            if token in "*/":
                sign = 1 if token == "*" else -1
                continue
            name, power = re.fullmatch(r"([A-Za-z]+)\^?(-?\d*)", token).groups()
            if name not in TABLE:
                raise UnitError(f"unknown unit {name!r}")
            base, scale = TABLE[name]
            p = sign * int(power or 1)
            powers[base] = powers.get(base, Fraction(0)) + p
            factor *= scale**p
        return cls(tuple(sorted((k, v) for k, v in powers.items() if v)), factor)

    @property
    def plain(self) -> bool:
        return not self.powers

    def times(self, other: Unit, sign: int = 1) -> Unit:
        powers = dict(self.powers)
        for k, v in other.powers:
            powers[k] = powers.get(k, Fraction(0)) + sign * v
        return Unit(tuple(sorted((k, v) for k, v in powers.items() if v)), self.factor * other.factor**sign)

    def power(self, n: Fraction | float) -> Unit:
        n = Fraction(n).limit_denominator(12)
        return Unit(tuple((k, v * n) for k, v in self.powers), self.factor ** float(n))

    def to(self, other: Unit) -> float:
        """Factor that turns numbers of this unit into numbers of the other."""
        if self.powers != other.powers:
            raise UnitError(f"{self} does not convert to {other}")
        return self.factor / other.factor

    def __str__(self) -> str:
        part = lambda k, v: k if v == 1 else f"{k}{v}"
        up = "*".join(part(k, v) for k, v in self.powers if v > 0)
        down = "".join("/" + part(k, -v) for k, v in self.powers if v < 0)
        return (up or "1" * bool(down)) + down
