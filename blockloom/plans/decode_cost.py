"""Operations that decoding takes, as a symbolic expression and as a number."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Expr:
    text: str
    value: float

    def __add__(self, other: Expr | float) -> Expr:
        o = lift(other)
        return Expr(f"({self.text} + {o.text})", self.value + o.value)

    def __mul__(self, other: Expr | float) -> Expr:
        o = lift(other)
        return Expr(f"{self.text} * {o.text}", self.value * o.value)

    def __truediv__(self, other: Expr | float) -> Expr:
        o = lift(other)
        return Expr(f"{self.text} / {o.text}", self.value / o.value)


def lift(x: Expr | float) -> Expr:
    return x if isinstance(x, Expr) else Expr(str(x), float(x))


def inverse_transform_cost(windows: list[int], size: int) -> Expr:
    """Operations to invert all levels of a size x size image: w w (2 w w - 1) a block of side w."""
    total, side = lift(0), size
    for w in windows:
        side //= w
        total = total + lift(side * side) * lift(w * w) * lift(2 * w * w - 1)
    return total


def upsample_cost(size: int) -> Expr:
    """Operations of one doubling to size x size by a six-tap filter in both axes."""
    return lift(80) * lift(size * size)


def decode_cost(resolutions: dict[int, list[int]]) -> Expr:
    total = lift(0)
    for size in sorted(resolutions):
        total = total + inverse_transform_cost(resolutions[size], size)
    for size in sorted(resolutions)[1:]:
        total = total + upsample_cost(size)
    return total
