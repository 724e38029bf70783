"""Literals, and numeric helpers whose results must not depend on the engine's rounding mode."""

from __future__ import annotations

import math
from collections.abc import Iterable


def quote(text: str | None) -> str:
    """A string literal."""
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num(x: float) -> str:
    """A double literal; a number that is not finite has none."""
    if not math.isfinite(x):
        raise ValueError(f"{x!r} cannot stand in an expression")
    return f"({float(x)!r}D)" if x < 0 else f"{float(x)!r}D"


def listed(texts: Iterable[str]) -> str:
    return ", ".join(quote(t) for t in texts)


def _scaled_half_even(x: str, digits: int) -> str:
    """|x| * 10**digits as a whole number, half-even on the exact binary value.

    Spark's round() and format_string() round the shortest decimal text half-up, so
    0.1235 becomes 0.124 although its binary value lies below the tie.  Here x is cut into
    a float and the rest, whose products with the power of ten are exact, and the sign of
    the exact remainder decides.
    """
    power = num(10 ** digits)
    high = f"double(float(abs({x})))"
    whole = f"floor(abs({x}) * {power})"
    rest = f"({high} * {power} - (double({whole}) + 0.5D)) + (abs({x}) - {high}) * {power}"
    # a tie goes up from odd numbers only: there the remainder need not be above zero
    return f"({whole} + bigint({rest} > if({whole} % 2 = 1, -4.9E-324D, 0.0D)))"


def fixed(x: str, digits: int) -> str:
    """Text of x with a fixed number of decimals ('%.3f'), half-even on the exact binary value.

    format_number rounds so; format_string and round do not.  Only half of the last place
    itself it always rounds down, also where the binary value lies above the half.
    """
    half = float(f"5e-{digits + 1}")
    goes_up = float(f"{half:.{digits}f}") > 0
    value = f"if(abs({x}) = {num(half)}, {x} * 2.0D, {x})" if goes_up else x
    return f"format_number({value}, '0{'.' * bool(digits)}{'0' * digits}')"


def percent(x: str, digits: int) -> str:
    """Text of x as a percentage ('%.1%')."""
    return f"concat({fixed(f'({x} * 100.0D)', digits)}, '%')"


def rounded(x: str, digits: int) -> str:
    """x rounded half-even on its binary value, as a double; NaN becomes NULL.

    From 2**53 / 10**digits on a double has no such digits and stays as it is.
    """
    value = f"(double({_scaled_half_even(x, digits)}) / {num(10 ** digits)} * if({x} < 0, -1.0D, 1.0D))"
    return f"if({x} IS NULL OR isnan({x}), null, if(abs({x}) >= {num(2 ** 53 / 10 ** digits)}, double({x}), {value}))"


def ratio(a: str, b: str, empty: str = "0.0D") -> str:
    """a / b as double; `empty` where b is zero."""
    return f"coalesce(try_divide(double({a}), double({b})), {empty})"


def share(condition: str) -> str:
    """Aggregate: share of rows where the condition holds."""
    return f"avg(int({condition}))"


def nan_to_null(x: str) -> str:
    return f"if(isnan({x}), null, {x})"


def clip(x: str, low: float = 0.0, high: float = 1.0) -> str:
    """x within bounds; NULL and NaN are NULL, and the caller chooses what stands for them."""
    return f"if({x} IS NULL OR isnan({x}), null, greatest({num(low)}, least({num(high)}, {x})))"


def uniform(key: str, tag: str) -> str:
    """A number in [0, 1) that depends on key and tag only, never on the partitioning."""
    digest = f"md5(concat(string({key}), {quote(':' + tag)}))"
    return f"(double(bigint(conv(substring({digest}, 1, 8), 16, 10))) / 4294967296.0D)"
