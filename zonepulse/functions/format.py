"""Number and text formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.functions.columns import col


def _split(a: Column) -> tuple[Column, Column]:
    """Veltkamp split of a double into high and low halves (a = hi + lo)."""
    t = a * 134217729.0  # 2^27 + 1
    hi = t - (t - a)
    return hi, a - hi


def round_exact(c, decimals: int) -> Column:
    """Round x·10^d to an integer as Python does: half to even on the exact
    binary value of x.

    p = x·10^d is rounded to the nearest double, which can land exactly on a
    half although the true product is not (12.345·100 → 1234.5). The exact
    error of that product (Dekker's TwoProduct, plain double arithmetic)
    decides the direction; only a zero error is a true tie.
    """
    x = col(c).cast(T.DoubleType())
    scale = float(10 ** decimals)
    p = x * scale
    xh, xl = _split(x)
    sh, sl = _split(F.lit(scale))
    err = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    fl = F.floor(p).cast(T.DoubleType())
    half = (p - fl) == 0.5
    tie_even = fl + F.when(F.pmod(fl, F.lit(2.0)) != 0, 1.0).otherwise(0.0)
    return (
        F.when(half & (err > 0), fl + 1.0)
        .when(half & (err < 0), fl)
        .when(half, tie_even)
        .otherwise(F.rint(p))
    )


def fixed(c, decimals: int) -> Column:
    """``%.<d>f`` with Python's rounding (half to even on the exact binary
    value); Java's formatter alone rounds its shortest decimal string half up."""
    scale = float(10 ** decimals)
    return F.format_string(f"%.{decimals}f", round_exact(c, decimals) / scale)


def format_number(c, decimals: int = 4) -> Column:
    """Whole numbers without decimals, others with up to ``decimals``
    places, trailing zeros trimmed. Null stays null."""
    x = col(c).cast(T.DoubleType())
    text = fixed(x, decimals)
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")
    whole = x == F.floor(x)
    return F.when(x.isNull(), F.lit(None)).when(whole, x.cast(T.LongType()).cast(T.StringType())).otherwise(trimmed)


def format_pct_ratio(c, decimals: int = 2) -> Column:
    """Ratio as a percentage with ``decimals`` places, e.g. 0.1234 → 12.34%."""
    return F.concat(fixed(col(c).cast(T.DoubleType()) * 100.0, decimals), F.lit("%"))


def format_metric_value(value, value_format: Column | str, decimals: Column | int) -> Column:
    """M7: display a value by its metric's format; null → "N/A".

    integer: rounded half to even; percentage_ratio: ×100 with a % sign;
    number: fixed decimals.
    """
    v = col(value).cast(T.DoubleType())
    fmt = value_format if isinstance(value_format, Column) else F.lit(value_format)
    d = decimals if isinstance(decimals, Column) else F.lit(decimals)
    pattern = F.concat(F.lit("%."), d.cast("string"), F.lit("f"))
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("N/A"))
        .when(fmt == "integer", round_exact(v, 0).cast(T.LongType()).cast(T.StringType()))
        .when(fmt == "percentage_ratio", F.concat(_printf(pattern, v * 100.0), F.lit("%")))
        .otherwise(_printf(pattern, v))
    )


def _printf(pattern: Column, v: Column) -> Column:
    """format_string with a pattern column (decimals vary per row)."""
    return F.when(pattern == "%.0f", fixed(v, 0)).when(
        pattern == "%.1f", fixed(v, 1)).when(
        pattern == "%.2f", fixed(v, 2)).when(
        pattern == "%.3f", fixed(v, 3)).otherwise(fixed(v, 4))
