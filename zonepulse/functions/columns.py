"""Reusable column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.model import NUMERIC_TEXT_PATTERN

EPS = 1e-9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of any kind (``trim`` only strips spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm_key(c) -> Column:
    """Trimmed, lower-cased text used for case-insensitive equality."""
    return F.lower(strip_ws(c))


def squeeze_lower(c) -> Column:
    """Lower-case, trim and collapse internal whitespace runs to one space."""
    return F.lower(F.regexp_replace(strip_ws(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))


def squeeze(c) -> Column:
    """Trim and collapse internal whitespace runs to one space (case kept)."""
    return F.regexp_replace(strip_ws(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " ")


def blank_to_null(c) -> Column:
    stripped = strip_ws(c)
    return F.when(stripped == "", F.lit(None)).otherwise(stripped)


def to_number(c) -> Column:
    """Text → double; only plain decimal/scientific numbers are accepted."""
    text = strip_ws(col(c).cast(T.StringType()))
    return F.when(text.rlike(NUMERIC_TEXT_PATTERN), text.try_cast(T.DoubleType()))


def rel_change(new, base) -> Column:
    """(new - base) / |base|, null when |base| <= 1e-9."""
    base = col(base)
    return F.when(F.abs(base) > EPS, (col(new) - base) / F.abs(base))


def round2(c) -> Column:
    """Two-decimal score rounding, identical in Spark and the SQL oracle."""
    return F.floor(col(c) * 100.0 + 0.5) / 100.0


def clamp(c, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def round_binary(c, digits: int = 6) -> Column:
    """Half-away-from-zero rounding of the binary value (x·10^d rounded,
    then divided), as SQL engines round doubles; ``round`` instead rounds the
    shortest decimal string, which splits exact decimal ties differently."""
    scale = float(10 ** digits)
    x = col(c)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used only at the edge for oracle comparison."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_binary(F.col(field.name), digits).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def union_all(frames, allow_missing: bool = False) -> DataFrame:
    """unionByName of many frames as a balanced tree: each union re-analyses
    its inputs, so a left-deep chain costs quadratic planning time."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    while len(frames) > 1:
        nxt = []
        for i in range(0, len(frames), 2):
            if i + 1 < len(frames):
                nxt.append(frames[i].unionByName(frames[i + 1], allowMissingColumns=allow_missing))
            else:
                nxt.append(frames[i])
        frames = nxt
    return frames[0]
