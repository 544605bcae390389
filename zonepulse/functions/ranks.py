"""Positions by a distributed sort, and exact quantiles by radix selection.

Nothing here gathers a group, or the whole table, in one task. For positions,
rows are range-partitioned and sorted, numbered inside their partitions, and
shifted by the number of rows in the partitions before (one count per
partition). Quantiles need no order of the rows, only counts by leading bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.session import materialize


def numbered(ordered: DataFrame, name: str = "position", first: int = 1) -> DataFrame:
    """The rows of an ordered frame with their position, an integer from ``first``.

    The frame is written once (checkpoint), so that positions stay as they are.
    The list of partition sizes is the only thing that comes to the driver.
    """
    placed = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = sorted((r["part"], r["rows"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect())
    before, shifts = 0, []
    for number, rows in sizes:
        shifts.append((number, before - (number << 33) + first))
        before += rows
    table = ordered.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    # one row per partition of the sort
    out = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return out.withColumn(name, F.col("_place") + F.col("_shift")).select(name, *ordered.columns)


# ---------------------------------------------------------------------------
# Exact quantiles by radix selection
# ---------------------------------------------------------------------------
#: Bits of a key that each of the three passes looks at, leading ones first (64 in all).
DIGITS = (22, 21, 21)

#: {x}: a double; {e}: its exponent; 4503599627370496 is 2^52, 0x1p537 squared times the least double is 1.
_KEY = """CASE WHEN {x} < 0 THEN -1L ELSE 1L END * CASE
  WHEN abs({x}) < 2.2250738585072014E-308D THEN CAST(abs({x}) * pow(2D, 537D) * pow(2D, 537D) AS BIGINT)
  WHEN abs({x}) > 1.7976931348623157E308D THEN 2047 * 4503599627370496L
  ELSE ({e} + 1023) * 4503599627370496L + CAST((abs({x}) / pow(2D, {e}) - 1D) * 4503599627370496D AS BIGINT) END"""
_EXPONENT = "({g} - CAST(pow(2D, {g}) > abs({x}) AS INT) + CAST(pow(2D, {g} + 1) <= abs({x}) AS INT))"
_VALUE = """CASE WHEN {k} < 0 THEN -1D ELSE 1D END * CASE
  WHEN abs({k}) < 4503599627370496L THEN abs({k}) / pow(2D, 537D) / pow(2D, 537D)
  ELSE (1D + (abs({k}) & 4503599627370495L) / 4503599627370496D) * pow(2D, CAST(shiftright(abs({k}), 52) - 1023 AS DOUBLE)) END"""


def order_key(x: str) -> str:
    """SQL for a 64-bit integer that orders as the double ``x`` does: the bits of
    its absolute value, negated for negative numbers (both zeros give 0).

    Arithmetic only. ``pow`` is exact on integers, so the exponent guessed by
    ``log2`` can be put right, and a division by a power of two loses nothing.
    """
    return _KEY.format(x=x, e=_EXPONENT.format(x=x, g=f"floor(log2(abs({x})))"))


def key_value(k: str) -> str:
    """SQL for the double whose ``order_key`` is ``k``."""
    return _VALUE.format(k=k)


def _digit(level: int) -> str:
    shifted = f"shiftright(_k, {sum(DIGITS[level + 1 :])})"  # keeps the sign
    return shifted if level == 0 else f"({shifted} & {2 ** DIGITS[level] - 1}L)"


def _rows(level: int, keys: list[str], columns: list[str]) -> str:
    """The rows that a pass counts: all, or those whose leading digits hold an asked rank."""
    if level == 0:
        cells = ", ".join(f"named_struct('c', {i}, 'v', CAST(`{c}` AS DOUBLE))" for i, c in enumerate(columns))
        given = ", ".join([*keys, f"explode(array({cells})) AS _cell"])
        return f"SELECT {', '.join([*keys, '_cell.c AS _c'])}, CASE WHEN NOT isnan(_cell.v) THEN {order_key('_cell.v')} END AS _k FROM (SELECT {given} FROM {{df}})"
    own = [*keys, "_c", *(f"_d{i}" for i in range(level - 1))]
    same = " AND ".join([*(f"r.{c} <=> w.{c}" for c in own), f"r._d{level - 1} <=> w._d{level - 1}"])
    return f"SELECT r.*, w._asks FROM (SELECT * {'' if level == 1 else 'EXCEPT (_asks)'}, {_digit(level - 1)} AS _d{level - 1} FROM rows{level - 1}) r JOIN located{level - 1} w ON {same}"


def _located(level: int, keys: list[str], asked: str) -> str:
    """Counts by the pass's digit, and of them the digits that hold an asked rank, the asks counted from their own first row."""
    own = [*keys, "_c", *(f"_d{i}" for i in range(level)), *(["_asks"] if level else [])]
    d = f"_d{level}"
    place = "a.p * (_total - 1)"
    ends = ", ".join(f"named_struct('name', a.name, 'end', {e}, 'part', {place} - floor({place}), 'rank', floor({place}) + {e})" for e in (0, 1))
    asks = f"flatten(transform(filter({asked}, a -> a.c = _c), a -> array({ends})))" if level == 0 else "_asks"
    part = f"PARTITION BY {', '.join(own)}"
    return f"""SELECT * EXCEPT (_given, _n, _before, _total), transform(filter(_given, a -> _total = 0 OR a.rank >= _before AND a.rank < _before + _n),
          a -> named_struct('name', a.name, 'end', a.end, 'part', a.part, 'rank', a.rank - _before)) AS _asks
      FROM (SELECT * {'EXCEPT (_asks)' if level else ''}, {asks} AS _given FROM (
        SELECT *, coalesce(sum(_n) OVER ({part} ORDER BY {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before, sum(_n) OVER ({part}) AS _total
        FROM (SELECT {', '.join(own)}, {_digit(level)} AS {d}, count(_k) AS _n, min(_k) AS _least FROM rows{level} GROUP BY ALL)))
      WHERE exists(_given, a -> _total = 0 OR a.rank >= _before AND a.rank < _before + _n)"""


def group_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: one row per group
    with a column for each of ``wanted`` (output name -> (column, fraction)).

    Selection without a sort. A pass counts each group's values by the leading
    bits of their order key (added up before the shuffle, at most 2^22 counts a
    group however many rows it has); running sums of the counts say which digit
    holds an asked rank. Only the rows of such digits are counted by the next
    pass, and after the third all 64 bits are known. Nothing is written and
    building the frame runs no job. Nulls and NaN do not count; a group without
    values gives null.
    """
    columns = sorted({c for c, _ in wanted.values()})
    names = [f"`{k}`" for k in keys]
    asked = "array(" + ", ".join(f"named_struct('c', {columns.index(c)}, 'name', '{n}', 'p', {float(p)!r}D)" for n, (c, p) in wanted.items()) + ")"
    steps = []
    for level in range(len(DIGITS)):
        steps += [f"rows{level} AS ({_rows(level, names, columns)})", f"located{level} AS ({_located(level, names, asked)})"]
    out = list(names)
    for name in wanted:
        low, high = (f"max(CASE WHEN _a.name = '{name}' AND _a.end = {e} THEN _v END)" for e in (0, 1))
        part = f"max(CASE WHEN _a.name = '{name}' THEN _a.part END)"
        out.append(f"{low} + CASE WHEN {part} > 0 THEN ({high} - {low}) * {part} ELSE 0D END AS `{name}`")
    last = f"SELECT {', '.join([*names, 'explode(_asks) AS _a'])}, {key_value('_least')} AS _v FROM located{len(DIGITS) - 1}"
    text = f"WITH {', '.join(steps)} SELECT {', '.join(out)} FROM ({last})" + (f" GROUP BY {', '.join(names)}" if names else "")
    return df.sparkSession.sql(text, df=df)
