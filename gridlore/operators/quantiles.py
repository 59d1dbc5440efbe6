"""Exact order statistics and interpolated quantiles.

``percentile`` keeps every distinct value of a column in one task, which is fine for a table of
bounded size. Beyond that the wanted ranks are located by narrowing: each pass counts the values
of the current intervals into equal-width cells, keeps the cells that hold a wanted rank and
shrinks them to their own minimum and maximum. A pass is one scan with map-side counting; only
cells are shuffled, never rows, and at most one row per wanted rank reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, types as T

from gridlore.functions.exprs import double, number, quote, text, types_of
from gridlore.session import PARTS_PER_JOB, run_sql, small_frame

SMALL_ROWS = 200_000
CELLS = 2048
FINE_ROWS = 20_000
_TOP = 1.7976931348623157e308  # largest double; stands in for infinity while cells are cut


def pick_ranks(
    df: DataFrame,
    columns: list[str],
    ranks: dict[int, list[int]],
    bounds: dict[int, tuple[float, float]],
    cells: int = CELLS,
    fine_rows: int = FINE_ROWS,
) -> dict[tuple[int, int], float]:
    """Values at 0-based ``ranks`` of each column, given each column's minimum and maximum.

    Columns and results are keyed by position in ``columns``.
    """
    found: dict[tuple[int, int], float] = {}
    # open work: interval -> (rows below it, rows in it or None, ranks wanted in it)
    work = {
        (key, max(bounds[key][0], -_TOP), min(bounds[key][1], _TOP)): (0, None, sorted(set(wanted)))
        for key, wanted in ranks.items()
        if wanted
    }
    while True:
        for (key, low, high), (_, _, wanted) in list(work.items()):
            if low == high:
                found.update({(key, r): low for r in wanted})
                del work[key, low, high]
        if not work:
            return {k: math.copysign(math.inf, v) if abs(v) == _TOP else v for k, v in found.items()}
        work = _narrow(df, columns, work, cells, fine_rows)


def _narrow(df, columns, work, cells, fine_rows):
    by_column: dict[int, list[tuple]] = {}
    for i, ((key, low, high), (_, rows, _)) in enumerate(work.items()):
        by_column.setdefault(key, []).append((i, low, high, rows is not None and rows <= fine_rows))
    dtypes = types_of(df)
    placed = " UNION ALL ".join(
        _cells_sql(columns[key], dtypes[columns[key]], intervals, cells) for key, intervals in by_column.items()
    )
    wanted = ", ".join(
        f"({i}, {key}, {below}L, {r}L)"
        for i, ((key, _, _), (below, _, rs)) in enumerate(work.items())
        for r in rs
    )
    # a window group holds at most `cells` or `fine_rows` rows
    hits = run_sql(
        df.sparkSession,
        f"""
        SELECT key, lo, hi, below + before AS before, n, rank
        FROM (SELECT *, sum(n) OVER (PARTITION BY iv ORDER BY cell) - n AS before
              FROM (SELECT iv, cell, count(*) AS n, min(v) AS lo, max(v) AS hi FROM ({placed}) GROUP BY iv, cell))
        JOIN (SELECT * FROM VALUES {wanted} AS w(iv, key, below, rank)) USING (iv)
        WHERE rank - below >= before AND rank - below < before + n
        """,
        t=df,
    )
    following: dict = {}
    for h in hits.collect():
        entry = following.setdefault((h.key, h.lo, h.hi), (h.before, h.n, []))
        entry[2].append(h.rank)
    return following


def _cells_sql(name, dtype, intervals, cells):
    """The interval and cell of each value of one column; the branch scans that column alone."""
    low, high = min(i[1] for i in intervals), max(i[2] for i in intervals)
    v = double(quote(name), dtype)
    if max(abs(low), abs(high)) == _TOP:
        v = f"greatest({number(-_TOP)}, least({number(_TOP)}, {v}))"
    elif isinstance(dtype, (T.DoubleType, T.IntegralType)):
        v = f"CAST({quote(name)} AS DOUBLE)"  # keeps the range filter pushable; it drops NaN too
    iv, cell = "", ""
    for i, lo, hi, fine in intervals:
        # the halves of two neighbouring subnormal numbers may be equal
        place = "v" if fine or hi * 0.5 == lo * 0.5 else f"least({cells - 1}D, CAST(floor((v * 0.5D - {number(lo * 0.5)}) / {number(hi * 0.5 - lo * 0.5)} * {cells}D) AS DOUBLE))"
        inside = f"WHEN v BETWEEN {number(lo)} AND {number(hi)} THEN"
        iv += f" {inside} {i}"
        cell += f" {inside} {place}"
    return f"""
        SELECT * FROM (
            SELECT v, CASE{iv} END AS iv, CASE{cell} END AS cell
            FROM (SELECT {v} AS v FROM {{t}}) WHERE v BETWEEN {number(low)} AND {number(high)})
        WHERE iv IS NOT NULL"""


def _spot(n: int, p: float) -> tuple[int, int, float]:
    place = (n - 1) * p
    low = math.floor(place)
    return low, min(low + 1, n - 1), place - low


def _blend(low: float, high: float, weight: float) -> float:
    return low if weight == 0 or low == high else low + (high - low) * weight


def extent(df: DataFrame, columns: list[str]) -> dict[int, tuple[int, float, float]]:
    """Count, minimum and maximum of each numeric column, in one scan."""
    dtypes = types_of(df)
    aggs = []
    for k, name in enumerate(columns):
        v = double(quote(name), dtypes[name])
        aggs += [f"count({v}) AS n{k}", f"min({v}) AS lo{k}", f"max({v}) AS hi{k}"]
    row = df.selectExpr(*aggs).first()
    return {k: (row[f"n{k}"], row[f"lo{k}"], row[f"hi{k}"]) for k in range(len(columns))}


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    known: dict[int, tuple[int, float, float]] | None = None,
    small_rows: int = SMALL_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each numeric column over all rows.

    ``known`` passes counts, minima and maxima when the caller has them already.
    """
    if not columns:
        return {}
    dtypes = types_of(df)
    known = known or extent(df, columns)
    if max(n for n, _, _ in known.values()) <= small_rows:
        probs = ", ".join(number(p) for p in probabilities)
        row = df.selectExpr(
            *[f"percentile({double(quote(c), dtypes[c])}, array({probs})) AS q{k}" for k, c in enumerate(columns)]
        ).first()
        return {c: row[f"q{k}"] or [None] * len(probabilities) for k, c in enumerate(columns)}
    ranks = {key: [r for p in probabilities for r in _spot(n, p)[:2]] for key, (n, _, _) in known.items() if n}
    at: dict[tuple[int, int], float] = {}
    keys = list(ranks)
    for i in range(0, len(keys), PARTS_PER_JOB):
        group = {k: ranks[k] for k in keys[i : i + PARTS_PER_JOB]}
        at |= pick_ranks(df, columns, group, {k: known[k][1:] for k in group})
    result: dict[str, list[float | None]] = {}
    for key, name in enumerate(columns):
        n = known[key][0]
        spots = [_spot(n, p) for p in probabilities] if n else []
        result[name] = [_blend(at[key, low], at[key, high], weight) for low, high, weight in spots] or [
            None
        ] * len(probabilities)
    return result


def quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Table (column, probability, value) of exact quantiles."""
    found = exact_quantiles(df, columns, probabilities, small_rows=small_rows)
    rows = [(c, float(p), v) for c, values in found.items() for p, v in zip(probabilities, values)]
    return small_frame(df.sparkSession, rows, "column string, probability double, value double")


def approximate_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Table (column, probability, value) in one scan, with rank error at most ``1/accuracy``."""
    dtypes = types_of(df)
    probs = ", ".join(number(p) for p in probabilities)
    wide = df.selectExpr(
        *[
            f"percentile_approx({double(quote(c), dtypes[c])}, array({probs}), {accuracy}) AS q{k}"
            for k, c in enumerate(columns)
        ]
    )
    cells = [
        f"{text(c)}, {number(p)}, q{k}[{i}]" for k, c in enumerate(columns) for i, p in enumerate(probabilities)
    ]
    return wide.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (column, probability, value)")
