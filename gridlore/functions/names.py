"""Column names: normalising, de-duplicating, renaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.exprs import quote
from gridlore.session import run_sql


def normalize_name(name: object) -> str:
    """Lower-case words of ``name`` joined by ``_``; ``column`` when none is left."""
    words = re.findall(r"[a-z0-9]+", str(name).lower())
    return "_".join(words) or "column"


def normalized(c: str) -> str:
    """The data-side twin of :func:`normalize_name`, as SQL text."""
    return f"coalesce(nullif(trim(BOTH '_' FROM regexp_replace(lower({c}), '[^a-z0-9]+', '_')), ''), 'column')"


def make_unique(names: list[str]) -> list[str]:
    """Number repeated names ``x, x_2, x_3``, stepping over names already in the list."""
    reserved, taken, seen = set(names), set(), {}
    result = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        candidate = name if seen[name] == 1 else f"{name}_{seen[name]}"
        while candidate in taken or (candidate != name and candidate in reserved):
            seen[name] += 1
            candidate = f"{name}_{seen[name]}"
        taken.add(candidate)
        result.append(candidate)
    return result


def numbered_names(df: DataFrame, name: str, position: str, block: int = 1 << 18) -> DataFrame:
    """The data-side twin of :func:`make_unique` for a table of names with a numeric position.

    Occurrences are numbered inside blocks of positions and shifted by the counts of earlier
    blocks, so one very common name still spreads over many tasks. Collisions with a literal
    ``x_2`` are left to the schema-side rule.
    """
    n, p = quote(name), quote(position)
    return run_sql(
        df.sparkSession,
        f"""
        WITH blocked AS (SELECT *, {p} div {block} AS _block FROM {{t}}),
        earlier AS (
            SELECT {n}, _block, coalesce(sum(count(*)) OVER (
                PARTITION BY {n} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before
            FROM blocked GROUP BY {n}, _block),
        nth AS (
            SELECT blocked.*, _before + row_number() OVER (PARTITION BY {n}, _block ORDER BY {p}) AS _nth
            FROM blocked JOIN earlier USING ({n}, _block))
        SELECT * EXCEPT (_block, _nth), CASE WHEN _nth = 1 THEN {n} ELSE concat_ws('_', {n}, _nth) END AS unique_name
        FROM nth
        """,
        t=df,
    )


def unique_names(names: list[object]) -> list[str]:
    return make_unique([normalize_name(n) for n in names])


def apply_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Project ``df`` onto the mapped columns under their new names."""
    return df.select(*[F.col(quote(old)).alias(new) for old, new in mapping.items()])
