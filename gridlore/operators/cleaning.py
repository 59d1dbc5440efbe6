"""Cleaning: names, empty rows and columns, trimming, type inference, duplicates, imputation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from gridlore.functions import exprs as X
from gridlore.functions.names import unique_names
from gridlore.operators.ordering import ROW, data_columns, fill_gaps, free_name, require_row
from gridlore.operators.profile import columns_of, missing_counts, value_groups
from gridlore.operators.quantiles import exact_quantiles
from gridlore.session import materialize, observed, small_frame

PARSE_SHARE = 0.85
DATE_LIKE_SHARE = 0.5
UNKNOWN = "Unknown"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its normalised, unique name."""
    columns = data_columns(df)
    keep = [F.col(ROW)] if ROW in df.columns else []
    return df.select(*[F.col(X.quote(c)).alias(n) for c, n in zip(columns, unique_names(columns))], *keep)


def _gone(name: str, dtype: T.DataType) -> str:
    c = X.quote(name)
    return f"{c} IS NULL OR isnan({c})" if isinstance(dtype, (T.FloatType, T.DoubleType)) else f"{c} IS NULL"


def empty_row(df: DataFrame) -> str:
    """Predicate text: every column is null (or NaN)."""
    dtypes = X.types_of(df)
    return " AND ".join(f"({_gone(c, dtypes[c])})" for c in data_columns(df))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(f"NOT ({empty_row(df)})")


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value."""
    return [r["column"] for r in missing_counts(df).where("present_count = 0").select("column").collect()]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[F.col(X.quote(c)) for c in empty_columns(df)])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip white space around every text value."""
    return df.withColumns(
        {f.name: F.expr(X.strip(X.quote(f.name))) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    )


@dataclass(frozen=True)
class Inference:
    """What the values of a text column parse as; ``dates`` counts by format, where any value has its shape."""

    rows: int
    values: int
    trimmed: int
    date_like: int
    numbers: int
    integers: int
    dates: dict[str, int]

    @property
    def date_format(self) -> str | None:
        """The format that parses most values; the earlier listed one on ties."""
        best = max(self.dates, key=lambda f: self.dates[f], default=None)
        return best if best and self.dates[best] else None

    def kind(self, share: float = PARSE_SHARE) -> str:
        if not self.values:
            return X.CATEGORICAL
        fmt = self.date_format
        if self.date_like >= DATE_LIKE_SHARE * self.values and fmt and self.dates[fmt] >= share * self.values:
            return X.DATETIME
        return X.NUMERIC if self.numbers >= share * self.values else X.CATEGORICAL


def inspect_text(df: DataFrame, columns: list[str]) -> dict[str, Inference]:
    """Count, over all rows, what every text column's values parse as.

    One scan for any number of columns: each row becomes one short row per column, which is counted in a
    fixed set of counters per column before anything is shuffled. A value is held against the date shapes
    only if it has a date mark, and parsed only by the formats of its shape.
    """
    if not columns:
        return {}
    shapes = " ".join(f"WHEN t RLIKE {X.text(p)} THEN {i}" for i, p in enumerate(X.DATE_SHAPES))
    formats = {f"f{i}": f for i, f in enumerate(X.DATE_FORMATS)}
    shape_of = {f: X.DATE_SHAPES.index(pattern) for f, pattern in X.DATE_FORMATS.items()}
    counts = (
        df.selectExpr(f"posexplode(array({', '.join(map(X.quote, columns))})) AS (at, c)")
        .selectExpr("at", "c", f"{X.strip('c')} AS t")
        .selectExpr("*", f"{X.date_like('t')} AS m")
        .selectExpr("*", f"CASE WHEN NOT m THEN -1 {shapes} END AS s")
        .groupBy("at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("t").alias("a"),
            F.count_if(F.expr("c <> t")).alias("b"),
            F.count_if(F.col("m")).alias("c"),
            F.expr(f"count({X.double('t')})").alias("d"),
            F.expr(f"count_if(t RLIKE {X.text(X.INTEGER_PATTERN)})").alias("e"),
            *[F.expr(f"count(CASE WHEN s = {shape_of[f]} THEN {X.timestamp('t', f)} END)").alias(k) for k, f in formats.items()],
            *[F.expr(f"count_if(s = {i})").alias(f"s{i}") for i in range(len(X.DATE_SHAPES))],
        )
    )
    found = {columns[r["at"]]: r for r in counts.collect()}  # one row per column
    none = Inference(0, 0, 0, 0, 0, 0, {})
    return {
        c: Inference(r.n, r.a, r.b, r.c, r.d, r.e, {f: r[k] for k, f in formats.items() if r[f"s{shape_of[f]}"]}) if (r := found.get(c)) else none
        for c in columns
    }


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW]


def detect_format(df: DataFrame, column: str, share: float = PARSE_SHARE) -> str | None:
    """The date format of a text column, or nothing if it is not a date column."""
    found = inspect_text(df, [column])[column]
    return found.date_format if found.kind(share) == X.DATETIME else None


def _typed(name: str, dtype: T.DataType, found: Inference | None, rows: int, share: float) -> str:
    c = X.quote(name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return X.double(c, dtype)
    if isinstance(dtype, T.TimestampType):
        return X.timestamp(c, dtype=dtype)
    if found is None:
        return c
    t, kind = X.strip(c), found.kind(share)
    if kind == X.DATETIME:
        return X.timestamp(t, found.date_format)
    if kind == X.NUMERIC:
        # whole numbers without gaps stay integers, as a reader of typed text would have them
        return f"CAST({t} AS BIGINT)" if found.integers == rows else X.double(t)
    return t if found.trimmed else c


def infer_types(df: DataFrame, threshold: float = PARSE_SHARE) -> DataFrame:
    """Trim text columns and cast them to timestamps or numbers where enough values parse."""
    found = inspect_text(df, text_columns(df))
    rows = max((i.rows for i in found.values()), default=0)
    return df.selectExpr(
        *[
            f"{_typed(f.name, f.dataType, found.get(f.name), rows, threshold)} AS {X.quote(f.name)}"
            if f.name != ROW
            else ROW
            for f in df.schema.fields
        ]
    )


BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
"""Size of the bitmap of repeated hashes: at most 4 million rows of 16 bytes are broadcast. Too many hashes for it only
mean that more rows than need be are grouped."""
LAZY_HASHES = LAZY_DATES = 1 << 16
"""Up to this number of repeated hashes and of filled dates the cleaned table is put together whenever it is read, beyond it once."""


def _hashed(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a 64-bit hash of each row, and the hash's name."""
    name = free_name("hash", df.columns)
    return df.withColumn(name, F.xxhash64(*[F.col(X.quote(c)) for c in data_columns(df)])), name


def _repeated(hashed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Hashes that several rows have, and how many there are. Hashes alone are shuffled, combined on the map side."""
    counts = hashed.groupBy(F.col(name).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    stored, facts = observed(counts, "repeated-hashes", {"n": "count(*)"})
    return stored, facts["n"]


def _split_by_hash(hashed: DataFrame, name: str, repeated: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a copy, rows that have none), by a bitmap of the repeated hashes in 64-bit words."""
    bits = 1 << min(max((BITS_PER_HASH * n).bit_length(), LEAST_BITS.bit_length() - 1), MOST_BITS.bit_length() - 1)
    word, held = free_name("word", hashed.columns), free_name("held", hashed.columns)
    place = lambda c: F.pmod(c, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(F.col("h")), F.lit(64)).cast("int"))
    words = repeated.groupBy(F.floor(place(F.col("h")) / 64).alias(word)).agg(F.bit_or(one).alias(held))
    marked = hashed.withColumn(word, F.floor(place(F.col(name)) / 64)).join(F.broadcast(words), word, "left")
    bit = F.call_function("shiftright", F.col(held), F.pmod(place(F.col(name)), F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    shared = F.coalesce(bit == 1, F.lit(False))
    columns = [c for c in hashed.columns if c != name]
    return tuple(marked.where(keep).select(*[F.col(X.quote(c)) for c in columns]) for keep in (shared, ~shared))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of equal rows in row order.

    Rows are hashed first. Only rows whose hash repeats are grouped, by all their columns, so what is
    shuffled follows the number of copies; all others stay where they are.
    """
    hashed, name = _hashed(require_row(df))
    repeated, n = _repeated(hashed, name)
    if not n:
        return df
    shared, alone = _split_by_hash(hashed, name, repeated, n)
    return alone.unionByName(_first_rows(shared))


def _first_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*[F.col(X.quote(c)) for c in data_columns(df)]).agg(F.min(ROW).alias(ROW))


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace nulls by one constant per column; a fraction in an integer column widens it."""
    dtypes = X.types_of(df)
    filled = {}
    for name, value in values.items():
        if isinstance(dtypes[name], T.NumericType):
            filled[name] = F.expr(f"coalesce({X.double(X.quote(name), dtypes[name])}, {X.number(value)})")
        else:
            filled[name] = F.coalesce(F.col(X.quote(name)), F.lit(value).cast(dtypes[name]))
    return df.withColumns(filled) if filled else df


def fill_values(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Median of numeric columns, most frequent value (smallest on ties) of text columns."""
    dtypes = X.types_of(df)
    numbers = [c for c in columns if X.kind_of(dtypes[c]) == X.NUMERIC]
    texts = [c for c in columns if X.kind_of(dtypes[c]) == X.CATEGORICAL]
    values: dict[str, object] = {
        c: m for c, (m,) in exact_quantiles(df, numbers, [0.5]).items() if m is not None
    }
    if texts:
        modes = {r["column"]: r.top_value for r in value_groups(df, texts).select("column", "top_value").collect()}
        for c in texts:
            fallback = UNKNOWN if isinstance(dtypes[c], T.StringType) else None
            value = modes.get(c) if modes.get(c) is not None else fallback
            if value is not None:
                values[c] = value
    return values


def impute(df: DataFrame, kinds: tuple[str, ...] = (X.NUMERIC, X.DATETIME, X.CATEGORICAL)) -> DataFrame:
    """Fill nulls: median, most frequent value, and for datetimes the neighbouring row's value."""
    gaps = [r["column"] for r in missing_counts(df).where("missing_count > 0").collect()]
    wanted = {c for k in kinds for c in columns_of(df, k)}
    return _impute(df, [c for c in gaps if c in wanted])[0]


def _impute(df: DataFrame, gaps: list[str]) -> tuple[DataFrame, set[str]]:
    """The filled table and the columns that were filled."""
    dtypes = X.types_of(df)
    times = [c for c in gaps if X.kind_of(dtypes[c]) == X.DATETIME]
    values = fill_values(df, [c for c in gaps if c not in times])
    filled = _fill(df, values)
    return (fill_gaps(filled, times) if times else filled), {*values, *times}


@dataclass(frozen=True)
class CleaningSummary:
    original_rows: int
    original_columns: int
    cleaned_rows: int
    cleaned_columns: int
    empty_rows_dropped: int | None
    duplicate_rows_removed: int | None
    missing_values_before: int
    missing_values_after: int
    removed_columns: list[str] = field(default_factory=list)
    mapping: list[tuple[str, str]] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        """One row of counts."""
        fields = [
            "original_rows", "original_columns", "cleaned_rows", "cleaned_columns", "empty_rows_dropped",
            "duplicate_rows_removed", "missing_values_before", "missing_values_after",
        ]
        return small_frame(spark, [tuple(getattr(self, f) for f in fields)], ", ".join(f"{f} long" for f in fields))

    def columns(self, spark) -> DataFrame:
        """One row per original column: position, names, type, whether it was removed."""
        rows = [
            (i, original, name, self.types.get(name), name in self.removed_columns)
            for i, (original, name) in enumerate(self.mapping)
        ]
        return small_frame(
            spark, rows, "position int, original_name string, column string, dtype string, removed boolean"
        )


def clean(df: DataFrame, share: float = PARSE_SHARE) -> tuple[DataFrame, CleaningSummary]:
    """Clean a table and say what was done.

    Order: names, empty rows, empty columns, trimming, inference, missing count, duplicates,
    imputation, missing count. One scan answers everything up to the first missing count. Where
    types change, the typed table is written once to the shared folder, with a hash of each row;
    copies and filled dates are small tables of their own, and what they change is counted as they are written;
    where there are many of them the table is written out with them.
    """
    source = require_row(df)
    originals = data_columns(source)
    named = normalize_columns(source)
    columns, dtypes = data_columns(named), X.types_of(named)

    found = inspect_text(named, text_columns(named))
    plain = [c for c in columns if c not in found]
    present = {c: i.values for c, i in found.items()}
    total = max((i.rows for i in found.values()), default=0)
    if plain:
        counts = missing_counts(named.select(*[F.col(X.quote(c)) for c in plain])).collect()
        present |= {r["column"]: r.present_count for r in counts}
        total = counts[0].row_count
    # a column without gaps rules out empty rows
    empty = 0 if total in present.values() else named.where(empty_row(named)).count()
    rows = total - empty
    kept = [c for c in columns if present[c]]
    removed = [c for c in columns if not present[c]]

    casts = {c: _typed(c, dtypes[c], found.get(c), rows, share) for c in kept}
    typed = named.where(f"NOT ({empty_row(named)})") if empty else named
    typed = typed.selectExpr(*[f"{casts[c]} AS {X.quote(c)}" for c in kept], ROW)
    missing = {c: rows - _typed_values(found.get(c), present[c], share) for c in kept}

    inferred = any(c in found and found[c].kind(share) != X.CATEGORICAL for c in kept)
    gaps = {c: n for c, n in missing.items() if n}
    unique, unique_rows = typed, rows
    if kept:
        hashed, name = _hashed(typed)
        if inferred:  # casts are made once, and the hash with them
            hashed = materialize(hashed, "typed")
            unique = hashed.drop(name)
        repeated, n = _repeated(hashed, name)
        if n:
            shared, alone = _split_by_hash(hashed, name, repeated, n)
            unique, dropped = _unique_rows(shared, alone, list(gaps), n)
            unique_rows = rows - dropped["n"]
            gaps = {c: left for i, (c, before) in enumerate(gaps.items()) if (left := before - dropped[f"g{i}"])}
    result, filled = _impute(unique, list(gaps))
    if sum(n for c, n in gaps.items() if X.kind_of(X.types_of(unique)[c]) == X.DATETIME) > LAZY_DATES:
        result = materialize(result, "cleaned")  # else every later scan joins or sorts rows for their dates

    return result, CleaningSummary(
        original_rows=total,
        original_columns=len(originals),
        cleaned_rows=unique_rows,
        cleaned_columns=len(kept),
        empty_rows_dropped=empty,
        duplicate_rows_removed=rows - unique_rows,
        missing_values_before=sum(missing.values()),
        missing_values_after=sum(n for c, n in gaps.items() if c not in filled),
        removed_columns=removed,
        mapping=list(zip(originals, columns)),
        types={f.name: f.dataType.simpleString() for f in result.schema.fields if f.name != ROW},
    )


def _unique_rows(shared: DataFrame, alone: DataFrame, gaps: list[str], hashes: int) -> tuple[DataFrame, dict[str, int]]:
    """The table without copies, and how many rows (n) and gaps per column (g0, g1, ...) went with them.

    Both are counted by the job that writes the first of each group of copies; no other row is written.
    """
    facts = {"n": "count(*)"} | {f"g{i}": f"count_if({X.quote(c)} IS NULL)" for i, c in enumerate(gaps)}
    before = Observation()
    noted = shared.observe(before, *[F.expr(v).alias(k) for k, v in facts.items()])
    first, after = observed(_first_rows(noted), "first-copies", facts)
    unique = alone.unionByName(first)
    if hashes > LAZY_HASHES:
        unique = materialize(unique, "unique")
    return unique, {k: before.get[k] - after[k] for k in facts}


def _typed_values(found: Inference | None, present: int, share: float) -> int:
    """How many values are left once a column has its inferred type."""
    if found is None or found.kind(share) == X.CATEGORICAL:
        return present
    return found.numbers if found.kind(share) == X.NUMERIC else found.dates[found.date_format]


def raw_summary(df: DataFrame, missing: dict[str, int], rows: int) -> CleaningSummary:
    """The summary of a table left as it is: duplicates and empty rows are not looked for."""
    originals = data_columns(df)
    names = unique_names(originals)
    dtypes = X.types_of(df)
    removed = [n for c, n in zip(originals, names) if rows and missing[c] >= rows]
    total = sum(missing[c] for c, n in zip(originals, names) if n not in removed)
    return CleaningSummary(
        original_rows=rows,
        original_columns=len(originals),
        cleaned_rows=rows,
        cleaned_columns=len(originals) - len(removed),
        empty_rows_dropped=None,
        duplicate_rows_removed=None,
        missing_values_before=total,
        missing_values_after=total,
        removed_columns=removed,
        mapping=list(zip(originals, names)),
        types={n: dtypes[c].simpleString() for c, n in zip(originals, names) if n not in removed},
    )
