"""Casts, predicates and formatting as Spark SQL expression text.

Every helper takes SQL text (a quoted column or any expression) and returns SQL text, for
``selectExpr``, ``F.expr`` and ``spark.sql``. All of it stays on the JVM side, inside generated
code, and one text costs one call from Python however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# Text forms accepted as numbers and as dates, and the date-like marker.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]{1,18}$"
INFINITY_PATTERN = r"^[+-]?(?i:inf|infinity)$"
DATE_MARK_PATTERN = r"[-/:T]"
DATE_FORMATS = {
    "iso": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$",
    "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "M-d-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d-MMM-yyyy": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$",
    "M/d/yyyy H:mm": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "M/d/yyyy H:mm:ss": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "d/M/yyyy H:mm": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "d/M/yyyy H:mm:ss": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "yyyy/M/d H:mm": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}$",
    "yyyy/M/d H:mm:ss": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "M/d/yy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$",
    "d/M/yy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$",
    "d-MMM-yy": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}$",
    "d-MMM-yyyy H:mm": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "d-MMM-yyyy H:mm:ss": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "M/d/yyyy h:mm a": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2} [AaPp][Mm]$",
    "M/d/yyyy h:mm:ss a": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [AaPp][Mm]$",
    "d/M/yyyy h:mm a": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2} [AaPp][Mm]$",
    "MMM d, yyyy H:mm": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "MMM d, yyyy H:mm:ss": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "d MMM yyyy H:mm": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{2}$",
}
DATE_SHAPES = list(dict.fromkeys(DATE_FORMATS.values()))  # no text has two of them

NUMERIC, DATETIME, CATEGORICAL = "numeric", "datetime", "categorical"


def kind_of(dtype: T.DataType) -> str:
    """numeric, datetime or categorical; booleans, intervals and nested types are categorical."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return CATEGORICAL


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def quote(name: str) -> str:
    """A column by its exact name, dots included."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A raw string literal's content is kept as it is, backslashes included."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A double literal that reads back to the same value."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def double(c: str, dtype: T.DataType | None = None) -> str:
    """Numeric value or null; text must look like a number, NaN counts as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"nullif(CAST({c} AS DOUBLE), CAST('NaN' AS DOUBLE))"
    if isinstance(dtype, T.NumericType):
        return f"CAST({c} AS DOUBLE)"
    t = f"trim(CAST({c} AS STRING))"
    numeric = f"{t} RLIKE {text(NUMBER_PATTERN)} OR {t} RLIKE {text(INFINITY_PATTERN)}"
    return f"CASE WHEN {numeric} THEN try_cast({t} AS DOUBLE) END"


def timestamp(c: str, fmt: str = "iso", dtype: T.DataType | None = None) -> str:
    """Timestamp without zone or null; ``fmt`` is a key of ``DATE_FORMATS``.

    Texts with an offset are moved to the session's zone, which ``configure`` sets to UTC.
    """
    if dtype is not None and kind_of(dtype) == DATETIME:
        return f"CAST({c} AS TIMESTAMP_NTZ)"
    t = f"trim(CAST({c} AS STRING))"
    parsed = (
        f"CAST(try_cast({t} AS TIMESTAMP) AS TIMESTAMP_NTZ)"
        if fmt == "iso"
        else f"CAST(try_to_timestamp({t}, {text(fmt)}) AS TIMESTAMP_NTZ)"
    )
    if "yy" in fmt and "yyyy" not in fmt:  # two digits stand for 1969 to 2068
        parsed = f"{parsed} - make_interval(CASE WHEN year({parsed}) > 2068 THEN 100 ELSE 0 END)"
    return f"CASE WHEN {t} RLIKE {text(DATE_FORMATS[fmt])} THEN {parsed} END"


def missing(c: str, dtype: T.DataType | None = None) -> str:
    """Null, or blank once cast to text."""
    if dtype is not None and kind_of(dtype) != CATEGORICAL:
        return f"{c} IS NULL"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BooleanType)):
        return f"{c} IS NULL"
    return f"({c} IS NULL OR trim(CAST({c} AS STRING)) = '')"


def date_like(c: str) -> str:
    return f"{c} RLIKE {text(DATE_MARK_PATTERN)}"


def strip(c: str) -> str:
    """Remove white space of every kind at both ends (``trim`` removes spaces only)."""
    return rf"regexp_replace({c}, '^\\s+|\\s+$', '')"


def cell_text(c: str, dtype: T.DataType | None = None) -> str:
    """A cell as text: dates in ISO form, blanks as null."""
    if dtype is not None and kind_of(dtype) == DATETIME:
        return iso(c, dtype)
    return f"nullif({strip(f'CAST({c} AS STRING)')}, '')"


def iso(c: str, dtype: T.DataType | None = None) -> str:
    if isinstance(dtype, T.DateType):
        return f"date_format({c}, 'yyyy-MM-dd')"
    whole = f"date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    micros = f"date_format({c}, 'SSSSSS')"
    return f"CASE WHEN {micros} = '000000' THEN {whole} ELSE concat({whole}, '.', {micros}) END"


def number4(c: str) -> str:
    """Four decimals, NaN as null."""
    return f"round(nullif(CAST({c} AS DOUBLE), CAST('NaN' AS DOUBLE)), 4)"


def plain_number(c: str) -> str:
    """A number as text to four decimals, never in scientific form, with one decimal at least."""
    fixed = f"CAST(try_cast({c} AS DECIMAL(38,4)) AS STRING)"
    return rf"coalesce(regexp_replace({fixed}, '([.][0-9]+?)0+$', '$1'), CAST({c} AS STRING))"


def as_text(c: str, dtype: T.DataType) -> str:
    """Any column as text, nested ones as JSON."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c})"
    return f"CAST({c} AS STRING)"


def report_form(c: str, dtype: T.DataType) -> str:
    """A value as a report shows it: NaN null, floats to 4 dp, dates ISO text, nested JSON."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return number4(c)
    if kind_of(dtype) == DATETIME:
        return iso(c, dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c})"
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """Every column of a table in report form."""
    return df.selectExpr(
        *[f"{report_form(quote(f.name), f.dataType)} AS {quote(f.name)}" for f in df.schema.fields]
    )


def equal_width_bin(value: str, low: float, width: float, bins: int) -> str:
    """Bin index in 0..bins-1; values on or past the edges fall into the end bins."""
    raw = f"floor(({value} - {number(low)}) / {number(width)})"
    return f"least({bins - 1}L, greatest(0L, {raw}))"


def ntile_of(position: str, rows: str, buckets: int) -> str:
    """Bucket 1..buckets of a 0-based position, as ``ntile`` deals ``rows`` rows out.

    The first ``rows % buckets`` buckets hold one row more than the rest.
    """
    longer, small = f"({rows} % {buckets})", f"({rows} div {buckets})"
    head = f"({longer} * ({small} + 1))"
    return (
        f"CASE WHEN {position} < {head} THEN {position} div ({small} + 1) + 1 "
        f"ELSE {longer} + ({position} - {head}) div greatest({small}, 1L) + 1 END"
    )
