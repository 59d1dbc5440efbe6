"""Samples, sorts, limits and pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.functions.names import unique_names
from gridlore.operators.ordering import ROW, data_columns, positions, require_row
from gridlore.session import small_frame

SEED = 42
HASH_BITS = 60
# Sample sizes by file class, and page limits.
SAMPLE_SIZES = {
    "preview": {"small": 10_000, "medium": 3_000, "large": 1_500},
    "analytics": {"small": 20_000, "medium": 8_000, "large": 3_000},
    "chart": {"small": 5_000, "medium": 3_000, "large": 1_500},
}
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100


def sample_digits(df: DataFrame, seed: int = SEED) -> Column:
    """``HASH_BITS`` uniform bits per row, as hexadecimal digits, that do not depend on partitioning.

    It comes from the MD5 of seed and row number, which any SQL engine can repeat. Without a row
    number the columns are hashed instead, and copies of a row share a number.
    """
    if ROW in df.columns:
        digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(ROW).cast("string")))
        return F.substring(digest, 1, HASH_BITS // 4)
    mixed = F.xxhash64(F.lit(seed), *[F.col(X.quote(k)) for k in df.columns])
    return F.lpad(F.lower(F.hex(F.shiftrightunsigned(mixed, 64 - HASH_BITS))), HASH_BITS // 4, "0")


def sample_hash(df: DataFrame, seed: int = SEED) -> Column:
    """The sample digits as a number."""
    return F.conv(sample_digits(df, seed), 16, 10).cast("long")


def head(df: DataFrame, n: int) -> DataFrame:
    return require_row(df).orderBy(ROW).limit(n)


def sample_n(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows drawn uniformly (all rows if there are fewer), the same ones every time.

    The rows with the smallest hashes are the sample. A hash cut-off a little above the expected
    one is applied first, so about ``n`` rows in all reach the final sort rather than ``n`` per
    task; should the cut-off keep too few rows it is doubled until it does not.
    """
    total = df.count()
    if total <= n:
        return df
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_hash", sample_digits(df, seed))
    share = (n + 6 * math.sqrt(n) + 16) / total
    while True:
        cut = min(int(share * 2**HASH_BITS), 2**HASH_BITS - 1)  # as many digits as a hash, so texts compare as numbers
        kept = hashed.where(F.col("_hash") <= F.lit(f"{cut:0{HASH_BITS // 4}x}"))
        if share >= 1.0 or kept.count() >= n:
            break
        share *= 2
    ties = [ROW] if ROW in df.columns else []
    return kept.orderBy("_hash", *ties).limit(n).drop("_hash")


def cap_rows(df: DataFrame, n: int = 5_000, seed: int = SEED) -> DataFrame:
    """The table itself up to ``n`` rows, else a sample of ``n`` in row order."""
    drawn = sample_n(df, n, seed)
    return drawn.orderBy(ROW) if ROW in df.columns else drawn


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Sort by ``keys``, equal rows in row order."""
    return df.orderBy(*keys, *([ROW] if ROW in df.columns else []))


def top_k(df: DataFrame, k: int, by: str, ties: list[str]) -> DataFrame:
    """The ``k`` rows of largest ``by``."""
    return df.orderBy(F.col(X.quote(by)).desc(), *ties).limit(k)


def page_bounds(page: int, size: int | None) -> tuple[int, int]:
    """Page and page size brought into their allowed ranges."""
    return max(page, 1), min(max(DEFAULT_PAGE_SIZE if size is None else size, 1), MAX_PAGE_SIZE)


def page(df: DataFrame, page: int, size: int | None = None) -> DataFrame:
    """One page of rows under normalised names, found by row number instead of an offset scan.

    Row numbers with gaps, as rows dropped by cleaning leave them, are made dense first.
    """
    page, size = page_bounds(page, size)
    first = (page - 1) * size
    columns = data_columns(require_row(df))
    seen = df.agg(F.count(ROW).alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high")).first()
    dense = seen.n == 0 or (seen.low == 0 and seen.high == seen.n - 1)
    placed = df.withColumn("_place", F.col(ROW)) if dense else positions(df, "_place")
    wanted = placed.where(F.col("_place").between(first, first + size - 1)).orderBy("_place")
    return wanted.select(*[F.col(X.quote(c)).alias(n) for c, n in zip(columns, unique_names(columns))])


def page_info(df: DataFrame, page: int, size: int | None = None) -> DataFrame:
    """One row: page, page_size, total_rows, total_pages (at least 1)."""
    page, size = page_bounds(page, size)
    total = df.count()
    return small_frame(
        df.sparkSession,
        [(page, size, total, max(-(-total // size), 1))],
        "page long, page_size long, total_rows long, total_pages long",
    )
