"""Repair of dirty log columns, and small numeric guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
SENTINELS = ["nan", "None", "<NA>"]
LOG_COLUMNS = ["timestamp", "log_message", "command_line", "pid", "name", "priority", "identifier", "facility"]
LONG_COLUMNS = ["pid", "priority", "facility"]


def null_sentinels(c: Column, more: list[str] = ()) -> Column:
    """Text with sentinels as null; pass more=["NaT"] to treat that alike."""
    text = c.cast("string")
    return F.when(~text.isin([*SENTINELS, *more]), text)


def long_of(c: Column) -> Column:
    """Text through double to long; what is no number becomes null."""
    return c.try_cast("double").try_cast("bigint")


def repaired(df: DataFrame, columns: list[str] = LOG_COLUMNS, more: list[str] = ()) -> DataFrame:
    """The named columns as text without sentinels; absent ones as null."""
    return df.select(*[(null_sentinels(F.col(c), more) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def typed(df: DataFrame, columns: list[str] = LONG_COLUMNS) -> DataFrame:
    return df.withColumns({c: long_of(F.col(c)) for c in columns})


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def valid(df: DataFrame, at: str, floor: int | None = None) -> DataFrame:
    """Rows strictly later than ``floor`` (same unit as ``at``); all rows where no floor is given."""
    return df if floor is None else df.where(F.col(at) > floor)


def known_tokens(df: DataFrame, token: str = "token", n: int = 87) -> DataFrame:
    return df.where(F.col(token).between(0, n - 1))
