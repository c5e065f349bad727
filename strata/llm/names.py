"""Helpers for plans: internal column names that an input does not have, and broadcasts of a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, stem: str) -> str:
    """A name like stem that no column of df has, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def counted(df: DataFrame, most_rows: int) -> DataFrame:
    """df to be broadcast if it holds at most most_rows rows (counted now); otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most_rows else df
