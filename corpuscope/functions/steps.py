"""Keeping long expressions from being copied."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters use by value.

    A filter on an ordinary computed column is pushed below the projection by copying the
    column's expression into it.  For a cascade of rules, each part of which looks at earlier
    ones, the copies multiply.  An output of a generator is never copied: filters on it stay
    above, while filters on other columns still reach the scan.
    """
    named = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(named)))
