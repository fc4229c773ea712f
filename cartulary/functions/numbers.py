"""Coercion, normalising to the range of a column, metrics by the first name that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """The value as a double; null for what is no number, and for NaN."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """The column that has the first of these names that exists, in any case."""
    there = {c.lower(): c for c in reversed(df.columns)}
    return next((there[n.lower()] for n in names if n.lower() in there), None)


def metric(df: DataFrame, names: list[str], fallback: float = 0.0) -> Column:
    """The first existing column as a number, ``fallback`` for null; constant if none exists."""
    found = first_existing(df, names)
    return F.coalesce(number(F.col(f"`{found}`")), F.lit(fallback)) if found else F.lit(fallback)


def min_max(df: DataFrame, **metrics: str) -> DataFrame:
    """Adds ``name=column`` scaled to 0..1 over the whole table; 0 if the column is constant. Null stays null.

    One aggregate for all of them gives a single row, whose values go into the plan as literals: one more pass, no
    window and no join.
    """
    edges = df.agg(*[f(F.col(c)).alias(f"{k}_{n}") for n, c in metrics.items() for k, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for name, column in metrics.items():
        low, high = edges[f"low_{name}"], edges[f"high_{name}"]
        value = F.lit(0.0) if low is None or low == high else (F.col(column) - F.lit(low)) / (F.lit(high) - F.lit(low))
        out.append(value.alias(name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in metrics], *out)
