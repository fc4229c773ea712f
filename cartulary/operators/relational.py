"""Deterministic deduplication, cycle windows, aggregates by entity and year, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order; null keys are a key."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def best_row(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of each key with the largest score, nulls last; ties by ascending columns."""
    return keep_first(df, keys, [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])


def latest_years(df: DataFrame, cycles: int, year: str = "ano") -> list[int]:
    """The latest ``cycles`` distinct years (one at least), ascending: a distinct aggregate and a top-k, run at once."""
    years = df.select(F.col(year).try_cast("int").alias("y")).where("y is not null").distinct()
    return sorted(r.y for r in years.orderBy(F.desc("y")).limit(max(1, int(cycles))).collect())


def within_years(df: DataFrame, years: list[int], year: str = "ano") -> DataFrame:
    """The rows of some years; every row if there are none. A filter on literals, so it prunes partitions by year."""
    if not years:
        return df
    value = F.col(year) if isinstance(df.schema[year].dataType, T.IntegralType) else F.col(year).try_cast("int")
    return df.where(value.isin(years))


def cycle_window(df: DataFrame, cycles: int, year: str = "ano") -> DataFrame:
    """The rows of the latest ``cycles`` distinct years (one at least); every row if no year is known."""
    return within_years(df, latest_years(df, cycles, year), year)


def year_label(years: list[int]) -> str:
    """Years as ``2022,2024,2026``."""
    return ",".join(map(str, years))


def base_metrics(df: DataFrame, entity: str, ranking: str, index: str, year: str) -> DataFrame:
    """Means of ranking and index and the number of years of each entity."""
    return df.groupBy(entity).agg(F.avg(ranking).alias("ranking_medio"), F.avg(index).alias("indice_medio"), F.count_distinct(year).alias("anos_observados"))


def trend(df: DataFrame, entity: str, inner: list[str], value: str, how=F.sum) -> DataFrame:
    """Two-level aggregate: per entity and inner keys, then mean, sample deviation and count of these."""
    per = df.groupBy(entity, *inner).agg(how(value).alias("__v"))
    return per.groupBy(entity).agg(F.avg("__v").alias("media"), F.stddev_samp("__v").alias("desvio"), F.count("__v").alias("observacoes"))


def minimized(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that exist; every column if none does."""
    kept = [c for c in allowed if c in df.columns]
    return df.select(*kept) if kept else df


def backfilled(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Adds the missing columns of a schema as typed nulls."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in schema.items() if n not in df.columns})


def union_aligned(*frames: DataFrame) -> DataFrame:
    """All rows of the frames, columns aligned by name and filled with nulls."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def left_enriched(base: DataFrame, extra: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join in which columns of ``extra`` that clash get a suffix."""
    named = extra.select(*[F.col(c).alias(c if c == key or c not in base.columns else c + suffix) for c in extra.columns])
    return base.join(named, key, "left")
