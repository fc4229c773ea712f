"""Matching free-text names to a dimension in tiers: code, name, alias, similarity, else manual review.

The exact tiers are equi-joins with the dimension; only rows that they leave go on, as distinct names. The similarity
tier scores these against every alias if people are to see the best candidates of each, else only against those that share
enough pairs of neighbouring characters to be accepted or to be a runner-up within the gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import normalize_text, similarity, similarity_bound

THRESHOLD, GAP, CANDIDATES = 0.90, 0.03, 3
#: Aliases that are broadcast at most; a larger dimension is dealt to the tasks instead.
BROADCAST_ROWS = 100_000


def alias_dimension(dim: DataFrame, entity: str, name: str, aliases: str) -> DataFrame:
    """(entity, alias_nome, alias_norm): the listed aliases, the name and its normal form; blank ones left out."""
    every = F.array_union(F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.array(F.col(name), normalize_text(F.col(name))))
    rows = dim.select(F.col(entity), F.explode(F.array_distinct(every)).alias("alias_nome"))
    rows = rows.withColumn("alias_norm", normalize_text(F.col("alias_nome"))).where("alias_norm <> ''")
    return rows.groupBy(entity, "alias_norm").agg(F.min("alias_nome").alias("alias_nome")).select(entity, "alias_nome", "alias_norm")


def _lookup(rows: DataFrame, key: str, entity: str, tier: str) -> DataFrame:
    """One row for each key: its entity, or null if several entities have it."""
    found = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(entity).alias("__low"), F.max(entity).alias("__high"))
    return found.select(F.col(key).alias(f"__key_{tier}"), F.when(F.col("__low") == F.col("__high"), F.col("__low")).alias(f"__id_{tier}"), (F.col("__low") != F.col("__high")).alias(f"__many_{tier}"))


def _grams(column: str):
    """The pairs of neighbouring characters of a text, each with the number of equal ones before it."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - 1, F.lit(1))), lambda i: F.substring(F.col(column), i, F.lit(2)))
    return F.transform(each, lambda g, i: F.concat(g, F.size(F.filter(F.slice(each, F.lit(1), i), lambda x: x == g)).cast("string")))


def _sharing(names: DataFrame, others: DataFrame, entity: str, norm: str, least: float) -> DataFrame:
    """The pairs that can reach a ratio of ``least`` or more, by an equi-join on pairs of neighbouring characters.

    A ratio r of texts of T characters in all has r T / 2 equal characters in at most (1 - r) T + 1 blocks, so the texts
    share at least (1.5 r - 1) T - 1 pairs of neighbours. Texts of three characters or fewer are compared as they are.
    """
    a = names.select(norm, F.length(norm).alias("__a"), F.explode(_grams(norm)).alias("__g"))
    b = others.select(entity, "alias_norm", F.length("alias_norm").alias("__b"), F.explode(_grams("alias_norm")).alias("__g"))
    total = F.col("__a") + F.col("__b")
    near = a.join(b, "__g").groupBy(norm, entity, "alias_norm", "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    near = near.where((total > 3) & (F.col("__n") >= (1.5 * least - 1) * total - 1 - 1e-9)).select(norm, entity, "alias_norm")
    short = names.where(F.length(norm) <= 3).crossJoin(others.where(F.length("alias_norm") <= 3)).where(F.length(norm) + F.length("alias_norm") <= 3)
    return near.union(short.select(norm, entity, "alias_norm"))


def fuzzy_candidates(names: DataFrame, aliases: DataFrame, entity: str, norm: str = "norm", best_only: bool = True, least_bound: float = 0.0) -> DataFrame:
    """(norm, rank, entity, alias_norm, score) of the best ``CANDIDATES`` of each name.

    Ranked by score and then alias; ``best_only`` takes the best alias of each entity, so that two aliases of one entity
    don't compete. With a ``least_bound`` above 0.7 only pairs that can reach it are scored, found by what they share; up
    to the threshold less the gap this changes no match, only which candidates people see.
    """
    names, others = names.select(norm).distinct(), aliases.select(entity, "alias_norm").distinct()
    if least_bound > 0.7:
        pairs = _sharing(names, others, entity, norm, least_bound)
    else:
        if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            others = F.broadcast(others)
        pairs = names.crossJoin(others)
    pairs = pairs.where(similarity_bound(F.col(norm), F.col("alias_norm")) >= least_bound)
    scored = pairs.withColumn("score", similarity(F.col(norm), F.col("alias_norm")))
    order = [F.desc("score"), F.asc("alias_norm"), F.asc(entity)]
    if best_only:
        scored = scored.withColumn("__own", F.row_number().over(Window.partitionBy(norm, entity).orderBy(*order))).where("__own = 1").drop("__own")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(norm).orderBy(*order)))
    return ranked.where(F.col("rank") <= CANDIDATES).select(norm, "rank", entity, "alias_norm", "score")


def match(base: DataFrame, dim: DataFrame, aliases: DataFrame, entity: str, code: str, name_norm: str, input_norm: str, input_code: str | None = None, fuzzy: bool = True, threshold: float = THRESHOLD, gap: float = GAP, shown: bool = True) -> DataFrame:
    """``base`` with the matched entity, ``join_method``, ``join_confidence``, ``needs_review``, ``join_status`` and
    ``match_candidates`` (JSON of the candidates of the similarity tier).

    A key that several entities share doesn't match in its tier. Without ``shown`` the candidates are only those near
    enough to decide, which spares all other pairs of names and aliases; the matches are the same.
    """
    rows = base
    if input_code:
        rows = rows.join(_lookup(dim, code, entity, "code"), F.col(input_code) == F.col("__key_code"), "left")
    else:
        rows = rows.withColumns({"__id_code": F.lit(None).cast(dim.schema[entity].dataType)})
    rows = rows.join(_lookup(dim, name_norm, entity, "name"), F.col(input_norm) == F.col("__key_name"), "left")
    rows = rows.join(_lookup(aliases, "alias_norm", entity, "alias"), F.col(input_norm) == F.col("__key_alias"), "left")
    exact = F.coalesce("__id_code", "__id_name", "__id_alias")
    if fuzzy:
        left = rows.where(exact.isNull() & F.col(input_norm).isNotNull()).select(F.col(input_norm).alias("norm"))
        top = fuzzy_candidates(left, aliases, entity, least_bound=0.0 if shown else threshold - gap)
        best = top.groupBy("norm").agg(
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("__best"),
            F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("__second"),
            F.max(F.when(F.col("rank") == 1, F.col(entity))).alias("__entity"),
            F.to_json(F.sort_array(F.collect_list(F.struct("rank", entity, "alias_norm", "score")))).alias("__candidates"),
        )
        rows = rows.join(best.withColumnRenamed("norm", "__norm"), F.col(input_norm) == F.col("__norm"), "left")
        sure = (F.col("__best") >= threshold) & (F.col("__best") - F.coalesce("__second", F.lit(0.0)) >= gap)
        similar = F.when(exact.isNull() & sure, F.col("__entity"))
    else:
        rows = rows.withColumns({"__best": F.lit(None).cast("double"), "__candidates": F.lit(None).cast("string")})
        similar = F.lit(None).cast(dim.schema[entity].dataType)
    method = F.when(F.col("__id_code").isNotNull(), "exact_code").when(F.col("__id_name").isNotNull(), "exact_name").when(F.col("__id_alias").isNotNull(), "historical_alias").when(similar.isNotNull(), "fuzzy_score").otherwise("manual_review")
    confidence = F.when(method.isin("exact_code", "exact_name"), 1.0).when(method == "historical_alias", 0.99).when(method == "fuzzy_score", F.col("__best")).otherwise(0.0)
    return rows.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce(exact, similar).alias(entity),
        method.alias("join_method"),
        confidence.alias("join_confidence"),
        (method == "manual_review").alias("needs_review"),
        F.when(method == "manual_review", "manual_review").otherwise("matched").alias("join_status"),
        F.when(exact.isNull(), F.col("__candidates")).alias("match_candidates"),
        F.when(exact.isNull(), F.col("__best")).alias("best_score"),
    )


def review_queue(matched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows left for people, with the reason."""
    low = F.coalesce("best_score", F.lit(0.0)) < threshold
    return matched.where("needs_review").withColumn("reason", F.when(low, "low_score").otherwise("ambiguous_fuzzy"))


def territory_dimension(levels: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Union of levels as ``level:part:part:part`` ids (missing parts 0), one row for each id."""
    frames = []
    for level, frame, parts in levels:
        ids = [F.coalesce(F.col(p).cast("string"), F.lit("0")) for p in parts]
        key = F.concat_ws(":", F.lit(level), *ids, *[F.lit("0")] * (3 - len(ids)))
        frames.append(frame.select(key.alias("territorio_id"), F.lit(level).alias("nivel"), *[F.col(p).cast("string").alias(f"parte_{k}") for k, p in enumerate(parts, 1)]))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.distinct()
