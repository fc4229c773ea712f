"""Clusters, rankings and the allocation of a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.numbers import first_existing, number

# Weights of the clusters, spending caps by office, offices of the whole state, output columns.
CLUSTER_WEIGHTS = {"Diamante": 1.0, "Alavanca": 0.70, "Consolidação": 0.45, "Descarte": 0.10}
DEFAULT_WEIGHT = 0.1
CAPS = {
    "deputado_federal": 2_500_000,
    "deputado_estadual": 1_350_000,
    "governador": 70_680_000,
    "senador": 10_500_000,
    "vereador_grande": 340_000,
    "vereador_medio": 180_000,
    "vereador_pequeno": 60_000,
    "prefeito_grande": 4_200_000,
    "prefeito_medio": 1_600_000,
    "prefeito_pequeno": 420_000,
}
STATE_OFFICES = {"deputado_federal", "deputado_estadual", "governador", "senador"}
COLUMNS = [
    "municipio",
    "cluster",
    "ranking",
    "indice",
    "PD_qt",
    "pop",
    "budget",
    "digital",
    "offline",
    "meta_fb_ig",
    "youtube",
    "tiktok",
    "whatsapp",
    "google_ads",
    "evento_presencial",
    "radio_local",
    "impresso",
]
SMALL_TOWN, SMALL_TOWN_BONUS, META_FLOOR = 20_000, 0.05, 0.30
OFFLINE_SHARES = {"evento_presencial": (0.55, 0.40, 0.25), "radio_local": (0.30, 0.35, 0.45), "impresso": (0.15, 0.25, 0.30)}


def cluster(territorial: Column, vs: Column) -> Column:
    """Cluster by two scores against 70; null counts as 0."""
    a, b = (F.coalesce(number(c), F.lit(0.0)) > 70 for c in (territorial, vs))
    return F.when(a & b, "Diamante").when(b, "Alavanca").when(a, "Consolidação").otherwise("Descarte")


def ranking(df: DataFrame, clusters: list[str], search: str = "", name: str = "municipio", order: str = "ranking_final") -> DataFrame:
    """Rows of some clusters whose name contains a text in any case (null names don't), in order."""
    rows = df.where(F.col("cluster").isin(clusters))
    if search:
        rows = rows.where(F.coalesce(F.upper(name).contains(search.upper()), F.lit(False)))
    return rows.orderBy(F.col(order).asc_nulls_last(), name)


def allocate(df: DataFrame, budget: float, office: str, top: int, digital_share: float, tie: str = "municipio") -> DataFrame:
    """Splits a budget over the ``top`` first by ranking, then over channels.

    Rows of the cluster Descarte are left out after the cut; shares follow index times cluster weight; a cap by office
    holds outside the offices of the state and what it cuts isn't dealt again. Amounts are rounded half to even.
    """
    rows = df.orderBy(F.col("ranking_final").asc_nulls_last(), tie).limit(top).where("cluster <> 'Descarte'")
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in CLUSTER_WEIGHTS.items() for x in pair])[F.col("cluster")], F.lit(DEFAULT_WEIGHT))
    rows = rows.withColumn("__w", F.col("indice_final") * weight)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("__w").alias("__sum"))))
    amount = F.bround(F.try_divide(F.col("__w"), F.col("__sum")) * budget)
    if office not in STATE_OFFICES:
        amount = F.least(amount, F.lit(float(CAPS.get(office, budget))))

    def optional(name: str, default: float) -> Column:
        found = first_existing(df, [name])
        return F.coalesce(number(F.col(found)), F.lit(default)) if found else F.lit(default)

    rows = rows.withColumn("budget", amount).withColumn("__pd", optional("PD_qt", 50.0)).withColumn("__pop", optional("pop_censo2022", 50_000.0))
    rows = rows.withColumn("digital", F.bround(F.col("budget") * digital_share)).withColumn("offline", F.bround(F.col("budget") * (1 - digital_share)))
    online = F.least(F.col("__pd") / 100.0, F.lit(1.0))
    rest = F.lit(1.0) - online
    bonus = F.when(F.col("__pop") < SMALL_TOWN, SMALL_TOWN_BONUS).otherwise(0.0)
    parts = {
        "meta_fb_ig": F.greatest(F.lit(0.40) + rest * 0.15 - bonus, F.lit(META_FLOOR)),
        "youtube": F.lit(0.25),
        "tiktok": F.lit(0.10) + online * 0.15,
        "whatsapp": F.lit(0.10) + rest * 0.05 + bonus,
        "google_ads": F.lit(0.10),
    }
    rows = rows.withColumns({f"__{n}": c for n, c in parts.items()})
    whole = sum((F.col(f"__{n}") for n in parts), F.lit(0.0))
    channels = {n: F.bround(F.col("digital") * (F.col(f"__{n}") / whole)) for n in parts}
    for n, (high, middle, low) in OFFLINE_SHARES.items():
        channels[n] = F.bround(F.col("offline") * F.when(F.col("__pd") > 60, high).when(F.col("__pd") >= 40, middle).otherwise(low))
    heads = {"ranking": F.col("ranking_final").cast("long"), "indice": F.bround("indice_final", 1), "PD_qt": F.bround("__pd", 1), "pop": F.col("__pop").cast("long")}
    return rows.select(*[(heads | channels).get(c, F.col(c)).alias(c) for c in COLUMNS])
