"""Gold marts: composite scores of entities over the latest cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.numbers import first_existing, metric, min_max
from cartulary.operators.relational import cycle_window, keep_first, latest_years, left_enriched, trend, within_years, year_label
from cartulary.sources.lake import stored

ID = "municipio_id_ibge7"
# Names under which sources carry a metric, in order.
IBGE = {
    "pop_total": ["pop_total", "populacao", "pop_censo2022"],
    "densidade_demografica": ["densidade", "densidade_demografica"],
    "renda_media": ["renda_media", "renda", "renda_per_capita"],
    "educacao_indice": ["educacao_indice", "indice_educacao", "ideb", "escolaridade"],
    "urbanizacao_pct": ["urbanizacao", "taxa_urbanizacao", "urbanizacao_pct"],
    "idade_mediana": ["idade_mediana", "mediana_idade", "idade"],
    "acesso_internet_pct": ["acesso_internet", "internet_pct", "domicilios_internet"],
    "estrutura_urbana_indice": ["estrutura_urbana", "infraestrutura_urbana", "estrutura_urbana_indice"],
    "ruralidade_pct": ["ruralidade", "ruralidade_pct", "populacao_rural_pct"],
}
SEADE = {
    "ipvs": ["ipvs", "indice_ipvs"],
    "emprego_formal": ["emprego_formal", "emprego", "taxa_emprego"],
    **{n: IBGE[n] for n in ("urbanizacao_pct", "acesso_internet_pct", "estrutura_urbana_indice", "ruralidade_pct")},
    "saude": ["saude", "indice_saude", "cobertura_saude"],
}
TRANSFERS, GRANTS = ["transferencias", "transferencias_total"], ["emendas", "emendas_total"]
# Weights of the composite scores.
POTENTIAL = {"pop_norm": 0.30, "renda_norm": 0.20, "educacao_norm": 0.20, "internet_norm": 0.15, "urbanizacao_norm": 0.15}
POTENTIAL_SQL = {"pop_norm": 0.40, "renda_norm": 0.30, "educacao_norm": 0.30}
PRIORITY = {"ipvs_norm": 0.45, "emprego_norm": 0.30, "saude_norm": 0.25}
COST = {"estrutura_urbana_norm": -0.30, "ruralidade_norm": 0.25, "internet_norm": -0.20, "urbanizacao_norm": -0.15, "emprego_norm": -0.10}


def boosted(index: str, weights: dict[str, float]) -> Column:
    """index * (1 + weighted norms); a null index is 0."""
    return F.coalesce(F.col(index), F.lit(0.0)) * (sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0)) + 1.0)


def weighted_cost(weights: dict[str, float]) -> Column:
    """Weighted norms; a negative weight counts what is missing to 1."""
    return sum((w * F.col(n) if w > 0 else -w * (1.0 - F.col(n)) for n, w in weights.items()), F.lit(0.0))


def _metrics(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    return df.select(ID, *[metric(df, some).alias(n) for n, some in names.items()])


def normed(df: DataFrame, norms: dict[str, str]) -> DataFrame:
    """Adds norms of metrics, a missing metric being 0 for the norm only."""
    filled = df.withColumns({f"__{n}": F.coalesce(F.col(c), F.lit(0.0)) for n, c in norms.items()})
    return min_max(filled, **{n: f"__{n}" for n in norms}).drop(*[f"__{n}" for n in norms])


def electoral_base(fact: DataFrame, cycles: int) -> DataFrame:
    """Means over the latest cycles by entity, with the label of the cycles on each row.

    Every mart reads it, so it is computed once and stored: one row for each entity.
    """
    years = latest_years(fact, cycles)
    index = first_existing(fact, ["indice_final"]) or "ranking_final"
    base = within_years(fact, years).groupBy(ID).agg(F.avg("ranking_final").alias("ranking_medio_3ciclos"), F.avg(index).alias("indice_medio_3ciclos"), F.count_distinct("ano").alias("anos_observados"))
    return stored(base.withColumns({"janela_anos": F.lit(year_label(years)), "__ano": F.lit(max(years, default=None)).cast("int")}))


def potential(base: DataFrame, ibge: DataFrame, variant: str = "full") -> DataFrame:
    """Electoral potential adjusted by social metrics; ``variant='sql'`` uses three of the five norms."""
    rows = base.drop("__ano").join(_metrics(ibge, IBGE), ID, "left")
    norms = {"pop_norm": "pop_total", "renda_norm": "renda_media", "educacao_norm": "educacao_indice", "internet_norm": "acesso_internet_pct", "urbanizacao_norm": "urbanizacao_pct"}
    weights = POTENTIAL if variant == "full" else POTENTIAL_SQL
    return normed(rows, norms).withColumn("potencial_eleitoral_ajustado_social", boosted("indice_medio_3ciclos", weights))


def territorial(base: DataFrame, seade: DataFrame) -> DataFrame:
    """Territorial priority and relative cost of mobilisation."""
    rows = base.drop("__ano").join(_metrics(seade, SEADE), ID, "left")
    norms = {"ipvs_norm": "ipvs", "emprego_norm": "emprego_formal", "saude_norm": "saude", "estrutura_urbana_norm": "estrutura_urbana_indice", "ruralidade_norm": "ruralidade_pct", "internet_norm": "acesso_internet_pct", "urbanizacao_norm": "urbanizacao_pct"}
    return normed(rows, norms).withColumns({"score_priorizacao_territorial_sp": boosted("indice_medio_3ciclos", PRIORITY), "custo_mobilizacao_relativo": weighted_cost(COST)})


def sensitivity(base: DataFrame, fiscal: DataFrame, cycles: int, legacy_dedup: bool = False) -> DataFrame:
    """Index by public investment over the latest fiscal years, one row for each entity and year of the source."""
    keys = [ID] if legacy_dedup or "ano" not in fiscal.columns else [ID, "ano"]
    order = [F.col(c).asc_nulls_last() for c in fiscal.columns]
    rows = keep_first(fiscal, keys, order)
    rows = cycle_window(rows, cycles) if "ano" in fiscal.columns else rows
    rows = rows.select(ID, metric(rows, TRANSFERS).alias("t"), metric(rows, GRANTS).alias("e"))
    total = rows.groupBy(ID).agg(F.sum("t").alias("transferencias_3ciclos"), F.sum("e").alias("emendas_3ciclos"), F.sum(F.col("t") + F.col("e")).alias("investimento_publico_3ciclos"))
    names = ["transferencias_3ciclos", "emendas_3ciclos", "investimento_publico_3ciclos"]
    out = base.drop("__ano").join(total, ID, "left").fillna(0.0, names)
    return out.withColumn("sensibilidade_investimento_publico", F.coalesce("indice_medio_3ciclos", F.lit(0.0)) / (F.col(names[2]) + 1.0))


def municipal(base: DataFrame, socio: DataFrame) -> DataFrame:
    extra = socio.drop("codigo_ibge", *[c for c in base.columns if c != ID])
    key = F.when(F.col("ano").isNotNull() & (F.trim(ID) != ""), F.concat(F.col(ID), F.lit(":"), F.col("ano").cast("string"), F.lit(":00:0")))
    out = base.withColumnRenamed("__ano", "ano").join(extra, ID, "left")
    return out.withColumns({"turno": F.lit(0), "canonical_key": key, "ranking_final": F.col("ranking_medio_3ciclos")})


def turn_trend(fact: DataFrame, sections: DataFrame | None, cycles: int) -> DataFrame:
    """Mean, deviation and number of the totals by year and turn: votes of sections if there are any, else the index."""
    rows = fact if sections is None else sections
    years = latest_years(rows, cycles)
    scope, keys = within_years(rows, years), ["ano", "turno"]
    if sections is not None:
        out, names = trend(scope, ID, keys, "votos_validos"), ("votos_validos_medio_3ciclos", "votos_validos_std_3ciclos")
    else:
        out, names = trend(scope, ID, keys, first_existing(fact, ["indice_final"]) or "ranking_final", F.avg), ("indice_medio_3ciclos", "indice_std_3ciclos")
    return out.withColumnsRenamed({"media": names[0], "desvio": names[1]}).withColumn("janela_anos", F.lit(year_label(years)))


def context(socio: DataFrame, label: str) -> DataFrame:
    """The indicators of each entity, one row for each, with the label of the cycles."""
    rows = keep_first(socio, [ID], [F.col(f"`{c}`").asc_nulls_last() for c in socio.columns])
    return rows.withColumn("janela_anos", F.lit(label))


def cache(whole: DataFrame, social: DataFrame, place: DataFrame, money: DataFrame) -> DataFrame:
    """The marts that questions are served from, joined by entity; columns of the first win."""
    for mart in (social, place, money):
        whole = left_enriched(whole, mart.drop(*[c for c in mart.columns if c != ID and c in whole.columns]), ID, "")
    return whole


def gold(fact: DataFrame, socio: DataFrame, ibge: DataFrame, seade: DataFrame, fiscal: DataFrame, sections: DataFrame | None, cycles: int = 3) -> dict[str, DataFrame]:
    """All marts by name."""
    base = electoral_base(fact, cycles)
    label = base.select("janela_anos").first()
    place = territorial(base, seade)
    cost = [ID, "ranking_medio_3ciclos", "indice_medio_3ciclos", "anos_observados", "emprego_formal", "urbanizacao_pct", "acesso_internet_pct", "estrutura_urbana_indice", "ruralidade_pct", "estrutura_urbana_norm", "ruralidade_norm", "emprego_norm", "custo_mobilizacao_relativo", "janela_anos"]
    return {
        "mart_municipio_eleitoral": municipal(base, socio),
        "mart_tendencia_turno": turn_trend(fact, sections, cycles),
        "mart_contexto_socioeconomico": context(socio, label[0] if label else ""),
        "mart_potencial_eleitoral_social": potential(base, ibge),
        "mart_priorizacao_territorial_sp": place.drop("custo_mobilizacao_relativo"),
        "mart_custo_mobilizacao": place.select(*cost),
        "mart_sensibilidade_investimento_publico": sensitivity(base, fiscal, cycles),
    }
