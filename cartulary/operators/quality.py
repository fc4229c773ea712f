"""Rates, drift, profiles, contracts, privacy, priorities of sources, event metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRIFT_ALERT = 0.2
# Columns with personal data; columns that serving may show.
PERSONAL = {"cpf", "email", "telefone", "celular", "titulo_eleitor", "nome_pessoa", "documento"}
SERVED = [
    "municipio_id_ibge7",
    "canonical_key",
    "ranking_medio_3ciclos",
    "indice_medio_3ciclos",
    "potencial_eleitoral_ajustado_social",
    "score_priorizacao_territorial_sp",
    "sensibilidade_investimento_publico",
    "janela_anos",
    "ano",
    "turno",
    "ranking_final",
]


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds; 0 for no rows."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def quality_rates(df: DataFrame, critical: list[str], status: str = "join_status") -> DataFrame:
    """Rows, join success and the share of rows with a null in a critical column."""
    some = [F.col(c).isNull() for c in critical if c in df.columns]
    broken = reduce(lambda a, b: a | b, some) if some else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("n"), rate(F.col(status) == "matched").alias("join_success"), rate(broken).alias("null_critical"))


def drift(current: DataFrame, previous: DataFrame, features: list[str]) -> DataFrame:
    """Mean relative change of the features' means, and whether it calls for an alert: two aggregates, one row."""
    features = [f for f in features if f in current.columns and f in previous.columns]
    a = current.agg(*[F.avg(F.col(f).try_cast("double")).alias(f"c_{f}") for f in features], F.count(F.lit(1)).alias("n"))
    b = previous.agg(*[F.avg(F.col(f).try_cast("double")).alias(f"p_{f}") for f in features], F.count(F.lit(1)).alias("m"))
    parts = F.array(F.lit(None).cast("double"), *[F.abs(F.col(f"c_{f}") - F.col(f"p_{f}")) / F.when(F.abs(f"p_{f}") > 1e-9, F.abs(f"p_{f}")).otherwise(1.0) for f in features])
    known = F.filter(parts, lambda x: x.isNotNull())
    score = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)
    return a.crossJoin(b).select(score.alias("drift_score"), (score >= DRIFT_ALERT).alias("drift_alert"))


def null_profile(df: DataFrame) -> DataFrame:
    """Column, nulls and share of nulls: one aggregate, unpivoted."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]))
    return counts.select(rows.alias("x"), "__n").select("x.column", "x.nulls", F.coalesce(F.try_divide("x.nulls", "__n"), F.lit(0.0)).alias("null_share"))


def coverage(df: DataFrame, state: str | None, entity: str, year: str) -> DataFrame:
    """Distinct states, entities (blank ones don't count) and the sorted years with their range."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    states = F.array_join(F.sort_array(F.collect_set(F.upper(blank(state)))), ",") if state else F.lit("")
    years = F.sort_array(F.collect_set(F.col(year).try_cast("int")))
    return df.agg(states.alias("ufs"), F.count_distinct(blank(entity)).alias("entidades"), F.array_join(years, ",").alias("anos"), F.min(F.col(year).try_cast("int")).alias("inicio"), F.max(F.col(year).try_cast("int")).alias("fim"))


def schema_profile(df: DataFrame) -> DataFrame:
    """(column, position, type) of a table, as Spark names the types."""
    rows = [(f.name, k, f.dataType.simpleString()) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, type string")


# Columns that name an entity and a period, in order.
ENTITIES = ["municipio_id_ibge7", "codigo_ibge", "municipio", "nome_municipio"]
PERIODS = ["ano", "mes", "turno", "data_referencia", "competencia"]


def load_profile(df: DataFrame) -> DataFrame:
    """One row on a load: rows, columns, share of nulls, grain, states and number of entities, years with their range.

    One aggregate. The sets are of states and years, which are few; entities are only counted. Blank texts don't count.
    """
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    entity = next((c for c in ENTITIES if c in df.columns), None)
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    texts = lambda c: F.sort_array(F.collect_set(blank(c))) if c in df.columns else F.array().cast("array<string>")
    years = F.transform(F.filter(texts("ano"), lambda y: y.rlike("^[0-9]+$")), lambda y: y.cast("int"))
    states = F.sort_array(F.collect_set(F.upper(blank("uf")))) if "uf" in df.columns else F.array().cast("array<string>")
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.round(F.try_divide(nulls * 100.0, F.count(F.lit(1)) * len(df.columns)), 3), F.lit(0.0)).alias("null_pct"),
        states.alias("ufs"),
        (F.count_distinct(blank(entity)) if entity else F.lit(None).cast("long")).alias("municipios_cobertos"),
        F.array_min(years).alias("inicio"),
        F.array_max(years).alias("fim"),
        *[texts(c).alias(c) for c in PERIODS if c in df.columns],
    )
    grain = F.lit("municipio") if entity else F.when(F.size("ufs") > 0, "uf").otherwise("indefinida")
    return out.withColumns({"granularidade": grain, "status": F.when(F.col("rows") > 0, "ok").otherwise("warning")})


def load_manifest(df: DataFrame, source: str, path: str, digest: str, collected: str, parser: str, critical: list[str] = ()) -> dict:
    """What is known of a load: where it is from, its hash, schema, coverage, period and quality."""
    row = load_profile(df).first().asDict()
    period = {c: row[c] for c in PERIODS if row.get(c)}
    span = {k: row[k] for k in ("inicio", "fim") if row[k] is not None}
    broken = quality_rates(df.withColumn("__status", F.lit("matched")), list(critical), "__status").first()
    cover = {"granularidade": row["granularidade"], "rows": row["rows"]}
    cover |= ({"ufs": row["ufs"]} if "uf" in df.columns else {}) | ({"municipios_cobertos": row["municipios_cobertos"]} if row["municipios_cobertos"] is not None else {})
    return {
        "fonte": source,
        "data_coleta_utc": collected,
        "hash_arquivo": digest,
        "schema_detectado": {r.column: r.type for r in schema_profile(df).orderBy("position").collect()},
        "cobertura_territorial": cover,
        "periodo_referencia": {"colunas": list(period)} | period | span,
        "qualidade_carga": {"status": row["status"], "rows": row["rows"], "columns": row["columns"], "null_pct": row["null_pct"], "null_critical": broken.null_critical},
        "versao_parser": parser,
        "arquivo": path,
    }


def delay_days(moment: Column, now: Column) -> Column:
    """Days from a moment to now, not below 0; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400.0), F.lit(0.0))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, violations): a row breaks a rule unless its condition holds; one aggregate for all rules."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(rows.alias("x"), F.col("__n").alias("rows")).select("x.rule", "rows", "x.violations")


def required(column: str) -> Column:
    return F.trim(F.col(column).cast("string")) != ""


def optional_at_least(column: str, low: float) -> Column:
    value = F.col(column).try_cast("double")
    return F.col(column).isNull() | (value >= low)


# Rules of the sources.
SOURCE_RULES = {
    "base_eleitoral": {"required": ["municipio", "ranking_final"], "at_least": {"ranking_final": 0}},
    "mapping_tse_ibge": {"required": ["codigo_tse", "codigo_ibge", "nome_municipio"], "at_least": {}},
    "resultado_secao": {"required": ["municipio"], "at_least": {"votos_validos": 0}},
    "contexto_socio": {"required": ["codigo_ibge"], "at_least": {"pop_total": 0, "renda_media": 0, "educacao_indice": 0}},
    "ibge_indicadores": {"required": ["codigo_ibge"], "at_least": {"pop_total": 0, "renda_media": 0, "educacao_indice": 0}},
    "seade_indicadores": {"required": ["codigo_ibge"], "at_least": {}},
    "transparencia_fiscal": {"required": ["codigo_ibge"], "at_least": {"transferencias": 0, "emendas": 0}},
}


class ContractError(ValueError):
    """A source breaks its contract."""


def source_contract(name: str, df: DataFrame) -> dict[str, int]:
    """Number of rows that break each rule of a source; raises if a column is missing or a rule is broken."""
    rules = SOURCE_RULES[name]
    if missing := [c for c in rules["required"] if c not in df.columns]:
        raise ContractError(f"{name}: missing columns {missing}")
    checks = {f"{c} is given": required(c) for c in rules["required"]}
    checks |= {f"{c} >= {low}": optional_at_least(c, low) for c, low in rules["at_least"].items() if c in df.columns}
    found = {r.rule: r.violations for r in violations(df, checks).collect()}
    if any(found.values()):
        raise ContractError(f"{name}: " + ", ".join(f"{n} rows break '{rule}'" for rule, n in found.items() if n))
    return found


# Columns that tables of the layers need, the one that is never blank, and the states of a match.
LAYER_COLUMNS = {
    "dim_municipio": ["municipio_id_ibge7", "codigo_tse", "codigo_ibge", "nome_municipio", "municipio_norm"],
    "fato_eleitoral_municipio": ["municipio_id_ibge7", "ano", "mes", "turno", "canonical_key", "ranking_final", "join_status", "join_method", "join_confidence", "needs_review"],
    "dim_territorio": ["territorio_id", "cod_tse_municipio", "cod_ibge_municipio", "uf", "nome_padronizado", "zona_eleitoral", "secao_eleitoral", "latitude", "longitude", "geohash", "vigencia_inicio", "vigencia_fim"],
    "dim_tempo": ["tempo_id", "data", "ano", "mes", "dia", "semana_iso", "dia_semana", "ciclo_eleitoral", "fase_calendario", "is_evento", "evento", "tipo_evento", "pulso_midia", "is_pulso_midia"],
    "mart_municipio_eleitoral": ["canonical_key", "municipio_id_ibge7", "ano", "turno", "ranking_final"],
    "municipio_enriched": ["municipio", "ranking_final", "municipio_id_ibge7", "ano", "turno", "canonical_key", "join_status", "join_method", "join_confidence", "needs_review"],
}
NEVER_BLANK = {"dim_municipio": ["municipio_id_ibge7", "codigo_ibge"], "dim_territorio": ["territorio_id"], "dim_tempo": ["tempo_id"]}
NEVER_EMPTY = ["dim_municipio", "fato_eleitoral_municipio", "dim_territorio", "dim_tempo"]
JOIN_STATES = ["matched", "no_match", "manual_review"]


def layer_contract(name: str, df: DataFrame) -> None:
    """Raises if a table of a layer lacks a column or rows, has a blank key, or a match in an unknown state."""
    if missing := [c for c in LAYER_COLUMNS[name] if c not in df.columns]:
        raise ContractError(f"{name}: missing columns {missing}")
    rules = {f"{c} is given": required(c) for c in NEVER_BLANK.get(name, [])}
    if "join_status" in df.columns:
        rules["known state"] = F.col("join_status").isNull() | F.col("join_status").isin(JOIN_STATES)
    found = violations(df, rules or {"row": F.lit(True)}).collect()
    if name in NEVER_EMPTY and not found[0].rows:
        raise ContractError(f"{name} is empty")
    if broken := {r.rule: r.violations for r in found if r.violations}:
        raise ContractError(f"{name}: rows break {broken}")


def masked(column: Column, salt: str) -> Column:
    """First 16 digits of the sha256 of ``salt:value``; null stays null."""
    return F.substr(F.sha2(F.concat(F.lit(f"{salt}:"), column.cast("string")), 256), F.lit(1), F.lit(16))


def for_purpose(df: DataFrame, purpose: str, salt: str) -> tuple[DataFrame, dict]:
    """Only the columns that serving may show, if the purpose is serving; personal columns masked in any case."""
    served = purpose in ("serving", "serving_cache")
    rows = df.select(*[c for c in SERVED if c in df.columns]) if served and any(c in df.columns for c in SERVED) else df
    personal = [c for c in rows.columns if c.lower() in PERSONAL]
    return rows.withColumns({c: masked(F.col(c), salt) for c in personal}), {"minimized": served, "anonymized_columns": personal}


# Reasons to reject a source, in order: (class or '', condition, text).
def _source_rules() -> list[tuple[Column, str]]:
    coverage_, days, quality, first = F.col("cobertura_municipal"), F.col("atualizacao_dias"), F.col("schema_quality"), F.col("prioridade") == "A"
    return [
        (coverage_ < 0.8, "cobertura municipal abaixo de 80%"),
        (days > 120, "atualizacao muito esparsa (>120 dias)"),
        (~F.col("licenca_aberta"), "licenca nao aberta"),
        (quality < 0.7, "qualidade de schema abaixo do minimo (0.7)"),
        (first & (coverage_ < 0.95), "fonte A requer cobertura >= 95%"),
        (first & (days > 45), "fonte A requer atualizacao <= 45 dias"),
        (first & (quality < 0.85), "fonte A requer schema_quality >= 0.85"),
    ]


def prioritized(sources: DataFrame) -> DataFrame:
    """Sources with score, reasons against them, and their group: accepted_a, accepted_b or rejected."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in _source_rules()]), lambda x: x.isNotNull())
    fresh = F.least(F.lit(1.0), F.lit(45.0) / F.greatest(F.lit(1.0), F.col("atualizacao_dias").cast("double")))
    score = F.col("cobertura_municipal") * 0.45 + fresh * 0.20 + F.col("licenca_aberta").cast("double") * 0.20 + F.col("schema_quality") * 0.15
    rows = sources.withColumn("score", F.bround(score, 4)).withColumn("reasons", reasons)
    group = F.when(F.size("reasons") > 0, "rejected").when(F.col("prioridade") == "A", "accepted_a").when(F.col("prioridade") == "B", "accepted_b").otherwise("unlisted")
    return rows.withColumn("group", group)


def prioritized_report(sources: DataFrame) -> DataFrame:
    """Prioritized sources by group, the best of each group first."""
    return prioritized(sources).orderBy("group", F.desc("score"), *[F.asc(c) for c in sources.columns[:1]])


def nearest_ranks(df: DataFrame, columns: list[str], share: float) -> dict[str, float]:
    """For each column the value at the rounded rank of its sorted values, not interpolated; 0 for none. Exact.

    A first pass counts and brackets the rank by approximate quantiles. A second one counts the values below the bracket
    and each value inside, a thousandth of the rows or so; a running count over these finds the value. Nulls count as 0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in columns]))
    rows = df.select(each.alias("x")).select("x.*")
    n = df.count()
    apart = 5e-4 + 2 / max(1, n)  # the bracket's quantiles are exact to a ten-thousandth of the rows
    around = F.percentile_approx("value", [max(0.0, share - apart), min(1.0, share + apart)], 10_000)
    edges = rows.groupBy("name").agg(around.alias("around"))
    edges = edges.select("name", F.bround(F.lit(share * (n - 1))).cast("long").alias("place"), F.col("around")[0].alias("low"), F.col("around")[1].alias("high"))
    inside = rows.join(F.broadcast(edges), "name").where("value <= high")  # one row a column
    counts = inside.groupBy("name", "place", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).count()
    upto = F.sum("count").over(Window.partitionBy("name").orderBy(F.col("value").asc_nulls_first()))
    found = counts.withColumn("upto", upto).where("value is not null and upto > place").groupBy("name").agg(F.min("value").alias("value"))
    return dict.fromkeys(columns, 0.0) | {r.name: r.value for r in found.collect()}


def event_snapshot(events: DataFrame, share: float = 0.95) -> DataFrame:
    """Metrics of retrieval events: mean recall and cost, p95 latencies, shares of fallbacks."""
    stages = ["total", "vector", "llm"]
    ranks = nearest_ranks(events, [f"latency_{n}_ms" for n in stages], share)
    p95 = {f"latency_{n}_p95_ms": F.lit(float(ranks[f"latency_{n}_ms"])) for n in stages}
    shares = {f"fallback_rate_{n}": rate(F.col(f"fallback_{n}")) for n in ("any", "vector", "llm")}
    rest = {"queries_total": F.count(F.lit(1)), "recall_at_k_avg": F.avg("recall_at_k"), "cost_per_query_avg_usd": F.coalesce(F.avg(F.coalesce("cost_estimated_usd", F.lit(0.0))), F.lit(0.0))}
    return events.agg(*[c.alias(n) for n, c in (rest | shares).items()]).withColumns(p95)


def recall_at_k(question: Column, retrieved: Column) -> Column:
    """1 if a retrieved name is in the question, null if none is: the truth is drawn from the retrieved."""
    truth = F.filter(retrieved, lambda m: F.contains(F.lower(question), F.lower(m)))
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(truth, retrieved)) / F.size(F.array_distinct(truth)))
