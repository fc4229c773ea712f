"""Bronze, silver and gold: raw files to reconciled dimensions and facts to marts, one run after another."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import geo, text
from cartulary.functions.calendar import calendar
from cartulary.functions.numbers import first_existing, number
from cartulary.operators import marts, quality, relational, territory
from cartulary.sources import lake

ID = marts.ID
ROLES = ("base_eleitoral", "mapping_tse_ibge", "contexto_socio", "ibge_indicadores", "seade_indicadores", "transparencia_fiscal", "resultado_secao")


@dataclass
class Inputs:
    """Paths of the sources by role; the first three are needed. Marts become tables of ``database`` if one is named."""

    paths: dict[str, str]
    window_cycles: int = 3
    year: int | None = None
    state: str = "SP"
    salt: str = ""
    missing: list[str] = field(default_factory=list)
    database: str | None = None


def _column(df: DataFrame, *names: str) -> str:
    if (found := first_existing(df, list(names))) is None:
        raise quality.ContractError(f"none of the columns {names} in {df.columns}")
    return found


def _int(df: DataFrame, name: str, default: int | None):
    found = first_existing(df, [name])
    return (F.col(found).try_cast("int") if found else F.lit(default).cast("int")).alias(name)


def municipality_dimension(mapping: DataFrame) -> DataFrame:
    """One row for each code: names and their normal forms, aliases as an array, state and coordinates if known."""
    code, ibge, name = _column(mapping, "codigo_tse", "cod_tse", "cd_mun_tse"), _column(mapping, "codigo_ibge", "cod_ibge"), _column(mapping, "nome_municipio", "municipio")
    optional = {c: first_existing(mapping, [c]) for c in ("aliases", "uf", "latitude", "longitude")}
    pick = lambda c: F.col(optional[c]) if optional[c] else F.lit(None).cast("string")
    rows = mapping.select(
        text.normalize_code(F.col(ibge)).alias(ID),
        F.regexp_replace(F.trim(F.col(code).cast("string")), r"\.0$", "").alias("codigo_tse"),
        text.normalize_code(F.col(ibge)).alias("codigo_ibge"),
        F.trim(name).alias("nome_municipio"),
        text.normalize_text(F.col(name)).alias("municipio_norm"),
        text.split_list(pick("aliases")).alias("aliases"),
        F.upper(F.trim(pick("uf"))).alias("uf"),
        number(pick("latitude")).alias("latitude"),
        number(pick("longitude")).alias("longitude"),
    ).where(f"{ID} <> ''")
    return relational.keep_first(rows, [ID], [F.col("codigo_tse").asc_nulls_last(), F.col("nome_municipio").asc_nulls_last()])


def municipality_fact(base: DataFrame, dim: DataFrame, aliases: DataFrame, inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """(fact with the best row of each key, review queue)."""
    name, code = _column(base, "municipio", "nome_municipio"), first_existing(base, ["codigo_tse", "cod_tse", "cd_mun_tse"])
    index = first_existing(base, ["indice_final"])
    rows = base.select(
        F.col(name).alias("municipio_input"),
        text.normalize_text(F.col(name)).alias("municipio_norm_input"),
        (F.regexp_replace(F.trim(F.col(code).cast("string")), r"\.0$", "") if code else F.lit(None).cast("string")).alias("codigo_input"),
        number(F.col(_column(base, "ranking_final"))).alias("ranking_final"),
        (number(F.col(index)) if index else number(F.col("ranking_final"))).alias("indice_final"),
        _int(base, "ano", inputs.year),
        _int(base, "mes", None),
        _int(base, "turno", None),
    )
    matched = territory.match(rows, dim, aliases, ID, "codigo_tse", "municipio_norm", "municipio_norm_input", "codigo_input")
    matched = matched.withColumn("canonical_key", text.canonical_key(F.col(ID), F.col("ano"), F.col("mes"), F.col("turno")))
    fact = relational.best_row(matched.where(f"{ID} is not null"), ["canonical_key"], "indice_final", ["ranking_final", "municipio_input"])
    fact = fact.join(dim.select(ID, "codigo_tse", "codigo_ibge", "nome_municipio", "municipio_norm"), ID, "left")
    return fact, territory.review_queue(matched)


def section_fact(sections: DataFrame, aliases: DataFrame, inputs: Inputs) -> DataFrame:
    """Votes of sections by entity; unknown zones and sections are -1, votes 0; one row for each key."""
    name, votes = _column(sections, "municipio", "nome_municipio", "nm_municipio"), first_existing(sections, ["votos_validos", "votos"])
    zone, section = first_existing(sections, ["zona", "nr_zona"]), first_existing(sections, ["secao", "nr_secao"])
    code = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(-1)) if c else F.lit(-1)
    rows = sections.select(text.normalize_text(F.col(name)).alias("alias_norm"), code(zone).alias("zona"), code(section).alias("secao"), (F.coalesce(number(F.col(votes)), F.lit(0.0)) if votes else F.lit(0.0)).alias("votos_validos"), _int(sections, "ano", inputs.year), _int(sections, "turno", 1))
    rows = rows.join(aliases.select(ID, "alias_norm"), "alias_norm", "left")
    return relational.keep_first(rows, [ID, "ano", "turno", "zona", "secao"], [F.col("votos_validos").desc(), F.col("alias_norm")])


def context_dimension(df: DataFrame, by_year: bool = False) -> DataFrame:
    """Indicators keyed by entity: one row for each, or for each year."""
    code = _column(df, "codigo_ibge", "cod_ibge", ID)
    rows = df.withColumn(ID, text.normalize_code(F.col(code))).where(f"{ID} <> ''")
    keys = [ID, "ano"] if by_year and "ano" in df.columns else [ID]
    return relational.keep_first(rows, keys, [F.col(f"`{c}`").asc_nulls_last() for c in rows.columns])


def territory_rows(dim: DataFrame, sections: DataFrame | None, years: tuple[int, int]) -> DataFrame:
    """Municipalities, zones and sections with ids, geohash and validity."""
    place = dim.select(ID, F.col("codigo_tse").alias("cod_tse_municipio"), F.col("codigo_ibge").alias("cod_ibge_municipio"), "uf", F.col("nome_municipio").alias("nome_padronizado"), "latitude", "longitude", geo.geohash(F.col("latitude"), F.col("longitude")).alias("geohash"))
    levels = [("mun", dim, [ID])]
    if sections is not None:
        known = sections.where(f"{ID} is not null and zona >= 0")
        levels += [("zona", known, [ID, "zona"]), ("secao", known.where("secao >= 0"), [ID, "zona", "secao"])]
    rows = relational.backfilled(territory.territory_dimension(levels), {"parte_2": "string", "parte_3": "string"})
    rows = rows.join(place, F.col("parte_1") == F.col(ID), "left").drop(ID, "parte_1")
    rows = rows.withColumnsRenamed({"parte_2": "zona_eleitoral", "parte_3": "secao_eleitoral"})
    return rows.withColumns({"vigencia_inicio": F.lit(f"{years[0]}-01-01"), "vigencia_fim": F.lit(f"{years[1]}-12-31")})


def serve(spark: SparkSession, served: dict[str, DataFrame], database: str) -> list[dict]:
    """Each mart as a table of a database, bucketed and sorted by entity, with statistics; names and rows."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, frame in served.items():
        lake.serve(frame, f"{database}.{name}", ID)
    return [{"table": f"{database}.{name}", "rows": spark.table(f"{database}.{name}").count()} for name in served]


def run(spark: SparkSession, inputs: Inputs, root: str, version: str) -> dict:
    """One run: loads changed sources to bronze, checks contracts, writes silver and gold, registers versions.

    Returns the manifest, which is also written beside the gold layer.
    """
    run_id = datetime.now(UTC).strftime("%Y%m%d_%H%M%S_%f")
    given = {role: path for role, path in inputs.paths.items() if role in ROLES}
    if lost := [r for r in ROLES[:3] if r not in given]:
        raise quality.ContractError(f"sources are missing: {lost}")
    frames = {role: lake.read_any(spark, path) for role, path in given.items()}
    contracts = {role: quality.source_contract(role, frame) for role, frame in frames.items()}

    state_path = f"{root}/bronze/_incremental_state.json"
    state = lake.read_json(spark, state_path)
    bronze = {}
    for role, path in given.items():
        digest = lake.content_hash(spark, path, role).first()["hash"]
        status = "skipped_unchanged" if state.get(role) == digest else "loaded_changed"
        bronze[role] = {"hash_sha256": digest, "status": status}
        if status == "loaded_changed":
            name = path.rstrip("/").rsplit("/", 1)[-1]
            bronze[role] |= lake.copy_raw(spark, path, f"{root}/bronze/raw/{run_id}/{role}/{name}")
            lake.append_partitioned(frames[role], f"{root}/bronze/data", role, run_id, inputs.year, inputs.state)
            state[role] = digest
        said = quality.load_manifest(frames[role], role, path, digest, datetime.now(UTC).isoformat(), version, quality.SOURCE_RULES[role]["required"])
        lake.write_json(spark, f"{root}/bronze/manifests/{run_id}/{role}.json", said)
        bronze[role] |= {"rows": said["qualidade_carga"]["rows"], "manifest": f"{root}/bronze/manifests/{run_id}/{role}.json"}
    lake.write_json(spark, state_path, state)

    dim = municipality_dimension(frames["mapping_tse_ibge"])
    aliases = territory.alias_dimension(dim, ID, "nome_municipio", "aliases")
    fact, review = municipality_fact(frames["base_eleitoral"], dim, aliases, inputs)
    sections = section_fact(frames["resultado_secao"], aliases, inputs) if "resultado_secao" in frames else None
    socio = context_dimension(frames["contexto_socio"])
    ibge, seade = (context_dimension(frames[r]) if r in frames else socio.select(ID) for r in ("ibge_indicadores", "seade_indicadores"))
    fiscal = context_dimension(frames["transparencia_fiscal"], True) if "transparencia_fiscal" in frames else socio.select(ID)

    silver = {"dim_municipio": dim, "dim_municipio_alias": aliases, "fato_eleitoral_municipio": fact, "manual_review_queue": review, "dim_contexto_socioeconomico": socio, "dim_ibge_indicadores": ibge, "dim_seade_indicadores": seade, "fato_fiscal_municipio": fiscal}
    if sections is not None:
        silver["fato_eleitoral_secao"] = sections
    stored = {}
    for name, frame in silver.items():
        lake.publish(frame, f"{root}/silver/{run_id}/{name}")
        stored[name] = spark.read.parquet(f"{root}/silver/{run_id}/{name}")
        if name in quality.LAYER_COLUMNS:
            quality.layer_contract(name, stored[name])
    years = [stored[n].agg(F.min("ano"), F.max("ano")).first() for n in ("fato_eleitoral_municipio", "fato_eleitoral_secao", "fato_fiscal_municipio") if n in stored and "ano" in stored[n].columns]
    known = [int(y) for pair in years for y in pair if y is not None] + ([inputs.year] if inputs.year else [])
    span = (min(known), max(known)) if known else (datetime.now(UTC).year,) * 2
    for name, frame in (("dim_tempo", calendar(spark, *span)), ("dim_territorio", territory_rows(stored["dim_municipio"], stored.get("fato_eleitoral_secao"), span))):
        lake.publish(frame, f"{root}/silver/{run_id}/{name}")
        quality.layer_contract(name, spark.read.parquet(f"{root}/silver/{run_id}/{name}"))

    gold = marts.gold(stored["fato_eleitoral_municipio"], stored["dim_contexto_socioeconomico"], stored["dim_ibge_indicadores"], stored["dim_seade_indicadores"], stored["fato_fiscal_municipio"], stored.get("fato_eleitoral_secao"), inputs.window_cycles)
    published, served, catalog = {}, {}, f"{root}/catalog/versions"
    for name, frame in gold.items():
        clean, _ = quality.for_purpose(frame, "analysis", inputs.salt)
        path = f"{root}/gold/{run_id}/{name}"
        lake.publish(clean, path, ID)
        rows = served[name] = spark.read.parquet(path)
        if name in quality.LAYER_COLUMNS:
            quality.layer_contract(name, rows)
        before = lake.previous_version(spark, catalog, name, run_id)
        change = quality.drift(rows, spark.read.parquet(before), ["indice_medio_3ciclos", "ranking_medio_3ciclos"]).first().asDict() if before else {"drift_score": 0.0, "drift_alert": False}
        published[name] = {"path": path, "rows": rows.count(), **change}
        lake.register_version(spark, catalog, {"dataset_name": name, "dataset_version": run_id, "timestamp_utc": datetime.now(UTC).isoformat(), "pipeline_version": version, "path": path, "columns": rows.columns})
    cached = marts.cache(*[served[n] for n in ("mart_municipio_eleitoral", "mart_potencial_eleitoral_social", "mart_priorizacao_territorial_sp", "mart_sensibilidade_investimento_publico")])
    cached, _ = quality.for_purpose(cached, "serving_cache", inputs.salt)
    lake.publish(cached, f"{root}/gold/{run_id}/query_cache", ID)
    served["query_cache"] = spark.read.parquet(f"{root}/gold/{run_id}/query_cache")
    tables = serve(spark, served, inputs.database) if inputs.database else []
    rates = stored["fato_eleitoral_municipio"].select("join_status").unionAll(stored["manual_review_queue"].select("join_status"))
    manifest = {"run_id": run_id, "pipeline_version": version, "bronze": bronze, "contracts": contracts, "published": published, "query_cache": {"path": f"{root}/gold/{run_id}/query_cache", "rows": served["query_cache"].count()}, "serving": tables, "quality": quality.quality_rates(rates, []).first().asDict()}
    lake.write_json(spark, f"{root}/gold/{run_id}/_manifest.json", manifest)
    return manifest
