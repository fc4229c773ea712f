"""Runs around the lake: ingestion from a catalogue, crosswalk, published towns, vector index, export."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions import text
from cartulary.functions.numbers import first_existing
from cartulary.operators import allocation, quality, relational, search, territory
from cartulary.plans import medallion
from cartulary.plans.dag import Step, run_steps
from cartulary.sources import lake, stores

# Domains of sources, the domain of each role, and the source that a role feeds.
DOMAINS = {"eleitoral_oficial", "socioeconomico", "territorial", "midia_e_social", "operacoes_de_campanha"}
ROLE_DOMAINS = {
    "base_parquet": "eleitoral_oficial",
    "mapping_csv": "eleitoral_oficial",
    "secao_csv": "eleitoral_oficial",
    "socio_csv": "socioeconomico",
    "ibge_csv": "socioeconomico",
    "seade_csv": "territorial",
    "social_csv": "midia_e_social",
    "operacoes_csv": "operacoes_de_campanha",
    "fiscal_csv": "operacoes_de_campanha",
}
ROLE_SOURCES = {
    "base_parquet": "base_eleitoral",
    "mapping_csv": "mapping_tse_ibge",
    "secao_csv": "resultado_secao",
    "socio_csv": "contexto_socio",
    "ibge_csv": "ibge_indicadores",
    "seade_csv": "seade_indicadores",
    "fiscal_csv": "transparencia_fiscal",
}
CROSSWALK_OK = 0.5


class IngestionError(ValueError):
    """A catalogue or an asset that can't be used."""


def catalog_assets(catalog: dict) -> list[dict]:
    """The assets of a catalogue, listed directly or under domains, each with its domain."""
    if str(catalog.get("pipeline", "")).strip().lower() not in ("open_data", "medallion"):
        raise IngestionError("the pipeline must be open_data or medallion")
    assets = [dict(a) for a in catalog.get("assets", [])]
    assets += [dict(a, domain=d.get("domain")) for d in catalog.get("domains", []) for a in d.get("assets", [])]
    if not assets:
        raise IngestionError("the catalogue has no assets")
    for a in assets:
        a["domain"] = a.get("domain") or ROLE_DOMAINS.get(a["role"], "")
        if a["domain"] not in DOMAINS:
            raise IngestionError(f"unknown domain {a['domain']!r}")
    return assets


def ingest(spark: SparkSession, catalog: dict, root: str, downloads: Path, fetch: Callable = stores.download) -> dict:
    """Downloads the assets, checks them, and runs the catalogue's pipeline; an optional asset may fail or be empty."""
    paths, assets = {}, []
    for a in catalog_assets(catalog):
        target, entry = downloads / a["file_name"], {k: a[k] for k in ("name", "role", "domain")}
        needed = a.get("required", True)
        try:
            entry["download"] = fetch(a["url"], target)
            if a["format"].lower() not in ("csv", "parquet"):
                raise IngestionError(f"{a['name']}: format not supported: {a['format']}")
            frame = lake.read_any(spark, str(target), a["format"].lower())
            nulls = quality.null_profile(frame).agg(F.avg("null_share")).first()[0] or 0.0
            entry |= {"rows": frame.count(), "null_pct": round(100 * nulls, 3)}
            if not entry["rows"] and needed:
                raise IngestionError(f"{a['name']} is empty")
        except (OSError, IngestionError) as error:
            if needed:
                raise IngestionError(str(error)) from error
            assets.append(entry | {"status": "warning", "error": str(error)})
            continue
        assets.append(entry | {"status": "ok" if entry["rows"] else "warning"})
        if a["role"] in ROLE_SOURCES:
            paths[ROLE_SOURCES[a["role"]]] = str(target)
    manifest = {"assets": assets, "domains": [{"domain": d, "assets": sorted(x["name"] for x in assets if x["domain"] == d), "rows": sum(x.get("rows", 0) for x in assets if x["domain"] == d)} for d in sorted({x["domain"] for x in assets})]}
    version = str(catalog.get("pipeline_version") or f"{catalog['pipeline']}_v1")
    run = medallion.run if catalog["pipeline"].strip().lower() == "medallion" else crosswalk
    manifest["run"] = run(spark, medallion.Inputs(paths), root, version)
    return manifest


def crosswalk(spark: SparkSession, inputs: medallion.Inputs, root: str, version: str) -> dict:
    """The base matched to the municipalities and enriched with context, its review queue, and the rate of matches."""
    base = lake.read_any(spark, inputs.paths["base_eleitoral"])
    dim = medallion.municipality_dimension(lake.read_any(spark, inputs.paths["mapping_tse_ibge"]))
    aliases = territory.alias_dimension(dim, medallion.ID, "nome_municipio", "aliases")
    code = first_existing(base, ["codigo_tse", "cod_tse", "cd_mun_tse"])
    rows = base.withColumns({"municipio_norm_input": text.normalize_text(F.col("municipio")), **{c: F.col(c).try_cast("int") if c in base.columns else F.lit(inputs.year if c == "ano" else None).cast("int") for c in ("ano", "mes", "turno")}})
    rows = territory.match(rows, dim, aliases, medallion.ID, "codigo_tse", "municipio_norm", "municipio_norm_input", code)
    rows = rows.withColumn("canonical_key", text.canonical_key(F.col(medallion.ID), F.col("ano"), F.col("mes"), F.col("turno")))
    if "contexto_socio" in inputs.paths:
        rows = relational.left_enriched(rows, medallion.context_dimension(lake.read_any(spark, inputs.paths["contexto_socio"])), medallion.ID, "_socio")
    folder = f"{root}/crosswalk/{version}"
    lake.publish(rows, f"{folder}/municipio_enriched")
    done = spark.read.parquet(f"{folder}/municipio_enriched")
    lake.publish(territory.review_queue(done), f"{folder}/manual_review_queue")
    rates = quality.quality_rates(done, [medallion.ID]).first()
    return {"path": folder, "rows": rates.n, "join_rate": rates.join_success, "status": "ok" if rates.join_success >= CROSSWALK_OK else "warning"}


# The columns of the towns' table.
TOWN_SCHEMA = {"ranking_final": "long", "municipio": "string", "cluster": "string", "indice_final": "double", "score_territorial_qt": "double", "VS_qt": "double", "ise_qt": "double", "PD_qt": "double", "pop_censo2022": "long", "perfil_economico": "string"}
TOWN_CLUSTERS = {"Diamante", "Alavanca", "Consolidacao", "Consolidação", "Descarte"}


def publish_towns(spark: SparkSession, source: str, root: str, version: str) -> dict:
    """Ingest, check, transform, publish: towns with clusters and every column, in the order of their ranking."""
    found: dict = {"version": version}

    def read(c):
        c["rows"] = lake.read_any(spark, source)

    def transform(c):
        rows = c["rows"]
        if "cluster" not in rows.columns:
            score = lambda n: F.col(n) if n in rows.columns else F.lit(0)
            rows = rows.withColumn("cluster", allocation.cluster(score("score_territorial_qt"), score("VS_qt")))
        c["rows"] = relational.backfilled(rows, TOWN_SCHEMA)

    def validate(c):
        rules = {"ranking": F.col("ranking_final") >= 1, "name": quality.required("municipio"), "cluster": F.col("cluster").isin(*TOWN_CLUSTERS), "index": F.col("indice_final") >= 0, "PD": F.col("PD_qt").isNull() | F.col("PD_qt").between(0, 100), "population": quality.optional_at_least("pop_censo2022", 0)}
        c["broken"] = {r.rule: r.violations for r in quality.violations(c["rows"], rules).collect() if r.violations}
        if c["broken"]:
            raise quality.ContractError(f"towns break {c['broken']}")

    def publish(c):
        c["path"] = f"{root}/towns/{version}"
        lake.publish(c["rows"].orderBy(F.col("ranking_final").asc_nulls_last(), "municipio"), c["path"])

    steps = [Step("publish", publish, ("validate",)), Step("validate", validate, ("transform",)), Step("transform", transform, ("ingest",)), Step("ingest", read)]
    found["order"] = run_steps(steps, found)
    found["n"] = found.pop("rows").count()
    return found


def reindex(spark: SparkSession, towns: str, index: str, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], collection: str = "municipios_v2", force: bool = False) -> dict:
    """Rebuilds the table of embedded documents unless the source is the one that it was built from.

    ``embedder()`` is called once for each task and gives a function from texts to vectors.
    """
    rows = lake.read_any(spark, towns)
    state = {"collection_name": collection, "source_hash": lake.content_hash(spark, towns, "towns").first()["hash"], "source_rows": rows.count()}
    place = f"{index}/{collection}"
    if not force and {k: v for k, v in lake.read_json(spark, f"{index}/{collection}_state.json").items() if k in state} == state:
        return state | {"status": "skipped", "reason": "already_indexed"}
    document = search.document_text(F.trim("municipio"), F.trim("cluster"), F.coalesce(F.col("indice_final").cast("double"), F.lit(0.0)), F.col("ranking_final").cast("int"))
    docs = rows.select(F.concat(F.lit("mun-"), F.col("ranking_final").cast("string"), F.lit("-"), F.substr(F.md5("municipio"), F.lit(1), F.lit(8))).alias("id"), document.alias("document"), "municipio", "cluster", "indice_final", "ranking_final")

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = embedder()
        for batch in batches:
            yield batch.assign(embedding=[list(map(float, v)) for v in encode(batch["document"].tolist())])

    schema = T.StructType([*docs.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    lake.publish(docs.mapInPandas(embed, schema), place)
    state["indexed_count"] = spark.read.parquet(place).count()
    lake.write_json(spark, f"{index}/{collection}_state.json", state)
    return state | {"status": "indexed"}


def hashed_words(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that needs no model: counts of words by a hash, scaled to length 1. Texts that share words are near."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, said in zip(out, texts):
            for word in said.lower().split():
                row[zlib.crc32(word.encode()) % size] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


# Names of the collections in order, and the rows that one needs.
COLLECTIONS = ["municipios_v2", "municipios"]
LEAST_INDEXED = 600


def open_index(spark: SparkSession, index: str, names: list[str] = COLLECTIONS, least: int = LEAST_INDEXED) -> DataFrame | None:
    """The first collection of embedded documents that is there with rows enough, or none."""
    for name in names:
        if lake.find_report(spark, name, [index]) and (rows := spark.read.parquet(f"{index}/{name}")).count() >= least:
            return rows
    return None


def similar_towns(index: DataFrame, vector: list[float], k: int = 5) -> str:
    """Names of the towns nearest to a vector, best first."""
    asked = index.sparkSession.createDataFrame([(0, vector)], "query int, embedding array<float>")
    found = search.nearest(index, asked, "municipio", "query", "embedding", k).orderBy("rank").collect()
    return ", ".join(r.item for r in found)


def export(spark: SparkSession, dataset: str, target: str, salt: str, minimize: bool = True, anonymize: bool = False, gold: list[str] | None = None, store: str | None = None) -> dict:
    """Copies a dataset with fewer columns and, on request, masked names; one file, for use elsewhere.

    With ``gold`` only datasets in these folders are exported. With ``store``, a folder of any file system, the copy is
    also put there, under its run, and registered in the store's catalogue.
    """
    if gold is not None and not lake.inside(spark, dataset, gold):
        raise ValueError(f"not in the gold layer: {dataset}")
    rows = lake.read_any(spark, dataset)
    if minimize:
        rows = relational.minimized(rows, ["ranking_final", "municipio", "cluster", "indice_final", "PD_qt", "pop_censo2022"])
    if anonymize and "municipio" in rows.columns:
        rows = rows.withColumn("municipio", quality.masked(F.col("municipio"), salt))
    rows.coalesce(1).write.mode("overwrite").parquet(target)
    done = {"path": target, "rows": spark.read.parquet(target).count(), "columns": rows.columns}
    if store:
        run_id = datetime.now(UTC).strftime("%Y%m%d_%H%M%S_%f")
        done |= {"run_id": run_id, "artifact": lake.copy_raw(spark, target, f"{store}/datasets/{run_id}/{target.rstrip('/').rsplit('/', 1)[-1]}")["path"]}
        lake.register_version(spark, f"{store}/catalog/versions", {"dataset_name": "exported_towns", "dataset_version": run_id, "timestamp_utc": datetime.now(UTC).isoformat(), "path": done["artifact"], "columns": rows.columns})
    return done


# What an entry of the catalogue of sources has.
SOURCE_FIELDS = {"key": "string", "nome": "string", "prioridade": "string", "area": "string", "cobertura_municipal": "double", "atualizacao_dias": "int", "licenca_aberta": "boolean", "schema_quality": "double", "endpoint": "string"}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of sources, a JSON array; an error if a field is missing or the array is empty."""
    rows = lake.read_any(spark, path, "json")
    if missing := [c for c in SOURCE_FIELDS if c not in rows.columns]:
        raise IngestionError(f"the catalogue of sources lacks {missing}")
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in SOURCE_FIELDS.items()]).withColumn("prioridade", F.upper("prioridade"))
    given = quality.violations(rows, {c: F.col(c).isNotNull() for c in SOURCE_FIELDS}).collect()
    if not given[0].rows or any(r.violations for r in given):
        raise IngestionError("the catalogue of sources is empty or lacks values: " + ", ".join(r.rule for r in given if r.violations))
    return rows


def prioritize(spark: SparkSession, catalog: str, report: str) -> dict:
    """Writes the report on a catalogue of sources: accepted ones of class A and B and rejected ones, the best first."""
    groups: dict[str, list] = {"accepted_a": [], "accepted_b": [], "rejected": []}
    for r in quality.prioritized_report(read_sources(spark, catalog)).collect():
        if r.group in groups:
            groups[r.group].append({"key": r.key, "nome": r.nome, "prioridade": r.prioridade, "area": r.area, "score": r.score, "accepted": r.group != "rejected", "endpoint": r.endpoint, "reasons": r.reasons})
    lake.write_json(spark, report, groups)
    return groups


def sync(catalog: dict, downloads: Path, fetch: Callable = stores.download) -> list[dict]:
    """Downloads the assets of a catalogue that changed, without running its pipeline."""
    downloads.mkdir(parents=True, exist_ok=True)
    return [{"name": a["name"], "path": str(downloads / a["file_name"]), "status": fetch(a["url"], downloads / a["file_name"])} for a in catalog_assets(catalog)]


def save_sheet(rows: DataFrame, path: Path) -> int:
    """A small result as a workbook on the driver; more rows than a sheet holds are an error before any is written."""
    if (n := rows.limit(stores.SHEET_ROWS + 1).count()) > stores.SHEET_ROWS:
        raise ValueError(f"{n} rows or more: a sheet holds {stores.SHEET_ROWS}")
    return stores.write_sheet(path, rows.columns, (tuple(r) for r in rows.toLocalIterator()))
