"""Ingestion, crosswalk, published towns, the vector index and exports."""

import shutil

import pytest

from cartulary.operators.quality import ContractError
from cartulary.plans import jobs
from cartulary.plans.medallion import Inputs

BASE = "municipio,codigo_tse,ranking_final,indice_final,ano,turno\nSao Paulo,71072,1,91,2026,1\nCampinas,,2,88,2026,1\nSP Capital,,3,80,2026,1\nCampina,,4,70,2026,1\nCidade Sem Match,,5,10,2026,1\n"
MAPPING = 'codigo_tse,codigo_ibge,nome_municipio,aliases\n71072,3550308,Sao Paulo,"S. Paulo;SP Capital"\n62919,3509502,Campinas,\n'
SOCIO = "codigo_ibge,idhm\n3550308,0.8\n3509502,0.79\n"


@pytest.fixture()
def files(tmp_path):
    for name, said in (("base", BASE), ("map", MAPPING), ("socio", SOCIO)):
        (tmp_path / f"{name}.csv").write_text(said)
    return tmp_path


def test_crosswalk(spark, files):
    paths = {"base_eleitoral": str(files / "base.csv"), "mapping_tse_ibge": str(files / "map.csv"), "contexto_socio": str(files / "socio.csv")}
    done = jobs.crosswalk(spark, Inputs(paths), str(files), "v")
    assert done["join_rate"] == 0.8 and done["status"] == "ok"
    rows = {r.municipio: r for r in spark.read.parquet(f"{done['path']}/municipio_enriched").collect()}
    assert rows["Sao Paulo"].canonical_key == "3550308:2026:00:1" and rows["Campina"].idhm == "0.79"
    assert spark.read.parquet(f"{done['path']}/manual_review_queue").count() == 1


def test_ingest(spark, files):
    asset = lambda n, role, **k: {"name": n, "role": role, "url": f"{n}.csv", "file_name": f"got_{n}.csv", "format": "csv", **k}
    catalog = {"pipeline": "open_data", "domains": [{"domain": "eleitoral_oficial", "assets": [asset("base", "base_parquet"), asset("map", "mapping_csv")]}], "assets": [asset("lost", "social_csv", required=False)]}

    def fetch(url, target):
        shutil.copyfile(files / url, target)
        return "downloaded"

    done = jobs.ingest(spark, catalog, str(files / "out"), files, fetch)
    assert {a["name"]: a["status"] for a in done["assets"]} == {"base": "ok", "map": "ok", "lost": "warning"} and done["run"]["join_rate"] == 0.8
    catalog["assets"][0]["required"] = True
    with pytest.raises(jobs.IngestionError):
        jobs.ingest(spark, catalog, str(files / "out"), files, fetch)
    with pytest.raises(jobs.IngestionError):
        jobs.catalog_assets({"pipeline": "medallion"})


def test_towns_index_and_export(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path)
    rows = [(2, "B", 80.0, 65.0, 75.0, 50.0, 10), (1, "A", 90.0, 80.0, 80.0, 50.0, 20)]
    spark.createDataFrame(rows, "ranking_final int, municipio string, indice_final double, score_territorial_qt double, VS_qt double, PD_qt double, pop_censo2022 long").write.parquet(source)
    done = jobs.publish_towns(spark, source, root, "v1")
    assert done["order"] == ["ingest", "transform", "validate", "publish"] and done["n"] == 2
    towns = spark.read.parquet(done["path"])
    assert {r.municipio: r.cluster for r in towns.collect()} == {"A": "Diamante", "B": "Alavanca"} and "ise_qt" in towns.columns

    embedder = lambda: lambda texts: [[float(len(t)), float("Diamante" in t)] for t in texts]
    first = jobs.reindex(spark, done["path"], f"{root}/index", embedder)
    assert first["status"] == "indexed" and first["indexed_count"] == 2
    assert jobs.reindex(spark, done["path"], f"{root}/index", embedder)["status"] == "skipped"
    assert jobs.reindex(spark, done["path"], f"{root}/index", embedder, force=True)["status"] == "indexed"
    index = spark.read.parquet(f"{root}/index/municipios_v2")
    assert "Municipio: A. Cluster: Diamante. Indice final: 90.00. Ranking: 1." in [r.document for r in index.collect()]
    assert jobs.similar_towns(index, [60.0, 1.0], 1) == "A"

    out = jobs.export(spark, done["path"], f"{root}/export", "s", anonymize=True)
    assert out["columns"] == ["ranking_final", "municipio", "cluster", "indice_final", "PD_qt", "pop_censo2022"]
    assert all(len(r.municipio) == 16 for r in spark.read.parquet(out["path"]).collect())
    spark.createDataFrame([(0, "", "Outro", 1.0)], "ranking_final int, municipio string, cluster string, indice_final double").write.parquet(f"{source}2")
    with pytest.raises(ContractError):
        jobs.publish_towns(spark, f"{source}2", root, "v2")
