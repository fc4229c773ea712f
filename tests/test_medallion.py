"""One run over small sources: reconciled facts, marts with values worked out by hand, incremental state, catalogue."""

import pytest
from pyspark.sql import functions as F

from cartulary.operators import quality
from cartulary.plans.medallion import ID, Inputs, run
from cartulary.sources import lake

BASE = """municipio,ranking_final,indice_final,ano,turno
Sao Paulo,1,91,2026,1
São Paulo,2,86,2024,1
sao  paulo,2,84,2022,1
Sao Paulo,3,81,2020,1
Campinas,2,88,2026,1
Campinas,3,80,2024,1
Campinas,4,76,2022,1
Lugar Nenhum,9,1,2026,1
"""
FILES = {
    "base_eleitoral": BASE,
    "mapping_tse_ibge": "codigo_tse,codigo_ibge,nome_municipio,aliases,latitude,longitude\n71072,3550308,Sao Paulo,SP Capital,-23.55,-46.63\n62919,3509502,Campinas,,,\n",
    "contexto_socio": "codigo_ibge,idhm\n3550308,0.8\n3509502,0.79\n",
    "ibge_indicadores": "codigo_ibge,pop_total,renda_media,educacao_indice,urbanizacao_pct,acesso_internet\n3550308,12,3,0.8,98,90\n3509502,1,2,0.7,97,80\n",
    "seade_indicadores": "codigo_ibge,ipvs,emprego_formal,indice_saude,urbanizacao_pct,acesso_internet,estrutura_urbana_indice,ruralidade_pct\n3550308,3,0.6,0.8,98,90,0.9,1\n3509502,2,0.5,0.7,97,80,0.8,3\n",
    "transparencia_fiscal": "codigo_ibge,ano,transferencias,emendas\n3550308,2026,2600000,300000\n3550308,2024,2400000,200000\n3550308,2022,2200000,100000\n3509502,2026,1000000,200000\n3509502,2024,950000,150000\n3509502,2022,900000,120000\n",
    "resultado_secao": "municipio,zona,secao,votos_validos,ano,turno\nSao Paulo,1,10,1000,2026,1\nSao Paulo,1,11,900,2026,1\nCampinas,2,21,500,2026,1\n",
}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    paths = {}
    for name, said in FILES.items():
        (root / f"{name}.csv").write_text(said)
        paths[name] = str(root / f"{name}.csv")
    out = str(root / "out")
    return out, paths, run(spark, Inputs(paths, database="served"), out, "v1")


def mart(spark, done, name):
    return {r[ID]: r for r in spark.read.parquet(done[2]["published"][name]["path"]).collect()}


def test_marts(spark, done):
    potential = mart(spark, done, "mart_potencial_eleitoral_social")
    sp, ca = potential["3550308"], potential["3509502"]
    assert sp.janela_anos == "2022,2024,2026" and sp.anos_observados == 3
    assert sp.indice_medio_3ciclos == 87 and sp.potencial_eleitoral_ajustado_social == pytest.approx(174)
    assert ca.potencial_eleitoral_ajustado_social == pytest.approx(244 / 3)
    cost = mart(spark, done, "mart_custo_mobilizacao")
    assert cost["3550308"].custo_mobilizacao_relativo == 0 and cost["3509502"].custo_mobilizacao_relativo == pytest.approx(1)
    money = mart(spark, done, "mart_sensibilidade_investimento_publico")
    assert money["3550308"].investimento_publico_3ciclos == 7_800_000
    assert money["3550308"].sensibilidade_investimento_publico == pytest.approx(1.11538447e-5)
    trend = mart(spark, done, "mart_tendencia_turno")
    assert trend["3550308"].votos_validos_medio_3ciclos == 1900 and trend["3550308"].votos_validos_std_3ciclos is None
    whole = mart(spark, done, "mart_municipio_eleitoral")
    assert whole["3550308"].canonical_key == "3550308:2026:00:0"


def test_silver(spark, done):
    folder = f"{done[0]}/silver/{done[2]['run_id']}"
    fact = spark.read.parquet(f"{folder}/fato_eleitoral_municipio").collect()
    assert len(fact) == 7 and {r.canonical_key for r in fact} >= {"3550308:2026:00:1"}
    review = spark.read.parquet(f"{folder}/manual_review_queue").collect()
    assert [r.municipio_input for r in review] == ["Lugar Nenhum"]
    assert spark.read.parquet(f"{folder}/dim_tempo").count() == 2557
    places = spark.read.parquet(f"{folder}/dim_territorio").collect()
    assert len(places) == 7 and {r.geohash for r in places if r.cod_ibge_municipio == "3550308"} == {"6gyf4bv"}
    assert done[2]["quality"]["join_success"] == pytest.approx(7 / 8)


def test_serving_and_manifests(spark, done):
    cached = spark.read.parquet(done[2]["query_cache"]["path"])
    assert cached.count() == 2 and set(cached.columns) <= set(quality.SERVED) and {"potencial_eleitoral_ajustado_social", "score_priorizacao_territorial_sp", "sensibilidade_investimento_publico"} <= set(cached.columns)
    assert {t["table"]: t["rows"] for t in done[2]["serving"]}["served.query_cache"] == 2
    assert spark.table("served.mart_municipio_eleitoral").where("municipio_id_ibge7 = '3550308'").count() == 1
    said = lake.read_json(spark, done[2]["bronze"]["transparencia_fiscal"]["manifest"])
    assert said["schema_detectado"] == {c: "string" for c in ("codigo_ibge", "ano", "transferencias", "emendas")}
    assert said["cobertura_territorial"] == {"granularidade": "municipio", "rows": 6, "municipios_cobertos": 2}
    assert said["periodo_referencia"] == {"colunas": ["ano"], "ano": ["2022", "2024", "2026"], "inicio": 2022, "fim": 2026}
    assert said["qualidade_carga"] == {"status": "ok", "rows": 6, "columns": 4, "null_pct": 0.0, "null_critical": 0.0}
    raw = done[2]["bronze"]["base_eleitoral"]
    with open(raw["path"]) as f:
        assert f.read() == BASE
    assert raw["source_last_modified_utc"].startswith("20")


def test_second_run_skips_what_is_unchanged(spark, done):
    out, paths, first = done
    with open(paths["contexto_socio"], "a") as f:
        f.write("3500000,0.7\n")
    second = run(spark, Inputs(paths), out, "v2")
    assert {k for k, v in second["bronze"].items() if v["status"] == "loaded_changed"} == {"contexto_socio"}
    assert all(p["drift_score"] == 0 for p in second["published"].values())
    newest = lake.latest_versions(spark, f"{out}/catalog/versions")
    assert {r.dataset_version for r in newest.collect()} == {second["run_id"]}


def test_contract(spark):
    rows = spark.createDataFrame([("", "1", "a")], "codigo_tse string, codigo_ibge string, nome_municipio string")
    with pytest.raises(quality.ContractError):
        quality.source_contract("mapping_tse_ibge", rows)
    with pytest.raises(quality.ContractError):
        quality.source_contract("mapping_tse_ibge", rows.select(F.lit("x").alias("codigo_tse")))
