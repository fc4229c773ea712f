"""The service, the assistant, reports, sheets, backups, views, contracts of layers and the command line."""

import json
import threading
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
import zipfile

import pytest

from cartulary import __main__ as cli
from cartulary.operators import quality, relational
from cartulary.plans import assistant, jobs
from cartulary.service import service
from cartulary.sources import lake, stores

TOKENS = {"a": {"role": "admin", "actor": "ana"}, "o": {"role": "operator", "actor": "otto"}, "v": {"role": "viewer", "actor": "vera"}}


@pytest.fixture()
def url(tmp_path):
    def export(payload):
        if payload.get("fail"):
            raise ValueError("it failed")
        return {"done": payload["input_path"]}

    server = service(("127.0.0.1", 0), stores.JobStore(str(tmp_path / "jobs.sqlite3")), {"export": export}, TOKENS, lambda kind, p: None if "input_path" in p else "input_path is missing")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def ask(url, token=None, payload=None):
    request = urllib.request.Request(url, None if payload is None else json.dumps(payload).encode(), {"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=10) as response:
            return response.status, json.load(response)
    except urllib.error.HTTPError as error:
        return error.code, json.load(error)


def test_service(url):
    assert ask(f"{url}/health")[1]["status"] == "ok"
    assert ask(f"{url}/v1/jobs/export", payload={})[0] == 401
    assert ask(f"{url}/v1/jobs/export", "x", {})[0] == 403
    assert ask(f"{url}/v1/jobs/export", "v", {"input_path": "p"})[0] == 403
    assert ask(f"{url}/v1/jobs/export", "o", {})[0] == 400
    assert ask(f"{url}/v1/jobs/other", "o", {})[0] == 404
    ids = [ask(f"{url}/v1/jobs/export", "o", {"input_path": "p", "fail": fail})[1]["job_id"] for fail in (False, True)]
    for _ in range(100):
        states = [ask(f"{url}/v1/jobs/{i}", "v")[1] for i in ids]
        if all(s["status"] in ("finished", "failed") for s in states):
            break
        time.sleep(0.05)
    assert states[0]["result"] == {"done": "p"} and states[1]["error"] == "it failed"
    assert ask(f"{url}/v1/jobs/none", "v")[0] == 404 and ask(f"{url}/v1/audit", "o")[0] == 403
    items = ask(f"{url}/v1/audit?limit=500", "a")[1]["items"]
    assert {json.loads(i["detail"])["token_fp"] for i in items} == {stores.token_fingerprint(t) for t in "aov"}
    assert items[0]["action"] == "list_audit" and any(i["actor"] == "otto" and i["action"] == "enqueue_export" for i in items)


def test_assistant(spark, tmp_path):
    spark.createDataFrame([("Campinas", "Diamante", 90.0, 1), ("Santos", "Alavanca", 80.0, 2)], "municipio string, cluster string, indice_final double, ranking_final int").createOrReplaceTempView("municipios")
    for name in ("alocacao", "secoes", "mapa_tatico"):
        spark.catalog.dropTempView(name)
    index = spark.createDataFrame([("Campinas", [0.0]), ("Santos", [5.0])], "municipio string, embedding array<float>")
    calls = []

    def complete(history, question, context):
        calls.append(context)
        if "falha" in question:
            raise RuntimeError
        return f"sobre {question}", 500

    one = assistant.Assistant(spark, index, str(tmp_path / "events"), lambda text: [1.0], complete)
    assert one.snapshot()["queries_total"] == 0
    assert one.ask("melhores perto de campinas") == one.ask("Melhores perto de Campinas ") == "sobre melhores perto de campinas"
    assert len(calls) == 1 and "Near towns: Campinas, Santos" in calls[0]
    assert "Campinas" in one.ask("falha")
    rows = spark.read.parquet(str(tmp_path / "events")).orderBy("ts_utc").collect()
    assert [(r.cached_vector, r.cached_llm, r.fallback_any, r.recall_at_k) for r in rows] == [(False, False, False, 1.0), (True, True, False, 1.0), (False, False, True, None)]
    found = one.snapshot()
    assert found["queries_total"] == 3 and found["recall_at_k_avg"] == 1 and found["fallback_rate_llm"] == pytest.approx(1 / 3) and found["cost_per_query_avg_usd"] == pytest.approx(0.5 * assistant.TOKEN_PRICE / 3)
    silent = assistant.Assistant(spark, None, str(tmp_path / "events"))
    assert "Campinas" in silent.ask("melhores") and silent.snapshot()["fallback_rate_vector"] == pytest.approx(1 / 4)


def test_open_index(spark, tmp_path):
    row = "municipio string, embedding array<float>"
    spark.createDataFrame([("a", [1.0])] * 3, row).write.parquet(str(tmp_path / "municipios_v2"))
    spark.createDataFrame([("a", [1.0])] * 7, row).write.parquet(str(tmp_path / "municipios"))
    assert jobs.open_index(spark, str(tmp_path)) is None
    assert jobs.open_index(spark, str(tmp_path), least=5).count() == 7 and jobs.open_index(spark, str(tmp_path), least=3).count() == 3


@pytest.mark.parametrize("n", [0, 1, 3, 11, 21, 31, 500, 20011])
def test_nearest_ranks(spark, n):
    rows = spark.range(n).selectExpr("case when id % 9 = 4 then null else cast(id * 7919 % 1009 as double) end as a", "cast(if(id % 2 = 0, 3, 3) as double) as b")
    want = sorted(0.0 if i % 9 == 4 else float(i * 7919 % 1009) for i in range(n))
    got = quality.nearest_ranks(rows, ["a", "b"], 0.95)
    assert got == {"a": want[round(0.95 * (n - 1))] if n else 0.0, "b": 3.0 if n else 0.0}


def test_years_prune_partitions(spark, tmp_path):
    spark.range(40).selectExpr("id", "cast(2000 + id % 8 as int) as ano").write.partitionBy("ano").parquet(str(tmp_path / "t"))
    rows = relational.cycle_window(spark.read.parquet(str(tmp_path / "t")), 2)
    assert sorted({r.ano for r in rows.collect()}) == [2006, 2007]
    assert "PartitionFilters: [ano" in rows._jdf.queryExecution().toString().replace("isnotnull(ano#", "ano#")


def test_sheet(spark, tmp_path):
    rows = spark.createDataFrame([("a<&é", 1, 2.5, True, None), (None, 2, float("nan"), False, "x")], "s string, i int, d double, b boolean, n string").coalesce(1)
    assert jobs.save_sheet(rows, tmp_path / "x.xlsx") == 2
    with zipfile.ZipFile(tmp_path / "x.xlsx") as book:
        for name in book.namelist():
            ET.fromstring(book.read(name))
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    cells = [["".join(c.itertext()) for c in row.iter(f"{space}c")] for row in sheet.iter(f"{space}row")]
    assert cells == [["s", "i", "d", "b", "n"], ["a<&é", "1", "2.5", "1", ""], ["", "2", "", "0", "x"]]


def test_backup_and_restore(tmp_path):
    store = stores.JobStore(str(tmp_path / "jobs.sqlite3"))
    store.create("j", "export", {"k": 1})
    copy = stores.backup(tmp_path / "jobs.sqlite3", tmp_path / "copies", "s")
    store.update("j", "running")
    stores.restore(copy, tmp_path / "again" / "jobs.sqlite3")
    assert stores.JobStore(str(tmp_path / "again" / "jobs.sqlite3")).get("j")["status"] == "queued"
    with pytest.raises(FileNotFoundError):
        stores.backup(tmp_path / "none", tmp_path, "s")


def test_reports_views_and_gold(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    (tmp_path / "file").write_text("")
    folders = [str(tmp_path / "file" / "under"), str(tmp_path / "ok")]
    assert lake.save_report(rows, "r.parquet", folders) == f"{tmp_path}/ok/r.parquet"
    assert lake.find_report(spark, "r.parquet", folders) == f"{tmp_path}/ok/r.parquet" and lake.find_report(spark, "q", folders) is None
    assert lake.register_views(spark, {"there": f"{tmp_path}/ok/r.parquet", "lost": f"{tmp_path}/none"}) == ["there"]
    assert spark.table("there").count() == 1
    gold = [f"{tmp_path}/gold"]
    assert lake.inside(spark, f"{tmp_path}/gold/a", gold) and not lake.inside(spark, f"{tmp_path}/golden", gold) and not lake.inside(spark, f"{tmp_path}/gold/../x", gold)
    with pytest.raises(ValueError):
        jobs.export(spark, f"{tmp_path}/ok/r.parquet", f"{tmp_path}/out", "s", gold=gold)
    done = jobs.export(spark, f"{tmp_path}/ok/r.parquet", f"{tmp_path}/out", "s", gold=[f"{tmp_path}/ok"], store=f"{tmp_path}/store")
    assert spark.read.parquet(done["artifact"]).count() == 1
    assert [r.dataset_version for r in lake.latest_versions(spark, f"{tmp_path}/store/catalog/versions").collect()] == [done["run_id"]]


def test_layer_contracts(spark):
    names = quality.LAYER_COLUMNS["dim_municipio"]
    rows = lambda *r: spark.createDataFrame(list(r), ", ".join(f"{n} string" for n in names))
    quality.layer_contract("dim_municipio", rows(tuple("abcde")))
    for broken in (rows(), rows((" ", "b", "c", "d", "e")), rows(tuple("abcde")).drop("codigo_tse")):
        with pytest.raises(quality.ContractError):
            quality.layer_contract("dim_municipio", broken)
    state = spark.createDataFrame([("lost",)], "join_status string")
    for n in quality.LAYER_COLUMNS["municipio_enriched"]:
        state = state if n == "join_status" else state.selectExpr("*", f"'x' as {n}")
    with pytest.raises(quality.ContractError):
        quality.layer_contract("municipio_enriched", state)


def test_sources_report(spark, tmp_path):
    source = {"key": "a", "nome": "A", "prioridade": "a", "area": "x", "cobertura_municipal": 1.0, "atualizacao_dias": 30, "licenca_aberta": True, "schema_quality": 0.9, "endpoint": "e"}
    path, report = tmp_path / "s.json", str(tmp_path / "r.json")
    path.write_text(json.dumps([source, source | {"key": "b", "schema_quality": 1.0}, source | {"key": "c", "prioridade": "B"}, source | {"key": "d", "licenca_aberta": False}]))
    found = jobs.prioritize(spark, str(path), report)
    assert [s["key"] for s in found["accepted_a"]] == ["b", "a"] and [s["key"] for s in found["rejected"]] == ["d"]
    assert found["rejected"][0]["reasons"] == ["licenca nao aberta"] and lake.read_json(spark, report) == found
    for broken in ([{k: v for k, v in source.items() if k != "area"}], [source, source | {"area": None}]):
        path.write_text(json.dumps(broken))
        with pytest.raises(jobs.IngestionError):
            jobs.prioritize(spark, str(path), report)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "map.csv").write_text("ranking_final,municipio,indice_final,score_territorial_qt,VS_qt\n1,A,90,80,80\n")
    (tmp_path / "catalog.json").write_text(json.dumps({"pipeline": "medallion", "assets": [{"name": "m", "role": "mapping_csv", "url": (tmp_path / "map.csv").as_uri(), "file_name": "got.csv", "format": "csv"}]}))
    cli.main(["sync", str(tmp_path / "catalog.json"), "--downloads", str(tmp_path / "got")])
    assert json.loads(capsys.readouterr().out)[0]["status"] == "downloaded" and (tmp_path / "got" / "got.csv").exists()
    cli.main(["retention", str(tmp_path / "got"), "--days", "-1"])
    assert json.loads(capsys.readouterr().out)[str(tmp_path / "got")]
    stores.JobStore(str(tmp_path / "j.sqlite3"))
    cli.main(["backup", str(tmp_path / "j.sqlite3"), str(tmp_path / "copies")])
    assert "j_" in json.loads(capsys.readouterr().out)["backup"]
    for year in ("2023", "2024"):
        spark.createDataFrame([(1, f"T{year}", "Diamante", 90.0)], "ranking_final int, municipio string, cluster string, indice_final double").write.parquet(str(tmp_path / f"towns_{year}.parquet"))
    cli.main(["reindex", str(tmp_path), str(tmp_path / "index"), "--latest", "towns_*.parquet"])
    assert json.loads(capsys.readouterr().out)["indexed_count"] == 1
    assert spark.read.parquet(str(tmp_path / "index" / "municipios_v2")).first().municipio == "T2024"
    cli.main(["metrics", str(tmp_path / "events")])
    assert json.loads(capsys.readouterr().out)["queries_total"] == 0
