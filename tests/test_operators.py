"""Rules of operators on small frames: nulls, ties, order, rounding."""

import pytest
from pyspark.sql import functions as F

from cartulary.functions import geo, text
from cartulary.functions.numbers import min_max
from cartulary.operators import allocation, quality, relational, search, territory
from cartulary.plans.dag import DagError, Step, run_steps
from cartulary.sources import lake, stores


def test_normalize_text(spark):
    rows = spark.createDataFrame([(" São  Paulo\t",), ("Ærø ß",), (None,), ("",)], "x string")
    both = rows.select(text.normalize_text(F.col("x")).alias("a"), text.normalize_text_exact("x").alias("b")).collect()
    assert [r.a for r in both] == ["sao paulo", "r", None, ""] and [r.b for r in both] == ["sao paulo", "r", None, ""]


def test_codes_and_keys(spark):
    rows = spark.createDataFrame([("3550308.0", "a"), ("12", ""), ("123456789", None), (None, "x")], "c string, i string")
    assert [r[0] for r in rows.select(text.normalize_code(F.col("c"))).collect()] == ["3550308", "0000012", "123456789", ""]
    keys = rows.select(text.canonical_key(F.col("i"), F.lit(2026), F.lit(None).cast("int"), F.lit(1))).collect()
    assert [k[0] for k in keys] == ["a:2026:00:1", None, None, "x:2026:00:1"]


def test_geohash(spark):
    rows = spark.createDataFrame([(57.64911, 10.40744), (None, 1.0), (90.0, 180.0)], "a double, b double")
    assert [r[0] for r in rows.select(geo.geohash(F.col("a"), F.col("b"))).collect()] == ["u4pruyd", None, "zzzzzzz"]


def test_min_max_of_constants_and_nulls(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = min_max(rows, x="a", y="b").collect()
    assert [(r.x, r.y) for r in got] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_cycle_window(spark):
    rows = spark.createDataFrame([(2020,), (2022,), (2024,), (None,), (2024,)], "ano int")
    assert sorted(r.ano for r in relational.cycle_window(rows, 2).collect()) == [2022, 2024, 2024]
    unknown = spark.createDataFrame([(None,), (None,)], "ano int")
    assert relational.cycle_window(unknown, 2).count() == 2


MATCH_DIM = [("3550308", "71072", "Sao Paulo", ["S. Paulo", "SP Capital"]), ("3509502", "62919", "Campinas", [])]


def matched(spark, names):
    dim = spark.createDataFrame(MATCH_DIM, "id string, code string, nome string, aliases array<string>").withColumn("norm", text.normalize_text(F.col("nome")))
    aliases = territory.alias_dimension(dim, "id", "nome", "aliases")
    base = spark.createDataFrame(names, "name string, code_in string").withColumn("norm_in", text.normalize_text(F.col("name")))
    return {r.name: r for r in territory.match(base, dim, aliases, "id", "code", "norm", "norm_in", "code_in").collect()}


def test_tiers(spark):
    got = matched(spark, [("Sao Paulo", "71072"), ("Campinas", None), ("SP Capital", None), ("Campina", None), ("Cidade Sem Match", None), (None, None)])
    assert {n: r.join_method for n, r in got.items()} == {"Sao Paulo": "exact_code", "Campinas": "exact_name", "SP Capital": "historical_alias", "Campina": "fuzzy_score", "Cidade Sem Match": "manual_review", None: "manual_review"}
    assert got["Campina"].join_confidence == 0.933333 and got["Campina"].id == "3509502"


TOWNS = [(1, "A", "Diamante", 95.0, 70.0, 100000.0), (2, "B", "Alavanca", 85.0, 45.0, 80000.0), (3, "C", "Descarte", 50.0, 20.0, 50000.0)]


def test_unseen_candidates_change_no_match(spark):
    import random

    from cartulary.operators import territory

    rng = random.Random(8)
    towns = sorted({"".join(rng.choices("abcde ", k=rng.randint(1, 14))).strip() or "x" for _ in range(150)})
    dim = spark.createDataFrame([(str(k), f"c{k}", t) for k, t in enumerate(towns)], "id string, code string, norm_nome string")
    aliases = dim.select("id", dim.norm_nome.alias("alias_norm"))
    spoilt = [t[: (k := rng.randrange(len(t)))] + rng.choice(["", "z", "ab"]) + t[k + rng.randint(0, 1) :] for t in rng.choices(towns, k=300)]
    base = spark.createDataFrame([(k, t) for k, t in enumerate(spoilt)], "row int, norm_input string")
    found = [{r.row: (r.id, r.join_method, r.join_confidence) for r in territory.match(base, dim, aliases, "id", "code", "norm_nome", "norm_input", shown=shown).collect()} for shown in (True, False)]
    assert found[0] == found[1] and sum(m == "fuzzy_score" for _, m, _ in found[0].values()) > 20


def test_allocation(spark):
    rows = spark.createDataFrame(TOWNS, "ranking_final long, municipio string, cluster string, indice_final double, PD_qt double, pop_censo2022 double")
    a, b = allocation.allocate(rows, 100_000, "deputado_federal", 3, 0.5).orderBy("ranking").collect()
    assert tuple(a[6:]) == (61489, 30744, 30744, 12270, 6893, 5652, 3171, 2757, 16909, 9223, 4612)
    assert tuple(b[6:]) == (38511, 19256, 19256, 8240, 4270, 2861, 2178, 1708, 7702, 6740, 4814)
    capped = allocation.allocate(rows, 1e9, "vereador_pequeno", 3, 0.5).agg(F.max("budget")).first()[0]
    assert capped == 60_000
    assert allocation.allocate(rows.where("cluster = 'Descarte'"), 1e5, "senador", 3, 0.5).count() == 0


def test_priorities(spark):
    rows = spark.createDataFrame([("a", "A", 0.98, 30, True, 0.93), ("r", "A", 0.9, 60, True, 0.8)], "k string, prioridade string, cobertura_municipal double, atualizacao_dias int, licenca_aberta boolean, schema_quality double")
    got = {r.k: r for r in quality.prioritized(rows).collect()}
    assert got["a"].group == "accepted_a" and got["a"].score == 0.9805 and got["a"].reasons == []
    assert got["r"].group == "rejected" and len(got["r"].reasons) == 3


def test_event_snapshot(spark):
    rows = spark.createDataFrame([(100.0, 30.0, 70.0, True, True, False, 1.0, 0.02), (300.0, 90.0, 210.0, False, False, False, None, 0.08)], "latency_total_ms double, latency_vector_ms double, latency_llm_ms double, fallback_any boolean, fallback_vector boolean, fallback_llm boolean, recall_at_k double, cost_estimated_usd double")
    r = quality.event_snapshot(rows).first()
    assert (r.queries_total, r.latency_total_p95_ms, r.latency_vector_p95_ms, r.fallback_rate_vector, r.recall_at_k_avg) == (2, 300.0, 90.0, 0.5, 1.0)
    assert r.cost_per_query_avg_usd == pytest.approx(0.05)


def test_privacy(spark):
    rows = spark.createDataFrame([("1", "x@y", 5), (None, None, 6)], "cpf string, email string, ano int")
    out, report = quality.for_purpose(rows, "serving", "s")
    assert out.columns == ["ano"] and report["minimized"]
    out, report = quality.for_purpose(rows, "analysis", "s")
    first, second = out.orderBy("ano").collect()
    assert len(first.cpf) == 16 and second.cpf is None and report["anonymized_columns"] == ["cpf", "email"]


def test_router(spark):
    spark.createDataFrame([("A", "Diamante", 95.0, 1), ("B", "Descarte", 10.0, 2)], "municipio string, cluster string, indice_final double, ranking_final int").createOrReplaceTempView("municipios")
    assert "GROUP BY cluster" in search.routed_sql(spark, "Quantos por cluster?")
    assert "ORDER BY ranking_final" in search.routed_sql(spark, "como alocar o budget?")  # no such table yet
    assert "Diamante" in search.answer(spark, "cluster?")

    def broken(*_):
        raise RuntimeError

    assert "A" in search.answer(spark, "lista", complete=broken)
    with pytest.raises(ValueError):
        search.safe_table("municipios; drop")


def test_steps():
    seen = []
    steps = [Step("b", lambda c: seen.append("b"), ("a",)), Step("a", lambda c: seen.append("a"))]
    assert run_steps(steps, {}) == ["a", "b"] == seen
    for bad in ([Step("a", print), Step("a", print)], [Step("a", print, ("x",))], [Step("a", print, ("b",)), Step("b", print, ("a",))]):
        with pytest.raises(DagError):
            run_steps(bad, {})


def test_lake(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024", "sp"), (2, None, " "), (3, "x", "rj")], "v int, ano string, uf string")
    lake.append_partitioned(rows, str(tmp_path / "l"), "f", "r", None, "SP")
    back = spark.read.parquet(str(tmp_path / "l"))
    assert sorted((r.v, r.ano, r.uf) for r in back.collect()) == [(1, 2024, "SP"), (2, 0, "SP"), (3, 0, "RJ")]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in lake.read_any(spark, str(tmp_path / "e.jsonl")).collect()) == [1, 2]
    (tmp_path / "c.csv").write_text("k\n007\n")
    assert lake.read_any(spark, str(tmp_path / "c.csv")).first().k == "007"
    for n in ("m_1.parquet", "m_2.parquet"):
        (tmp_path / n).write_text("")
    assert lake.latest_file(spark, str(tmp_path), ["x_*", "m_*"]).endswith("m_2.parquet")


def test_serving_table(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "municipio_id_ibge7 string, v int")
    lake.serve(rows, "mart_test", "municipio_id_ibge7", 2)
    assert spark.table("mart_test").count() == 2


def test_stores(tmp_path):
    jobs = stores.JobStore(str(tmp_path / "j.db"))
    jobs.create("1", "export", {"a": 1})
    jobs.update("1", "finished", {"rows": 2})
    assert jobs.get("1")["status"] == "finished" and jobs.get("1")["result"] == {"rows": 2} and jobs.get("2") is None
    jobs.log("me", "x", {})
    jobs.log("me", "y", {})
    assert [r[2] for r in jobs.last(1)] == ["y"]
    now = [0.0]
    cache = stores.TimedCache(2, 10, lambda: now[0])
    for k in "abc":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11
    assert cache.get("c") is None
    with pytest.raises(ValueError):
        stores.put_artifact(tmp_path / "s", tmp_path / "j.db", "../x")


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 7)
    monkeypatch.setattr(search, "QUERIES", 3)
    vectors = {f"v{k:02}": [float(k * k % 11), float(k % 3)] for k in range(40)} | {"null": None, "hole": [1.0, None], "long": [0.0, 0.0, 0.0]}
    rows = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    found = search.nearest(rows, rows.where("id like '%0' or id = 'long'"), "id", "id", "embedding", 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    plane = {k: v for k, v in vectors.items() if k.startswith("v")}
    want = {("long", 1, "long", 0.0)}
    for q in (k for k in plane if k.endswith("0")):
        best = sorted((sum((x - y) ** 2 for x, y in zip(v, plane[q])), k) for k, v in plane.items())[:4]
        want |= {(q, n + 1, k, d) for n, (d, k) in enumerate(best)}
    assert {(r.query, r.rank, r.item, r.distance) for r in found.collect()} == want


def test_every_hundredth_vector_asks(spark):
    from cartulary.plans.queries import QUERIES

    asked = QUERIES["knn_topk"](spark, "/root/testdata/sf0.1")
    assert asked.count() == 5 * spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 100 = 0").count() == 100


def test_previous_version_walks_the_whole_catalogue(spark, tmp_path):
    catalog, place = str(tmp_path / "catalog"), tmp_path / "first"
    place.mkdir()
    paths = [str(place)] + [str(tmp_path / f"gone{k}") for k in range(25)]
    entries = [("d", f"v{k}", f"2026-01-{k + 1:02}", f'{{"path": "{path}"}}') for k, path in enumerate(paths)]
    spark.createDataFrame(entries, "dataset_name string, dataset_version string, timestamp_utc string, metadata string").coalesce(1).write.json(catalog)
    assert lake.previous_version(spark, catalog, "d", "v25") == str(place)
    assert lake.previous_version(spark, catalog, "d", "v0") is None
