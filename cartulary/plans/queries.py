"""Registered queries: each runs operators over whole tables, with SQL that says the same independently."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import calendar, geo, text
from cartulary.functions.numbers import min_max
from cartulary.operators import allocation, marts, quality, relational, search, territory
from cartulary.plans import jobs, medallion
from cartulary.sources import lake, stores
from cartulary.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _year(column: str):
    return F.year(column)


# --- scans, projections, top-k, routed statistics -------------------------------------------------------------------


@register("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size IN (5, 10, 15) AND p_brand <> 'Brand#11' AND contains(upper(p_name), 'E')")
def scan_project_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.col("p_size").isin(5, 10, 15) & (F.col("p_brand") != "Brand#11"))
    return rows.where(F.coalesce(F.upper("p_name").contains("E"), F.lit(False))).select("p_partkey", "p_name", "p_brand", "p_size")


@register("SELECT c_name AS municipio, c_mktsegment AS cluster, round(c_acctbal, 0) AS budget FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def router_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(15)
    return rows.select(F.col("c_name").alias("municipio"), F.col("c_mktsegment").alias("cluster"), F.round("c_acctbal", 0).alias("budget"))


@register("SELECT c_mktsegment AS cluster, count(*) AS n, round(avg(c_acctbal), 1) AS indice_medio FROM customer GROUP BY 1")
def router_group_avg(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 1).alias("indice_medio"))


@register("SELECT round(avg(o_totalprice), 1) AS media, round(max(o_totalprice), 1) AS maximo, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS fechados FROM orders")
def router_global_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.round(F.avg("o_totalprice"), 1).alias("media"), F.round(F.max("o_totalprice"), 1).alias("maximo"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("fechados"))


@register("SELECT DISTINCT c_name FROM customer ORDER BY 1")
def distinct_sorted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name").distinct().orderBy("c_name")


PRIORITIES = {"alta": "1-URGENT", "media": "3-MEDIUM", "baixa": "5-LOW"}


@register("SELECT o_orderstatus, " + ", ".join(f"CAST(sum(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k, v in PRIORITIES.items()) + ", count(*) AS total FROM orders GROUP BY 1")
def priority_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.count_if(F.col("o_orderpriority") == v).alias(k) for k, v in PRIORITIES.items()], F.count(F.lit(1)).alias("total"))


@register("SELECT o_orderkey, o_custkey, round(o_totalprice * 100, 1) AS pct FROM orders WHERE o_orderpriority = '1-URGENT'")
def param_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_custkey, round(o_totalprice * 100, 1) AS pct FROM {rows} WHERE o_orderpriority = :p", args={"p": "1-URGENT"}, rows=rows)


@register("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS custo FROM supplier ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey LIMIT 50")
def two_key_sort_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").orderBy(F.col("s_nationkey").asc_nulls_last(), F.col("s_acctbal").desc_nulls_last(), "s_suppkey").limit(50)
    return rows.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("custo"))


@register("SELECT c.* EXCLUDE (c_nationkey), n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def star_except(spark, sf_dir):
    return spark.sql("SELECT c.* EXCEPT (c_nationkey), n.n_name FROM {c} AS c LEFT JOIN {n} AS n ON c.c_nationkey = n.n_nationkey", c=table(spark, sf_dir, "customer"), n=table(spark, sf_dir, "nation"))


# --- matching -------------------------------------------------------------------------------------------------------


def _nations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("c"), "n_nationkey").alias("code"), F.col("n_name").alias("nome"), text.normalize_text(F.col("n_name")).alias("norm_nome"))
    aliases = territory.alias_dimension(dim.withColumn("aliases", F.array(F.concat(F.lit("Antiga Nação "), F.col("id")))), "id", "nome", "aliases")
    return dim, aliases


def _dirty(spark, sf_dir) -> DataFrame:
    k = F.col("s_nationkey").cast("string")
    name = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("  Nátion_"), k, F.lit(" "))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("ANTIGA  NAÇÃO "), k)).otherwise("sem lugar")
    code = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("c"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("codigo"), text.normalize_text(name).alias("norm_input"))


def _matched(spark, sf_dir) -> DataFrame:
    dim, aliases = _nations(spark, sf_dir)
    return territory.match(_dirty(spark, sf_dir), dim, aliases, "id", "code", "norm_nome", "norm_input", "codigo", fuzzy=False)


_TIERS = """WITH m AS (SELECT s_suppkey, s_suppkey % 4 AS r, CAST(s_nationkey AS VARCHAR) AS k, n_nationkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN r < 3 AND n_nationkey IS NOT NULL THEN k END AS id,
CASE WHEN n_nationkey IS NULL OR r = 3 THEN 'manual_review' WHEN r = 0 THEN 'exact_code' WHEN r = 1 THEN 'exact_name' ELSE 'historical_alias' END AS join_method,
CAST(CASE WHEN n_nationkey IS NULL OR r = 3 THEN 0.0 WHEN r = 2 THEN 0.99 ELSE 1.0 END AS DOUBLE) AS join_confidence,
CASE WHEN n_nationkey IS NULL OR r = 3 THEN 'manual_review' ELSE 'matched' END AS join_status FROM m"""


@register(_TIERS)
def exact_match_tiers(spark, sf_dir):
    return _matched(spark, sf_dir).select("s_suppkey", "id", "join_method", "join_confidence", "join_status")


@register(f"SELECT count(*) AS n, avg(CASE WHEN join_status = 'matched' THEN 1.0 ELSE 0.0 END) AS join_success, avg(CASE WHEN id IS NULL THEN 1.0 ELSE 0.0 END) AS null_critical FROM ({_TIERS})")
def quality_rates(spark, sf_dir):
    return quality.quality_rates(_matched(spark, sf_dir), ["s_suppkey", "id"])


_SPELLINGS = ["left(n, length(n) - 1)", "substr(n, 2)", "replace(n, 't', 'tt')", "replace(n, '_', ' ')", "reverse(n)", "concat('nacao', substr(n, 7))"]

# the ratio of Ratcliff and Obershelp: the longest common block (the first in the name, then in the alias, of equals),
# then the same to its left and to its right
_FUZZY = f"""WITH RECURSIVE dim AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(n_name) AS n FROM nation),
names AS (SELECT id AS own, k, norm FROM (SELECT id, unnest([{', '.join(_SPELLINGS)}]) AS norm, unnest(range({len(_SPELLINGS)})) AS k FROM dim)),
pairs AS (SELECT row_number() OVER () AS p, norm, id, n AS alias, length(norm) + length(n) AS total FROM (SELECT DISTINCT norm FROM names) CROSS JOIN dim),
seg(p, a, b, m, step, side) AS (
SELECT p, norm, alias, 0, 0, 0 FROM pairs UNION ALL
SELECT p, CASE s.side WHEN 1 THEN left(a, i - 1) ELSE substr(a, i + k) END, CASE s.side WHEN 1 THEN left(b, j - 1) ELSE substr(b, j + k) END, CASE s.side WHEN 1 THEN k ELSE 0 END, step + 1, s.side FROM (
SELECT p, a, b, step, side AS was, i, j, k FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM seg WHERE a <> '' AND b <> ''), LATERAL (SELECT unnest(range(1, length(b) + 1)) AS j), LATERAL (SELECT unnest(range(1, least(length(a) - i, length(b) - j) + 2)) AS k)
WHERE substr(a, i, k) = substr(b, j, k) QUALIFY row_number() OVER (PARTITION BY p, a, b, step, was ORDER BY k DESC, i, j) = 1), (VALUES (1), (2)) s(side)),
scored AS (SELECT p, norm, id, alias, round(CASE WHEN total = 0 THEN 1.0 ELSE 2.0 * sum(m) / total END, 6) AS score FROM pairs JOIN seg USING (p) GROUP BY p, norm, id, alias, total),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, alias, id) AS r FROM scored),
best AS (SELECT norm, max(score) FILTER (r = 1) AS one, coalesce(max(score) FILTER (r = 2), 0) AS two, max(id) FILTER (r = 1) AS id, string_agg(id || ':' || score, ' ' ORDER BY r) FILTER (r <= 3) AS shown FROM ranked GROUP BY norm),
exact AS (SELECT n, min(id) AS id FROM dim GROUP BY n HAVING count(*) = 1)
SELECT own, CAST(k AS INTEGER) AS k, norm AS norm_input, coalesce(e.id, CASE WHEN one >= 0.9 AND one - two >= 0.03 THEN b.id END) AS id,
CASE WHEN e.id IS NOT NULL THEN 'exact_name' WHEN one >= 0.9 AND one - two >= 0.03 THEN 'fuzzy_score' ELSE 'manual_review' END AS join_method,
CAST(CASE WHEN e.id IS NOT NULL THEN 1.0 WHEN one >= 0.9 AND one - two >= 0.03 THEN one ELSE 0.0 END AS DOUBLE) AS join_confidence, CASE WHEN e.id IS NULL THEN shown END AS shown
FROM names JOIN best b USING (norm) LEFT JOIN exact e ON e.n = norm"""


@register(_FUZZY)
def fuzzy_match(spark, sf_dir):
    """Spellings of the nations against their names, with the candidates that people see."""
    dim, aliases = _nations(spark, sf_dir)
    aliases = aliases.join(dim.select("id", "norm_nome"), "id").where("alias_norm = norm_nome").drop("norm_nome")
    names = dim.select(F.col("id").alias("own"), F.col("norm_nome").alias("n")).select("own", F.posexplode(F.array(*map(F.expr, _SPELLINGS))).alias("k", "norm_input"))
    out = territory.match(names, dim, aliases, "id", "code", "norm_nome", "norm_input")
    seen = F.from_json("match_candidates", "array<struct<rank int, id string, alias_norm string, score double>>")
    shown = F.array_join(F.transform(seen, lambda x: F.concat_ws(":", x["id"], x["score"].cast("string"))), " ")
    return out.select("own", "k", "norm_input", "id", "join_method", "join_confidence", shown.alias("shown"))


@register(
    "WITH v AS (SELECT DISTINCT p_name, unnest([p_name, lower(p_name), upper(p_name) || ' ']) AS a FROM part)"
    " SELECT p_name, min(a) AS alias_nome, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) AS alias_norm FROM v GROUP BY p_name, alias_norm"
)
def alias_explode(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return territory.alias_dimension(names.withColumn("al", F.array(F.lower("p_name"), F.concat(F.upper("p_name"), F.lit(" ")))), "p_name", "p_name", "al")


@register(r"SELECT doc_id, lang, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(text.normalize_text(F.coalesce("text", F.lit("")))).alias("norm_md5"))


@register("SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), CAST(greatest(7, length(regexp_replace(c_name, '[^0-9]', '', 'g'))) AS INTEGER), '0') AS ibge7, CAST(c_custkey % 1000 AS INTEGER) AS inteiro FROM customer")
def code_normalize(spark, sf_dir):
    code = F.concat(F.lit("n. "), (F.col("c_custkey") % 1000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_code(F.col("c_name")).alias("ibge7"), text.optional_int(code).alias("inteiro"))


@register(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || ':' || year(o_orderdate) || ':' ||"
    " CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END || ':' || CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '1' END END AS canonical_key FROM orders"
)
def canonical_key(spark, sf_dir):
    skip = lambda n, c: F.when(F.col("o_orderkey") % n != 0, c)
    key = text.canonical_key(F.col("o_custkey").cast("string"), skip(7, F.year("o_orderdate")), skip(3, F.month("o_orderdate")), skip(5, F.lit(1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("canonical_key"))


def _geohash_sql(precision: int = 7) -> str:
    """Bits by halving: bit b of a coordinate is the parity of floor(share * 2**(b+1))."""
    letters = []
    for k in range(precision):
        bits = [(p, f"(CAST(floor({'x' if p % 2 == 0 else 'y'} * pow(2, {p // 2 + 1})) AS BIGINT) % 2) * {16 >> (p - 5 * k)}") for p in range(5 * k, 5 * k + 5)]
        letters.append(f"substr('{geo.ALPHABET}', CAST(1 + {' + '.join(b for _, b in bits)} AS INTEGER), 1)")
    return " || ".join(letters)


@register(f"SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_geohash_sql()} END AS geohash FROM (SELECT c_custkey, (((c_custkey * 37) % 17000) / 100.0 - 85.0 + 90.0) / 180.0 AS y, (((c_custkey * 91) % 35000) / 100.0 - 175.0 + 180.0) / 360.0 AS x FROM customer)")
def geohash(spark, sf_dir):
    lat = F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") * 37 % 17000) / 100.0 - 85.0)
    lon = (F.col("c_custkey") * 91 % 35000) / 100.0 - 175.0
    return table(spark, sf_dir, "customer").select("c_custkey", geo.geohash(lat, lon).alias("geohash"))


_CALENDAR = """WITH y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders),
days AS (SELECT CAST(unnest(generate_series(make_date(a, 1, 1), make_date(b, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d, b FROM y),
e AS (SELECT d, b, make_date(year(d), 1, 1) AS opening, make_date(year(d), 10, 1) + CAST((7 - isodow(make_date(year(d), 10, 1))) % 7 AS INTEGER) AS election FROM days),
c AS (SELECT *, election - 45 AS campaign, year(d) < b AS past, d < election - 45 AS before, d BETWEEN election - 45 AND election AS during FROM e)
SELECT strftime(d, '%Y%m%d') AS tempo_id, strftime(d, '%Y-%m-%d') AS data, CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes, CAST(day(d) AS INTEGER) AS dia,
CAST(week(d) AS INTEGER) AS semana_iso, isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS ano_semana_iso, CAST(isodow(d) AS INTEGER) AS dia_semana,
(['segunda','terca','quarta','quinta','sexta','sabado','domingo'])[isodow(d)] AS nome_dia_semana, CAST(quarter(d) AS INTEGER) AS trimestre, CAST(year(d) AS INTEGER) AS ciclo_eleitoral,
CASE WHEN past THEN 'historico_eleitoral' WHEN during THEN 'janela_campanha' WHEN before THEN 'pre_campanha' ELSE 'pos_eleicao' END AS fase_calendario,
past AS is_historico_eleitoral, before AND NOT past AS is_pre_campanha, during AND NOT past AS is_janela_campanha, d IN (election, campaign, opening) AS is_evento,
CASE d WHEN election THEN 'eleicao_turno_1' WHEN campaign THEN 'inicio_janela_campanha' WHEN opening THEN 'inicio_pre_campanha' END AS evento,
CASE d WHEN election THEN 'eleitoral_oficial' WHEN campaign THEN 'campanha' WHEN opening THEN 'pre_campanha' END AS tipo_evento,
CASE WHEN d IN (election, campaign, opening) THEN 'alto' WHEN during THEN 'medio' WHEN before THEN 'baixo' ELSE 'base' END AS pulso_midia,
d IN (election, campaign, opening) OR during AS is_pulso_midia, CAST(election - d AS INTEGER) AS dias_ate_eleicao FROM c"""


@register(_CALENDAR)
def dim_calendar(spark, sf_dir):
    first, last = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return calendar.calendar(spark, first, last)


@register(
    "SELECT 'mun:' || r_regionkey || ':0:0' AS territorio_id, 'mun' AS nivel, CAST(r_regionkey AS VARCHAR) AS parte_1, CAST(NULL AS VARCHAR) AS parte_2, CAST(NULL AS VARCHAR) AS parte_3 FROM region"
    " UNION SELECT 'zona:' || n_regionkey || ':' || n_nationkey || ':0', 'zona', CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), NULL FROM nation"
    " UNION SELECT 'secao:' || n_regionkey || ':' || n_nationkey || ':' || c_custkey, 'secao', CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def dim_territory_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    sections = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return territory.territory_dimension([("mun", table(spark, sf_dir, "region"), ["r_regionkey"]), ("zona", nation, ["n_regionkey", "n_nationkey"]), ("secao", sections, ["n_regionkey", "n_nationkey", "c_custkey"])])


# --- windows of cycles, deduplication, aggregates -------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("ano", F.year("o_orderdate"))


_LAST3 = "SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY 1 DESC LIMIT 3"


@register(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN ({_LAST3}) GROUP BY 1")
def cycle_window(spark, sf_dir):
    return relational.cycle_window(_orders(spark, sf_dir), 3).groupBy("ano").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS ano, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")
def best_row_dedup(spark, sf_dir):
    return relational.best_row(_orders(spark, sf_dir), ["o_custkey", "ano"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "ano", "o_orderkey", "o_totalprice")


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def keep_first_dedup(spark, sf_dir):
    order = [F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return relational.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("SELECT c_nationkey, round(avg(o_totalprice), 4) AS ranking_medio, round(avg(c_acctbal), 4) AS indice_medio, count(DISTINCT year(o_orderdate)) AS anos_observados FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def base_metrics(spark, sf_dir):
    rows = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = relational.base_metrics(rows, "c_nationkey", "o_totalprice", "c_acctbal", "ano")
    return out.withColumns({c: F.round(c, 4) for c in ("ranking_medio", "indice_medio")})


@register(
    "WITH t AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"
    " SELECT o_custkey, round(avg(v), 6) AS media, round(stddev_samp(v), 5) AS desvio, count(v) AS observacoes FROM t GROUP BY 1"
)
def trend_mean_std(spark, sf_dir):
    out = relational.trend(_orders(spark, sf_dir).withColumn("mes", F.month("o_orderdate")), "o_custkey", ["ano", "mes"], "o_totalprice")
    return out.withColumns({"media": F.round("media", 6), "desvio": F.round("desvio", 5)})


@register("SELECT p_partkey, (p_size - (SELECT min(p_size) FROM part)) / CAST((SELECT max(p_size) - min(p_size) FROM part) AS DOUBLE) AS size_norm, (p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS price_norm, CAST(0.0 AS DOUBLE) AS constant_norm FROM part")
def minmax_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("one", F.lit(1.0))
    return min_max(rows, size_norm="p_size", price_norm="p_retailprice", constant_norm="one").select("p_partkey", "size_norm", "price_norm", "constant_norm")


# --- marts ----------------------------------------------------------------------------------------------------------


def _fact(spark, sf_dir) -> DataFrame:
    rows = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").cast("string").alias(marts.ID), F.col("o_totalprice").alias("ranking_final"), (F.col("o_totalprice") / 1000).alias("indice_final"), "ano", F.lit(1).alias("turno"))


def _indicators(spark, sf_dir) -> DataFrame:
    """Metrics of nations, stored as a silver table is; those with a key divisible by 5 have none."""
    rows = table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").groupBy(F.col("c_nationkey").cast("string").alias(marts.ID))
    return lake.stored(rows.agg(F.count(F.lit(1)).alias("populacao"), F.avg("c_acctbal").alias("renda"), F.max("c_acctbal").alias("ideb"), F.min("c_acctbal").alias("internet_pct"), F.sum("c_acctbal").alias("urbanizacao"), F.max("c_custkey").cast("double").alias("ipvs"), F.min("c_custkey").cast("double").alias("emprego"), F.avg("c_custkey").alias("indice_saude"), F.count_distinct("c_mktsegment").alias("infraestrutura_urbana"), (F.max("c_custkey") % 7).alias("ruralidade")))


_BASE = f"""fact AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, o_totalprice AS r, o_totalprice / 1000 AS i, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN ({_LAST3})),
base AS (SELECT id, avg(r) AS rm, avg(i) AS im, count(DISTINCT y) AS ao FROM fact GROUP BY id),
label AS (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS l, max(y) AS ym FROM (SELECT DISTINCT y FROM fact)),
ind AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, count(*) AS pop, avg(c_acctbal) AS renda, max(c_acctbal) AS edu, min(c_acctbal) AS net, sum(c_acctbal) AS urb, CAST(max(c_custkey) AS DOUBLE) AS ipvs, CAST(min(c_custkey) AS DOUBLE) AS emp, avg(c_custkey) AS sau, count(DISTINCT c_mktsegment) AS est, max(c_custkey) % 7 AS rur FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1),
j AS (SELECT b.id, rm, im, ao, l, coalesce(pop, 0) AS pop, coalesce(renda, 0) AS renda, coalesce(edu, 0) AS edu, coalesce(net, 0) AS net, coalesce(urb, 0) AS urb, coalesce(ipvs, 0) AS ipvs, coalesce(emp, 0) AS emp, coalesce(sau, 0) AS sau, coalesce(est, 0) AS est, coalesce(rur, 0) AS rur FROM base b LEFT JOIN ind USING (id) CROSS JOIN label),
n AS (SELECT id, rm, im, ao, l, {", ".join(f"coalesce((CAST({c} AS DOUBLE) - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS {c}" for c in "pop renda edu net urb ipvs emp sau est rur".split())} FROM j)"""


@register(
    f"WITH {_BASE} SELECT id AS municipio_id_ibge7, ao AS anos_observados, l AS janela_anos, round(im * (1 + .3 * pop + .2 * renda + .2 * edu + .15 * net + .15 * urb), 5) AS potencial, round(im * (1 + .4 * pop + .3 * renda + .3 * edu), 5) AS potencial_sql,"
    " round(im * (1 + .45 * ipvs + .3 * emp + .25 * sau), 5) AS prioridade, round(.3 * (1 - est) + .25 * rur + .2 * (1 - net) + .15 * (1 - urb) + .1 * (1 - emp), 6) AS custo FROM n"
)
def composite_scores(spark, sf_dir):
    base, metrics = marts.electoral_base(_fact(spark, sf_dir), 3), _indicators(spark, sf_dir)
    score = "potencial_eleitoral_ajustado_social"
    one = marts.potential(base, metrics).select(marts.ID, "anos_observados", "janela_anos", F.round(score, 5).alias("potencial"))
    two = marts.potential(base, metrics, "sql").select(marts.ID, F.round(score, 5).alias("potencial_sql"))
    three = marts.territorial(base, metrics).select(marts.ID, F.round("score_priorizacao_territorial_sp", 5).alias("prioridade"), F.round("custo_mobilizacao_relativo", 6).alias("custo"))
    return one.join(two, marts.ID).join(three, marts.ID)


def _fiscal(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").cast("string").alias(marts.ID), F.year("l_shipdate").alias("ano")).agg(F.round(F.sum("l_extendedprice"), 2).alias("transferencias_total"), F.round(F.sum("l_tax"), 2).alias("emendas"))


@register(
    f"WITH {_BASE}, f AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS t, round(sum(l_tax), 2) AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),"
    " g AS (SELECT id, sum(t) AS t, sum(e) AS e FROM f WHERE y IN (SELECT DISTINCT year(l_shipdate) FROM lineitem ORDER BY 1 DESC LIMIT 3) GROUP BY id)"
    " SELECT id AS municipio_id_ibge7, round(coalesce(t, 0), 2) AS transferencias, round(coalesce(e, 0), 2) AS emendas, round(1e6 * im / (coalesce(t, 0) + coalesce(e, 0) + 1), 6) AS sensibilidade FROM base LEFT JOIN g USING (id)"
)
def fiscal_window_sum(spark, sf_dir):
    out = marts.sensitivity(marts.electoral_base(_fact(spark, sf_dir), 3), _fiscal(spark, sf_dir), 3)
    return out.select(marts.ID, F.round("transferencias_3ciclos", 2).alias("transferencias"), F.round("emendas_3ciclos", 2).alias("emendas"), F.round(F.col("sensibilidade_investimento_publico") * 1e6, 6).alias("sensibilidade"))


@register(
    f"WITH {_BASE} SELECT id AS municipio_id_ibge7, id || ':' || ym || ':00:0' AS canonical_key, round(rm, 4) AS ranking_medio_3ciclos, round(im * (1 + .3 * pop + .2 * renda + .2 * edu + .15 * net + .15 * urb), 5) AS potencial_eleitoral_ajustado_social,"
    " round(im * (1 + .45 * ipvs + .3 * emp + .25 * sau), 5) AS score_priorizacao_territorial_sp, l AS janela_anos, CAST(ym AS INTEGER) AS ano, 0 AS turno FROM (SELECT n.*, ym FROM n CROSS JOIN label)"
)
def query_cache(spark, sf_dir):
    """The marts that questions are served from, joined, and cut to the columns that serving may show."""
    base, metrics = marts.electoral_base(_fact(spark, sf_dir), 3), _indicators(spark, sf_dir)
    fiscal = base.select(marts.ID).withColumns({"transferencias": F.lit(None).cast("double"), "emendas": F.lit(None).cast("double")})
    whole = marts.cache(marts.municipal(base, metrics.select(marts.ID, "ruralidade")), marts.potential(base, metrics), marts.territorial(base, metrics), marts.sensitivity(base, fiscal, 3))
    served, _ = quality.for_purpose(whole, "serving_cache", "salt")
    return served.drop("indice_medio_3ciclos", "ranking_final", "sensibilidade_investimento_publico").withColumns({"ranking_medio_3ciclos": F.round("ranking_medio_3ciclos", 4), **{c: F.round(c, 5) for c in ("potencial_eleitoral_ajustado_social", "score_priorizacao_territorial_sp")}})


# --- clusters, allocation, ranking ----------------------------------------------------------------------------------

_CLUSTER_SQL = "CASE WHEN {a} > 70 AND {b} > 70 THEN 'Diamante' WHEN {b} > 70 THEN 'Alavanca' WHEN {a} > 70 THEN 'Consolidação' ELSE 'Descarte' END"


@register("SELECT p_partkey, " + _CLUSTER_SQL.format(a="(p_size * 2)", b="coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 100 END, 0)") + " AS cluster FROM part")
def cluster_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    vs = F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey") % 100)
    return rows.select("p_partkey", allocation.cluster(F.col("p_size") * 2, vs).alias("cluster"))


def _towns(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    return rows.select((k + 1).alias("ranking_final"), F.col("c_name").alias("municipio"), allocation.cluster(k * 13 % 100, k * 29 % 100).alias("cluster"), (k * 7 % 100 + 0.5).alias("indice_final"), F.when(k % 6 != 0, k * 11 % 101).alias("PD_qt"), F.when(k % 4 != 0, k * 977 % 60000).alias("pop_censo2022"))


_TOWNS = "t AS (SELECT c_custkey + 1 AS rf, c_name AS municipio, " + _CLUSTER_SQL.format(a="(c_custkey * 13 % 100)", b="(c_custkey * 29 % 100)") + " AS cluster, c_custkey * 7 % 100 + CAST(0.5 AS DOUBLE) AS idx, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey * 11 % 101 AS DOUBLE) END AS pd, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey * 977 % 60000 AS DOUBLE) END AS po FROM customer)"


@register(
    f"WITH {_TOWNS}, top AS (SELECT * FROM (SELECT * FROM t ORDER BY rf, municipio LIMIT 60) WHERE cluster <> 'Descarte'),"
    " w AS (SELECT *, coalesce(pd, 50.0) AS q, coalesce(po, 50000.0) AS p, idx * CAST(CASE cluster WHEN 'Diamante' THEN 1.0 WHEN 'Alavanca' THEN 0.7 WHEN 'Consolidação' THEN 0.45 ELSE 0.1 END AS DOUBLE) AS pw FROM top),"
    " b AS (SELECT *, least(round_even(pw / sum(pw) OVER () * 1e7, 0), 420000.0) AS budget, least(q / 100.0, 1.0) AS j, CASE WHEN p < 20000 THEN 0.05 ELSE 0.0 END AS bw FROM w),"
    " d AS (SELECT *, round_even(budget * 0.6, 0) AS digital, round_even(budget * (1 - CAST(0.6 AS DOUBLE)), 0) AS offline, greatest(0.40 + (1 - j) * 0.15 - bw, 0.30) AS c1, 0.25 AS c2, 0.10 + j * 0.15 AS c3, 0.10 + (1 - j) * 0.05 + bw AS c4, 0.10 AS c5 FROM b),"
    " e AS (SELECT *, c1 + c2 + c3 + c4 + c5 AS dt FROM d)"
    " SELECT municipio, cluster, rf AS ranking, round_even(idx, 1) AS indice, round_even(q, 1) AS \"PD_qt\", CAST(p AS BIGINT) AS pop, budget, digital, offline, round_even(digital * (c1 / dt), 0) AS meta_fb_ig, round_even(digital * (c2 / dt), 0) AS youtube,"
    " round_even(digital * (c3 / dt), 0) AS tiktok, round_even(digital * (c4 / dt), 0) AS whatsapp, round_even(digital * (c5 / dt), 0) AS google_ads, round_even(offline * CAST(CASE WHEN q > 60 THEN 0.55 WHEN q >= 40 THEN 0.40 ELSE 0.25 END AS DOUBLE), 0) AS evento_presencial,"
    " round_even(offline * CAST(CASE WHEN q > 60 THEN 0.30 WHEN q >= 40 THEN 0.35 ELSE 0.45 END AS DOUBLE), 0) AS radio_local, round_even(offline * CAST(CASE WHEN q > 60 THEN 0.15 WHEN q >= 40 THEN 0.25 ELSE 0.30 END AS DOUBLE), 0) AS impresso FROM e"
)
def allocate_budget(spark, sf_dir):
    return allocation.allocate(_towns(spark, sf_dir), 1e7, "prefeito_pequeno", 60, 0.6)


@register(f"WITH {_TOWNS} SELECT rf AS ranking_final, municipio, cluster, idx AS indice_final FROM t WHERE cluster IN ('Diamante', 'Alavanca') AND contains(upper(municipio), '1') ORDER BY 1, 2")
def ranking_filter(spark, sf_dir):
    return allocation.ranking(_towns(spark, sf_dir), ["Diamante", "Alavanca"], "1").select("ranking_final", "municipio", "cluster", "indice_final")


# --- profiles, contracts, privacy, catalogues -----------------------------------------------------------------------


@register(
    "WITH m AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS a, avg(o_custkey) AS b FROM orders GROUP BY 1), c AS (SELECT * FROM m WHERE y = (SELECT max(y) FROM m)), p AS (SELECT * FROM m WHERE y = (SELECT max(y) - 1 FROM m)),"
    " s AS (SELECT (abs(c.a - p.a) / abs(p.a) + abs(c.b - p.b) / abs(p.b)) / 2 AS d FROM c, p) SELECT round(d, 8) AS drift_score, d >= 0.2 AS drift_alert FROM s"
)
def drift_score(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    last = relational.latest_years(rows, 1)[0]
    out = quality.drift(rows.where(F.col("ano") == last), rows.where(F.col("ano") == last - 1), ["o_totalprice", "o_custkey"])
    return out.withColumn("drift_score", F.round("drift_score", 8))


@register("SELECT 'o_custkey' AS \"column\", count(*) FILTER (o_orderkey % 3 = 0) AS nulls, count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS null_share FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'F') / count(*) FROM orders")
def null_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    return quality.null_profile(rows)


@register("SELECT string_agg(DISTINCT upper(trim(o_orderstatus)), ',' ORDER BY upper(trim(o_orderstatus))) AS ufs, count(DISTINCT o_custkey) AS entidades, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS anos, CAST(min(year(o_orderdate)) AS INTEGER) AS inicio, CAST(max(year(o_orderdate)) AS INTEGER) AS fim FROM orders")
def coverage_profile(spark, sf_dir):
    return quality.coverage(_orders(spark, sf_dir), "o_orderstatus", "o_custkey", "ano")


@register("SELECT event_type AS fonte, round(greatest(0, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 86400.0, 6) AS atraso_dias FROM events GROUP BY 1")
def freshness(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("fonte")).agg(F.max("ts").cast("timestamp").alias("m"))
    return last.select("fonte", F.round(quality.delay_days(F.col("m"), F.lit("2024-02-01 00:00:00").cast("timestamp")), 6).alias("atraso_dias"))


_SOURCES = "s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE 'A' END AS p, (70 + s_suppkey % 31) / 100.0 AS c, s_suppkey * 7 % 150 AS d, s_suppkey % 5 <> 0 AS o, (60 + s_suppkey % 41) / 100.0 AS q FROM supplier)"


@register(
    f"WITH {_SOURCES}, r AS (SELECT *, list_filter([CASE WHEN c < 0.8 THEN 'cobertura municipal abaixo de 80%' END, CASE WHEN d > 120 THEN 'atualizacao muito esparsa (>120 dias)' END, CASE WHEN NOT o THEN 'licenca nao aberta' END, CASE WHEN q < 0.7 THEN 'qualidade de schema abaixo do minimo (0.7)' END,"
    " CASE WHEN p = 'A' AND c < 0.95 THEN 'fonte A requer cobertura >= 95%' END, CASE WHEN p = 'A' AND d > 45 THEN 'fonte A requer atualizacao <= 45 dias' END, CASE WHEN p = 'A' AND q < 0.85 THEN 'fonte A requer schema_quality >= 0.85' END], lambda x: x IS NOT NULL) AS reasons FROM s)"
    " SELECT s_suppkey, round_even(CAST(c AS DOUBLE) * 0.45 + least(1.0, 45.0 / greatest(1.0, CAST(d AS DOUBLE))) * 0.2 + CASE WHEN o THEN 0.2 ELSE 0.0 END + CAST(q AS DOUBLE) * 0.15, 4) AS score, array_to_string(reasons, '; ') AS reasons, CASE WHEN len(reasons) > 0 THEN 'rejected' WHEN p = 'A' THEN 'accepted_a' ELSE 'accepted_b' END AS grupo FROM r"
)
def source_prioritise(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, "B").otherwise("A").alias("prioridade"), ((k % 31 + 70) / 100.0).alias("cobertura_municipal"), (k * 7 % 150).alias("atualizacao_dias"), (k % 5 != 0).alias("licenca_aberta"), ((k % 41 + 60) / 100.0).alias("schema_quality"))
    return quality.prioritized(rows).select("s_suppkey", "score", F.array_join("reasons", "; ").alias("reasons"), F.col("group").alias("grupo"))


@register("SELECT 'value >= 1' AS rule, count(*) AS rows, count(*) FILTER (NOT coalesce(value >= 1, false)) AS violations FROM events UNION ALL SELECT 'known type', count(*), count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup')) FROM events UNION ALL SELECT 'user is given', count(*), count(*) FILTER (user_id % 10 = 0) FROM events")
def contract_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("user", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return quality.violations(rows, {"value >= 1": F.col("value") >= 1, "known type": F.col("event_type").isin("view", "click", "purchase", "signup"), "user is given": quality.required("user")})


@register("SELECT c_custkey AS ranking_final, substr(sha256('sal:' || c_name), 1, 16) AS nome_pessoa, CASE WHEN c_custkey % 4 <> 0 THEN substr(sha256('sal:' || c_mktsegment), 1, 16) END AS email FROM customer")
def lgpd_minimise_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ranking_final"), F.col("c_name").alias("nome_pessoa"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("email"), "c_acctbal")
    out, _ = quality.for_purpose(relational.minimized(rows, ["ranking_final", "nome_pessoa", "email"]), "analysis", "sal")
    return out


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _rag_events(spark, sf_dir) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("value").alias("latency_total_ms"), (F.col("value") * 0.3).alias("latency_vector_ms"), F.when(e != "error", F.col("value") * 0.5).alias("latency_llm_ms"), (e == "error").alias("fallback_any"), (F.col("event_id") % 4 == 0).alias("fallback_vector"), (F.col("event_id") % 9 == 0).alias("fallback_llm"), F.when(F.col("event_id") % 2 == 0, 1.0).alias("recall_at_k"), (F.col("value") / 1000).alias("cost_estimated_usd"))


@register(
    "WITH p AS (SELECT list_sort(list(value)) AS a, list_sort(list(value * 0.3)) AS b, list_sort(list(CASE WHEN event_type <> 'error' THEN value * 0.5 ELSE 0.0 END)) AS c, count(*) AS n, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 END) AS r, avg(value / 1000) AS k, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS x, avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0 END) AS y, avg(CASE WHEN event_id % 9 = 0 THEN 1.0 ELSE 0 END) AS z FROM events)"
    " SELECT n AS queries_total, r AS recall_at_k_avg, round(k, 8) AS cost_per_query_avg_usd, a[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS latency_total_p95_ms, b[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS latency_vector_p95_ms, c[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS latency_llm_p95_ms, x AS fallback_rate_any, y AS fallback_rate_vector, z AS fallback_rate_llm FROM p"
)
def event_metrics(spark, sf_dir):
    return quality.event_snapshot(_rag_events(spark, sf_dir)).withColumn("cost_per_query_avg_usd", F.round("cost_per_query_avg_usd", 8))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END AS recall FROM orders")
def retrieval_recall(spark, sf_dir):
    question = F.concat(F.lit("Quanto custa "), F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderpriority")).otherwise("nada"), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.recall_at_k(question, F.array(F.col("o_orderpriority"), F.lit("Campinas"))).alias("recall"))


@register(
    "WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.query, vec_id AS item, list_sum(list_transform(list_zip(embedding, e), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS distance FROM embeddings, q)"
    " SELECT query, item, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, item) AS INTEGER) AS rank FROM d QUALIFY rank <= 5"
)
def knn_topk(spark, sf_dir):
    """Every row with an id divisible by 100 asks every row."""
    rows = table(spark, sf_dir, "embeddings")
    return search.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@register("SELECT 'mun-' || c_custkey AS id, 'Municipio: ' || c_name || '. Cluster: ' || c_mktsegment || '. Indice final: ' || printf('%.2f', c_acctbal) || '. Ranking: ' || c_custkey || '.' AS document FROM customer")
def knn_documents_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("mun-"), "c_custkey").alias("id"), search.document_text(F.trim("c_name"), F.trim("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey")).alias("document"))


@register("SELECT o_orderstatus AS uf, CAST(year(o_orderdate) AS INTEGER) AS ano, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1, 2")
def partitioned_roundtrip(spark, sf_dir):
    """Written by source, year and state, then one year read back: only its folders are listed and read."""
    folder = lake.scratch(spark, "roundtrip")
    lake.append_partitioned(_orders(spark, sf_dir).withColumn("uf", F.col("o_orderstatus")), folder, "orders", "run", None, "SP")
    rows = spark.read.parquet(folder).where("fonte = 'orders' and ano = 1998")
    return rows.groupBy("uf", "ano").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT r_name AS dominio, string_agg(n_name, ',' ORDER BY n_name) AS assets, CAST(sum(n) AS BIGINT) AS rows_total FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def domain_summary(spark, sf_dir):
    """Nations as the assets of regions, with their rows: a list is as long as a catalogue's domain, not as a table."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    assets = table(spark, sf_dir, "nation").join(rows, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    assets = assets.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return assets.groupBy(F.col("r_name").alias("dominio")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("assets"), F.sum("n").alias("rows_total"))


@register("SELECT fonte, CASE WHEN fonte = 'part' THEN 'loaded_changed' ELSE 'skipped_unchanged' END AS status FROM (VALUES ('part'), ('nation'), ('region')) t(fonte)")
def incremental_skip(spark, sf_dir):
    """Content hashes against a state that knows two of the three sources."""
    found = reduce(DataFrame.unionByName, [lake.content_hash(spark, f"{sf_dir}/{n}.parquet", n) for n in ("part", "nation", "region")])
    return lake.incremental_status(found, found.where("fonte <> 'part'")).select("fonte", "status")


@register("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hora, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_rollup(spark, sf_dir):
    """The event metrics kept up by a stream that takes what is there and stops."""
    return streams.hourly_rollup(spark, f"{sf_dir}/events.parquet")


# --- views, routed questions, reports -------------------------------------------------------------------------------


@register("SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def session_views(spark, sf_dir):
    """Tables registered as views of the session, then asked in SQL."""
    lake.register_views(spark, {f"view_{n}": f"{sf_dir}/{n}.parquet" for n in ("region", "nation")})
    return spark.sql("SELECT r_name, count(*) AS nations FROM view_region JOIN view_nation ON r_regionkey = n_regionkey GROUP BY 1")


def _ask(spark, sf_dir, question: str) -> DataFrame:
    """The query that a question is routed to, over views of the tables that questions may read."""
    k = F.col("c_custkey")
    towns = _towns(spark, sf_dir)
    town = towns.select("ranking_final", "municipio", "cluster")
    views = {
        "municipios": towns,
        "alocacao": towns.select("municipio", "cluster", F.col("ranking_final").alias("ranking"), (F.col("indice_final") * 10).alias("budget"), (F.col("indice_final") * 6).alias("digital"), (F.col("indice_final") * 4).alias("offline")),
        "secoes": table(spark, sf_dir, "customer").select(F.col("c_name").alias("NM_MUNICIPIO"), (k % 7).alias("NR_ZONA"), (k % 50).alias("NR_SECAO"), (k % 300 + 100).alias("eleitores_aptos"), (k % 90).alias("votos_nominais"), (F.col("c_acctbal") + k / 1e6).alias("score_secao"), F.when(k % 3 == 0, "Alta").when(k % 3 == 1, "Média").otherwise("Baixa").alias("prioridade_secao")),
        "mapa_tatico": town.select(F.col("municipio").alias("NM_MUNICIPIO"), "cluster", "ranking_final", F.col("ranking_final").alias("total_secoes"), (F.col("ranking_final") % 11).alias("secoes_alta"), (F.col("ranking_final") % 13).alias("secoes_media"), (F.col("ranking_final") * 1.25).alias("budget_total_mun"), (F.col("ranking_final") * 0.75).alias("custo_por_secao_alta")),
    }
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    return spark.sql(search.routed_sql(spark, question) if " " not in question.strip() else question)


_ROUTED = f"""WITH {_TOWNS}, municipios AS (SELECT rf AS ranking_final, municipio, cluster, idx AS indice_final FROM t),
alocacao AS (SELECT municipio, cluster, rf AS ranking, idx * 10 AS budget, idx * 6 AS digital, idx * 4 AS "offline" FROM t),
secoes AS (SELECT c_name AS "NM_MUNICIPIO", c_custkey % 7 AS "NR_ZONA", c_custkey % 50 AS "NR_SECAO", c_custkey % 300 + 100 AS eleitores_aptos, c_custkey % 90 AS votos_nominais, c_acctbal + c_custkey / 1e6 AS score_secao, CASE c_custkey % 3 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Média' ELSE 'Baixa' END AS prioridade_secao FROM customer),
mapa AS (SELECT municipio AS "NM_MUNICIPIO", cluster, rf AS ranking_final, rf AS total_secoes, rf % 11 AS secoes_alta, rf % 13 AS secoes_media, rf * CAST(1.25 AS DOUBLE) AS budget_total_mun, rf * CAST(0.75 AS DOUBLE) AS custo_por_secao_alta FROM t)
"""


@register(_ROUTED + 'SELECT municipio, cluster, round(budget, 0) AS budget, round(digital, 0) AS digital, round("offline", 0) AS "offline" FROM alocacao ORDER BY ranking LIMIT 15')
def routed_allocation(spark, sf_dir):
    return _ask(spark, sf_dir, "budget")


@register(_ROUTED + 'SELECT "NM_MUNICIPIO", "NR_ZONA", "NR_SECAO", eleitores_aptos, votos_nominais, score_secao, prioridade_secao FROM secoes ORDER BY score_secao DESC LIMIT 15')
def routed_sections(spark, sf_dir):
    return _ask(spark, sf_dir, "campo")


@register(_ROUTED + 'SELECT "NM_MUNICIPIO", cluster, total_secoes, secoes_alta, round(budget_total_mun, 0) AS budget, round(custo_por_secao_alta, 0) AS custo_secao FROM mapa ORDER BY ranking_final LIMIT 15')
def routed_map(spark, sf_dir):
    return _ask(spark, sf_dir, "custo")


@register(_ROUTED + "SELECT cluster, count(*) AS n, round(avg(indice_final), 1) AS indice_medio FROM municipios GROUP BY 1")
def routed_clusters(spark, sf_dir):
    return _ask(spark, sf_dir, "diamante")


@register(_ROUTED + "SELECT round(avg(indice_final), 1) AS media, round(max(indice_final), 1) AS maximo, count(*) AS total, CAST(sum(CASE WHEN cluster = 'Diamante' THEN 1 ELSE 0 END) AS BIGINT) AS diamante FROM municipios")
def routed_statistics(spark, sf_dir):
    return _ask(spark, sf_dir, "estatística")


@register(_ROUTED + "SELECT municipio, cluster, round(indice_final, 1) AS indice, ranking_final FROM municipios ORDER BY ranking_final LIMIT 15")
def routed_default(spark, sf_dir):
    return _ask(spark, sf_dir, "melhores")


@register(_ROUTED + 'SELECT "NM_MUNICIPIO" AS "município", cluster, total_secoes AS "seções", secoes_alta AS alta, secoes_media AS "média", round(budget_total_mun, 0) AS budget, round(custo_por_secao_alta, 0) AS "R_secao_alta" FROM mapa')
def tactical_map(spark, sf_dir):
    return _ask(spark, sf_dir, search.TACTICAL_MAP)


@register(_ROUTED + """SELECT "NM_MUNICIPIO", "NR_ZONA", "NR_SECAO", score_secao, prioridade_secao FROM secoes WHERE prioridade_secao = 'Alta' ORDER BY score_secao DESC LIMIT 30""")
def urgent_sections(spark, sf_dir):
    return _ask(spark, sf_dir, search.URGENT_SECTIONS)


@register("SELECT sum(c_custkey) AS soma, round(avg(c_acctbal), 4) AS media, min(c_acctbal) AS minimo, max(c_acctbal) AS maximo, count(*) FILTER (c_mktsegment = 'BUILDING') AS n, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS media_grupo FROM customer")
def metric_cards(spark, sf_dir):
    group = F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf_dir, "customer").agg(F.sum("c_custkey").alias("soma"), F.round(F.avg("c_acctbal"), 4).alias("media"), F.min("c_acctbal").alias("minimo"), F.max("c_acctbal").alias("maximo"), F.count_if(group).alias("n"), F.round(F.avg(F.when(group, F.col("c_acctbal"))), 4).alias("media_grupo"))


# --- loads ----------------------------------------------------------------------------------------------------------


@register("SELECT * FROM (VALUES ('c_custkey', 0, 'bigint'), ('c_name', 1, 'string'), ('c_nationkey', 2, 'int'), ('c_acctbal', 3, 'double'), ('c_mktsegment', 4, 'string')) t(\"column\", position, type)")
def schema_profile(spark, sf_dir):
    return quality.schema_profile(table(spark, sf_dir, "customer"))


def _load(spark, sf_dir) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return rows.select(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.lower("o_orderstatus"))).alias("uf"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("codigo_ibge"), F.when(F.col("o_orderkey") % 11 != 0, F.col("ano")).alias("ano"), (F.month("o_orderdate") % 2 + 1).alias("turno"))


@register(
    "WITH r AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS uf, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS ano, month(o_orderdate) % 2 + 1 AS turno FROM orders)"
    " SELECT count(*) AS rows, 4 AS columns, round(100.0 * (count(*) * 2 - count(uf) - count(ano)) / (4 * count(*)), 3) AS null_pct, string_agg(DISTINCT uf, ',' ORDER BY uf) AS ufs, count(DISTINCT c) AS municipios_cobertos, CAST(min(ano) AS INTEGER) AS inicio, CAST(max(ano) AS INTEGER) AS fim,"
    " string_agg(DISTINCT CAST(ano AS VARCHAR), ',' ORDER BY CAST(ano AS VARCHAR)) AS ano, string_agg(DISTINCT CAST(turno AS VARCHAR), ',' ORDER BY CAST(turno AS VARCHAR)) AS turno, 'municipio' AS granularidade, 'ok' AS status FROM r"
)
def load_manifest(spark, sf_dir):
    """What the manifest of a load says of its rows."""
    out = quality.load_profile(_load(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("ufs", "ano", "turno")})


@register("SELECT c_custkey AS \"c_custkey\", c_name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS codigo FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Written as CSV and read back by its suffix: every column a string, so that codes keep their zeros."""
    folder = lake.scratch(spark, "csv") + ".csv"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("codigo")).write.option("header", True).csv(folder)
    return lake.read_any(spark, folder).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@register("SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0")
def jsonl_tolerant(spark, sf_dir):
    """Lines of JSON of which every fifth is cut short; readers leave these out."""
    folder = lake.scratch(spark, "events") + ".jsonl"
    line = F.to_json(F.struct("event_id", "event_type"))
    cut = F.when(F.col("event_id") % 5 == 0, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    table(spark, sf_dir, "events").withColumn("line", line).select(cut.alias("value")).write.text(folder)
    return lake.read_any(spark, folder).select("event_id", "event_type")


@register("SELECT n_name AS dataset_name, 'v' || CAST(2 AS VARCHAR) AS dataset_version FROM nation")
def latest_versions(spark, sf_dir):
    """The newest entry of each dataset of a catalogue, which is appended to."""
    catalog = lake.scratch(spark, "catalog") + ".jsonl"
    for k in (0, 2, 1):
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset_name"), F.lit(f"v{k}").alias("dataset_version"), F.lit(f"2024-01-0{k + 1}T00:00:00").alias("timestamp_utc")).write.mode("append").json(catalog)
    return lake.latest_versions(spark, catalog).select("dataset_name", "dataset_version")


@register("SELECT c_custkey, c_name, c_acctbal FROM customer")
def serving_table(spark, sf_dir):
    """A mart as a table: bucketed and sorted by its key, analysed, and read back by name."""
    name = f"serving_{uuid.uuid4().hex[:12]}"
    lake.serve(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), name, "c_custkey", path=lake.scratch(spark, "serving"))
    return spark.table(name)


@register("SELECT * FROM (VALUES ('view_nation'), ('view_region')) t(name)")
def table_names(spark, sf_dir):
    """The catalogue's tables, of which those that were registered here are asked for."""
    lake.register_views(spark, {f"view_{n}": f"{sf_dir}/{n}.parquet" for n in ("region", "nation", "lost")})
    return spark.sql("SHOW TABLES LIKE 'view_*'").where("isTemporary").select(F.col("tableName").alias("name"))


@register("SELECT r_name AS nome, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def manifest_roundtrip(spark, sf_dir):
    """A manifest written as JSON and read back."""
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").count()
    path = lake.scratch(spark, "manifest") + "/_manifest.json"
    lake.write_json(spark, path, {"parts": {r.r_name: r["count"] for r in rows.collect()}})
    return spark.createDataFrame(list(lake.read_json(spark, path)["parts"].items()), "nome string, n long")


@register(f"WITH {_TOWNS} SELECT rf AS ranking_final, municipio, cluster, idx AS indice_final, pd AS \"PD_qt\", CAST(po AS BIGINT) AS pop_censo2022, CAST(NULL AS DOUBLE) AS ise_qt, CAST(NULL AS VARCHAR) AS perfil_economico FROM t")
def published_towns(spark, sf_dir):
    """Towns as a run publishes them: clusters from their scores and every column of the contract."""
    source = lake.scratch(spark, "towns")
    lake.publish(_towns(spark, sf_dir).drop("cluster").withColumns({"score_territorial_qt": (F.col("ranking_final") - 1) * 13 % 100, "VS_qt": (F.col("ranking_final") - 1) * 29 % 100}), source)
    done = jobs.publish_towns(spark, source, lake.scratch(spark, "out"), "v1")
    rows = spark.read.parquet(done["path"])
    return rows.select("ranking_final", "municipio", "cluster", "indice_final", F.col("PD_qt").cast("double").alias("PD_qt"), F.col("pop_censo2022").cast("long").alias("pop_censo2022"), "ise_qt", "perfil_economico")


@register(f"WITH {_TOWNS} SELECT rf AS ranking_final, substr(sha256('sal:' || municipio), 1, 16) AS municipio, cluster, idx AS indice_final FROM t")
def export_masked(spark, sf_dir):
    """A dataset exported with fewer columns and masked names, as one file in a store."""
    gold, store = lake.scratch(spark, "gold"), lake.scratch(spark, "store")
    lake.publish(_towns(spark, sf_dir).withColumn("segredo", F.lit("x")), f"{gold}/towns")
    done = jobs.export(spark, f"{gold}/towns", f"{lake.scratch(spark, 'export')}/towns", "sal", anonymize=True, gold=[gold], store=store)
    return spark.read.parquet(done["artifact"]).select("ranking_final", "municipio", "cluster", "indice_final")


@register("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS actor, 'list' AS action FROM nation ORDER BY 1 DESC LIMIT 10")
def audit_trail(spark, sf_dir):
    """The last ten entries of an audit trail."""
    store = stores.JobStore(":memory:")
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator():
        store.log(r.n_name, "list", {"key": r.n_nationkey})
    return spark.createDataFrame([row[:3] for row in store.last(10)], "id long, actor string, action string")


# --- reconciled tables ----------------------------------------------------------------------------------------------


def _mapping(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat((key + 70000).cast("string"), F.lit(".0")).alias("codigo_tse"), (key + 3500000).cast("string").alias("codigo_ibge"), F.col("n_name").alias("nome_municipio"), F.concat(F.lit("Antiga Nação "), key.cast("string"), F.lit("; ;Velha "), key.cast("string")).alias("aliases"), F.lit("sp").alias("uf"), F.when(key % 4 != 0, (key - 23.5).cast("string")).otherwise("?").alias("latitude"), F.lit("-46.6").alias("longitude"))


@register(
    "SELECT CAST(n_nationkey + 3500000 AS VARCHAR) AS municipio_id_ibge7, CAST(n_nationkey + 70000 AS VARCHAR) AS codigo_tse, n_name AS nome_municipio, lower(n_name) AS municipio_norm, 'Antiga Nação ' || n_nationkey || ',Velha ' || n_nationkey AS aliases, 'SP' AS uf,"
    " CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS DOUBLE) - 23.5 END AS latitude FROM nation"
)
def municipality_dimension(spark, sf_dir):
    dim = medallion.municipality_dimension(_mapping(spark, sf_dir))
    return dim.select(marts.ID, "codigo_tse", "nome_municipio", "municipio_norm", F.array_join("aliases", ",").alias("aliases"), "uf", "latitude")


def _reconciled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    dim = lake.stored(medallion.municipality_dimension(_mapping(spark, sf_dir)))
    return dim, lake.stored(territory.alias_dimension(dim, marts.ID, "nome_municipio", "aliases"))


@register(
    "WITH r AS (SELECT c_nationkey AS k, c_custkey AS c, c_acctbal AS v, 2020 + 2 * (c_custkey % 3) AS ano, c_custkey % 2 + 1 AS turno FROM customer WHERE c_custkey % 10 <> 9)"
    " SELECT CAST(k + 3500000 AS VARCHAR) || ':' || ano || ':00:' || turno AS canonical_key, CAST(k + 3500000 AS VARCHAR) AS municipio_id_ibge7, 'NATION_' || k AS nome_municipio, CAST(c AS DOUBLE) AS ranking_final, v AS indice_final,"
    " CASE WHEN c % 10 < 3 THEN 'exact_code' WHEN c % 10 < 6 THEN 'exact_name' ELSE 'historical_alias' END AS join_method FROM r QUALIFY row_number() OVER (PARTITION BY k, ano, turno ORDER BY v DESC NULLS LAST, c) = 1"
)
def municipality_fact(spark, sf_dir):
    """Results of towns by code, name or old name, the best row of each key; the other rows are left for review."""
    dim, aliases = _reconciled(spark, sf_dir)
    c, k = F.col("c_custkey"), F.col("c_nationkey")
    name = F.when(c % 10 < 3, "sem nome").when(c % 10 < 6, F.concat(F.lit(" Nátion_"), k)).when(c % 10 < 9, F.concat(F.lit("VELHA  "), k)).otherwise("lugar nenhum")
    base = table(spark, sf_dir, "customer").select(name.alias("municipio"), F.when(c % 10 < 3, (k + 70000).cast("string")).alias("codigo_tse"), c.alias("ranking_final"), F.col("c_acctbal").alias("indice_final"), (c % 3 * 2 + 2020).alias("ano"), (c % 2 + 1).alias("turno"))
    fact, _ = medallion.municipality_fact(base, dim, aliases, medallion.Inputs({}))
    return fact.select("canonical_key", marts.ID, "nome_municipio", "ranking_final", "indice_final", "join_method")


@register(
    "WITH r AS (SELECT CAST(c_nationkey + 3500000 AS VARCHAR) AS id, 2024 AS ano, 1 AS turno, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_custkey % 7 END AS zona, c_custkey % 40 AS secao, c_acctbal AS v FROM customer)"
    " SELECT id AS municipio_id_ibge7, ano, turno, CAST(zona AS INTEGER) AS zona, CAST(secao AS INTEGER) AS secao, max(v) AS votos_validos FROM r GROUP BY ALL"
)
def section_fact(spark, sf_dir):
    dim, aliases = _reconciled(spark, sf_dir)
    c = F.col("c_custkey")
    sections = table(spark, sf_dir, "customer").select(F.concat(F.lit("velha "), "c_nationkey").alias("municipio"), F.when(c % 6 != 0, (c % 7).cast("string")).otherwise("x").alias("zona"), (c % 40).alias("secao"), F.col("c_acctbal").alias("votos"), F.lit("2024").alias("ano"))
    return medallion.section_fact(sections, aliases, medallion.Inputs({})).select(marts.ID, "ano", "turno", "zona", "secao", "votos_validos")


@register("SELECT CAST(c_nationkey + 3500000 AS VARCHAR) AS municipio_id_ibge7, CAST(min(c_custkey) AS BIGINT) AS c_custkey, '2022,2024' AS janela_anos FROM customer GROUP BY 1")
def context_distinct(spark, sf_dir):
    """One row of indicators for each town, with the label of the cycles."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 3500000).alias("cod_ibge"))
    return marts.context(medallion.context_dimension(rows).select("c_custkey", marts.ID), "2022,2024").select(marts.ID, "c_custkey", "janela_anos")


@register(
    f"WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, year(o_orderdate) AS y, avg(o_totalprice / 1000) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN ({_LAST3}) GROUP BY 1, 2)"
    f" SELECT id AS municipio_id_ibge7, round(avg(v), 5) AS indice_medio_3ciclos, round(stddev_samp(v), 5) AS indice_std_3ciclos, count(v) AS observacoes, (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM ({_LAST3})) AS janela_anos FROM f GROUP BY 1"
)
def trend_from_index(spark, sf_dir):
    """The trend where there are no sections: means of the index by year and turn."""
    out = marts.turn_trend(_fact(spark, sf_dir), None, 3)
    return out.withColumns({c: F.round(c, 5) for c in ("indice_medio_3ciclos", "indice_std_3ciclos")})


@register(
    "WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, 2000 + c_custkey % 4 AS y, c_custkey % 2 AS t, sum(c_acctbal) AS v FROM customer WHERE c_custkey % 4 > 0 GROUP BY ALL)"
    " SELECT id AS municipio_id_ibge7, round(avg(v), 5) AS votos_validos_medio_3ciclos, round(stddev_samp(v), 5) AS votos_validos_std_3ciclos, count(v) AS observacoes, '2001,2002,2003' AS janela_anos FROM f GROUP BY 1"
)
def trend_from_sections(spark, sf_dir):
    c = F.col("c_custkey")
    sections = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias(marts.ID), (c % 4 + 2000).alias("ano"), (c % 2).alias("turno"), F.col("c_acctbal").alias("votos_validos"))
    out = marts.turn_trend(sections, sections, 3)
    return out.withColumns({c: F.round(c, 5) for c in ("votos_validos_medio_3ciclos", "votos_validos_std_3ciclos")})


@register(
    "SELECT nivel, CAST(count(*) AS BIGINT) AS n, CAST(count(uf) AS BIGINT) AS com_uf, '2020-01-01' AS vigencia_inicio, '2024-12-31' AS vigencia_fim FROM (SELECT 'mun' AS nivel, n_nationkey AS a, -1 AS z, -1 AS s, 'SP' AS uf FROM nation"
    " UNION SELECT 'zona', c_nationkey, c_custkey % 7, -1, 'SP' FROM customer WHERE c_custkey % 6 <> 0 UNION SELECT 'secao', c_nationkey, c_custkey % 7, c_custkey % 40, 'SP' FROM customer WHERE c_custkey % 6 <> 0) GROUP BY 1"
)
def territory_rows(spark, sf_dir):
    """Municipalities, zones and sections of the territory dimension, with their validity."""
    dim, aliases = _reconciled(spark, sf_dir)
    c = F.col("c_custkey")
    sections = table(spark, sf_dir, "customer").select(F.concat(F.lit("velha "), "c_nationkey").alias("municipio"), F.when(c % 6 != 0, (c % 7).cast("string")).alias("zona"), (c % 40).alias("secao"), F.lit("2024").alias("ano"))
    rows = medallion.territory_rows(dim, medallion.section_fact(sections, aliases, medallion.Inputs({})), (2020, 2024))
    return rows.groupBy("nivel", "vigencia_inicio", "vigencia_fim").agg(F.count(F.lit(1)).alias("n"), F.count("uf").alias("com_uf"))


@register("SELECT c_custkey, 'low_score' AS reason, 0.0::DOUBLE AS join_confidence FROM customer WHERE c_custkey % 10 = 9")
def review_queue(spark, sf_dir):
    """The rows that no tier matches, for people to decide."""
    dim, aliases = _reconciled(spark, sf_dir)
    c = F.col("c_custkey")
    name = F.when(c % 10 == 9, "lugar nenhum").otherwise(F.concat(F.lit("nation_"), "c_nationkey"))
    rows = territory.match(table(spark, sf_dir, "customer").select("c_custkey", name.alias("norm")), dim, aliases, marts.ID, "codigo_tse", "municipio_norm", "norm", shown=False)
    return territory.review_queue(rows).select("c_custkey", "reason", "join_confidence")


@register("SELECT count(*) AS n, avg(CASE WHEN c_custkey % 10 <> 9 THEN 1.0 ELSE 0.0 END) AS join_rate, 'ok' AS status FROM customer")
def crosswalk_rates(spark, sf_dir):
    """A crosswalk of a table of results to the municipalities, with the rate of matches."""
    base, mapping = lake.scratch(spark, "base"), lake.scratch(spark, "mapping") + ".csv"
    c = F.col("c_custkey")
    name = F.when(c % 10 == 9, "lugar nenhum").otherwise(F.concat(F.lit("Nátion_"), "c_nationkey"))
    lake.publish(table(spark, sf_dir, "customer").select(name.alias("municipio"), c.alias("ranking_final")), base)
    _mapping(spark, sf_dir).write.option("header", True).csv(mapping)
    done = jobs.crosswalk(spark, medallion.Inputs({"base_eleitoral": base, "mapping_tse_ibge": mapping}, year=2024), lake.scratch(spark, "crosswalk"), "v1")
    return spark.createDataFrame([(done["rows"], done["join_rate"], done["status"])], "n long, join_rate double, status string")


@register("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS uf, CAST(NULL AS DOUBLE) AS nota, n_name FROM nation")
def schema_backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return relational.backfilled(rows, {"uf": "string", "nota": "double", "n_name": "string"})


@register("SELECT 'mun-' || (c_custkey + 1) || '-' || substr(md5(c_name), 1, 8) AS id, 'Municipio: ' || c_name || '. Cluster: ' || cluster || '. Indice final: ' || printf('%.2f', CAST(idx AS DOUBLE)) || '. Ranking: ' || (c_custkey + 1) || '.' AS document, CAST(length(c_name) AS DOUBLE) AS first FROM (SELECT c_custkey, c_name, c_custkey * 7 % 100 + 0.5 AS idx, " + _CLUSTER_SQL.format(a="(c_custkey * 13 % 100)", b="(c_custkey * 29 % 100)") + " AS cluster FROM customer)")
def vector_index(spark, sf_dir):
    """The index of embedded documents as a run rebuilds it, here with the length of the name as the only feature."""
    towns, index = lake.scratch(spark, "towns"), lake.scratch(spark, "index")
    lake.publish(_towns(spark, sf_dir), towns)

    def embedder():
        return lambda texts: [[float(t.index(". Cluster") - len("Municipio: "))] for t in texts]

    jobs.reindex(spark, towns, index, embedder)
    return spark.read.parquet(f"{index}/municipios_v2").select("id", "document", F.col("embedding")[0].cast("double").alias("first"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of nations over the last three years, best first."""
    base, metrics = marts.electoral_base(_fact(spark, sf_dir), 3), _indicators(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias(marts.ID), "n_name")
    rows = marts.territorial(base, metrics).join(names, marts.ID, "left")
    return rows.orderBy(F.col("score_priorizacao_territorial_sp").desc(), marts.ID).limit(15)
