"""Exact nearest neighbours, documents of entities, and the keyword router of questions to SQL."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Tables that questions may read. The mart of costs is one of them, since a view of it is served.
TABLES = {"municipios", "alocacao", "secoes", "mapa_tatico", "mart_custo_mobilizacao"}

ITEMS, QUERIES = 1024, 4096  # rows of a block, about


def _nearest_of(k: int, schema: T.StructType):
    """The k nearest items of each query of one block each; sums run in the order of the vector, so equal vectors tie."""

    def find(items: pa.Table, queries: pa.Table) -> pa.Table:
        items = items.take(pc.sort_indices(items.column("item"), null_placement="at_start"))
        out = []
        for size in pc.unique(queries.column("size")).to_pylist() if items.num_rows else []:
            here, asked = items.filter(pc.equal(items.column("size"), size)), queries.filter(pc.equal(queries.column("size"), size))
            if not here.num_rows:
                continue
            x, q = (np.ascontiguousarray(t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, size).T) for t in (here, asked))
            of, near, far = [], [], []
            for at in range(0, asked.num_rows, 64):
                some = q[:, at : at + 64]
                d = np.zeros((some.shape[1], here.num_rows))
                for a, b in zip(x, some):
                    apart = a - b[:, None]
                    apart *= apart
                    d += apart
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.nan)
                for i, row in enumerate(d):
                    best = np.flatnonzero(~(row > last[i]))  # in the order of items
                    best = best[np.argsort(row[best], kind="stable")][:k]
                    of.append(np.full(len(best), at + i))
                    near.append(best)
                    far.append(row[best])
            out.append(pa.table([asked.column("query").take(pa.array(np.concatenate(of))), here.column("item").take(pa.array(np.concatenate(near))), pa.array(np.concatenate(far))], names=schema.names))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return find


def nearest(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int = 5) -> DataFrame:
    """(query, rank, item, distance) of the k nearest items of each query, ties by id.

    Items and queries are dealt into blocks of bounded size by a hash of the row. Each block of queries meets each block
    of items once, where the k best of each query are kept, and a top-k over the blocks' best follows. All distances are
    computed, in double precision. Vectors that are null, hold a null or are of another length have no distance.
    """

    def blocks(rows: DataFrame, name: str, key: str, most: int) -> tuple[DataFrame, int]:
        rows = rows.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("vector"))
        rows = rows.where(F.forall("vector", lambda x: x.isNotNull())).withColumn("size", F.size("vector"))
        count = max(1, -(-rows.count() // most))
        return rows.withColumn(f"{name}_block", F.pmod(F.xxhash64(name, "vector"), F.lit(count))), count

    here, here_count = blocks(items, "item", item_id, ITEMS)
    asked, asked_count = blocks(queries, "query", query_id, QUERIES)
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("item", here.schema["item"].dataType), T.StructField("distance", T.DoubleType())])
    here = here.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(asked_count - 1)).cast("array<long>")))
    asked = asked.withColumn("item_block", F.explode(F.sequence(F.lit(0), F.lit(here_count - 1)).cast("array<long>")))
    pair = ["item_block", "query_block"]
    scored = here.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(_nearest_of(k, schema), schema)
    order = Window.partitionBy("query").orderBy("distance", "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_text(name: Column, cluster: Column, index: Column, ranking: Column) -> Column:
    """The text that is embedded for an entity."""
    return F.format_string("Municipio: %s. Cluster: %s. Indice final: %.2f. Ranking: %d.", name, cluster, index, ranking)


def safe_table(name: str) -> str:
    """The name, if it is an identifier of a table that questions may read."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or name not in TABLES:
        raise ValueError(f"table not allowed: {name!r}")
    return name


# Keywords, the table they need and the query, first match wins.
ROUTES = [
    (("budget", "alocar"), "alocacao", "SELECT municipio, cluster, ROUND(budget, 0) AS budget, ROUND(digital, 0) AS digital, ROUND(offline, 0) AS offline FROM alocacao ORDER BY ranking LIMIT 15"),
    (("seção", "campo", "seções"), "secoes", "SELECT NM_MUNICIPIO, NR_ZONA, NR_SECAO, eleitores_aptos, votos_nominais, score_secao, prioridade_secao FROM secoes ORDER BY score_secao DESC LIMIT 15"),
    (("mapa", "custo"), "mapa_tatico", "SELECT NM_MUNICIPIO, cluster, total_secoes, secoes_alta, ROUND(budget_total_mun, 0) AS budget, ROUND(custo_por_secao_alta, 0) AS custo_secao FROM mapa_tatico ORDER BY ranking_final LIMIT 15"),
    (("cluster", "diamante", "alavanca"), None, "SELECT cluster, COUNT(*) AS n, ROUND(AVG(indice_final), 1) AS indice_medio FROM municipios GROUP BY cluster ORDER BY indice_medio DESC"),
    (("média", "total", "estatística"), None, "SELECT ROUND(AVG(indice_final), 1) AS media, ROUND(MAX(indice_final), 1) AS maximo, COUNT(*) AS total, SUM(CASE WHEN cluster = 'Diamante' THEN 1 ELSE 0 END) AS diamante FROM municipios"),
    ((), None, "SELECT municipio, cluster, ROUND(indice_final, 1) AS indice, ranking_final FROM municipios ORDER BY ranking_final LIMIT 15"),
]


# The tactical map by town, and the urgent sections.
TACTICAL_MAP = "SELECT NM_MUNICIPIO AS `município`, cluster, total_secoes AS `seções`, secoes_alta AS alta, secoes_media AS `média`, ROUND(budget_total_mun, 0) AS budget, ROUND(custo_por_secao_alta, 0) AS R_secao_alta FROM mapa_tatico ORDER BY ranking_final"
URGENT_SECTIONS = "SELECT NM_MUNICIPIO, NR_ZONA, NR_SECAO, score_secao, prioridade_secao FROM secoes WHERE prioridade_secao = 'Alta' ORDER BY score_secao DESC LIMIT 30"


def routed_sql(spark: SparkSession, question: str) -> str:
    """The query that a question's keywords choose among those whose table exists."""
    asked = question.lower()
    for words, table, sql in ROUTES:
        if (not words or any(w in asked for w in words)) and (table is None or spark.catalog.tableExists(safe_table(table))):
            return sql
    raise AssertionError("the last route takes every question")


def routed_rows(spark: SparkSession, question: str, most: int = 50):
    """The rows of a question's query that an answer reads, as a frame on the driver."""
    return spark.sql(routed_sql(spark, question)).limit(most).toPandas()


def without_model(data: str, lines: int = 8) -> str:
    """What is said where no model answers: the first lines of the data."""
    return "\n".join(data.splitlines()[:lines])


def answer(spark: SparkSession, question: str, nearest_names: str = "", complete=None, history: list[dict] = (), lines: int = 8) -> str:
    """The completion for a question, its towns and its data; without a model, or if it fails, the data's first lines."""
    data = routed_rows(spark, question).to_string(index=False)
    if complete is not None:
        try:
            return complete(list(history)[-6:], question, f"Near towns: {nearest_names}\n\n{data}")
        except Exception:  # a failing model must not fail the answer
            pass
    return without_model(data, lines)
