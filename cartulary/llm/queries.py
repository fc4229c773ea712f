"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from cartulary.llm import embedding_dedup, fingerprints, language_id, minhash, mixing, piece_codec, quality, secret_scan, suffix_dedup, toxicity
from cartulary.llm.rows import documents

QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secret_scan.op1(documents(spark, sf_dir)),
    "op2_suffix_dedup": lambda spark, sf_dir: suffix_dedup.op2(documents(spark, sf_dir)),
    "op3_fingerprints": lambda spark, sf_dir: fingerprints.op3(documents(spark, sf_dir)),
    "op4_embedding_dedup": lambda spark, sf_dir: embedding_dedup.op4(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op5_mixing": lambda spark, sf_dir: mixing.op5(documents(spark, sf_dir)),
    "op6_piece_codec": lambda spark, sf_dir: piece_codec.op6(documents(spark, sf_dir)),
    "op7_language_id": lambda spark, sf_dir: language_id.op7(documents(spark, sf_dir)),
    "op8_toxicity": toxicity.query,
    "op9_minhash": lambda spark, sf_dir: minhash.op9(documents(spark, sf_dir)),
    "op10_quality": quality.query,
}
_REACHED = """both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT b.y, r.c FROM reached r JOIN both_ways b ON b.x = r.id),
component AS (SELECT id, min(c) AS c FROM reached GROUP BY id)"""

_OP4 = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label,
label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound FROM embeddings),
e AS (SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.label = b.label AND a.id < b.id AND a.sound AND b.sound AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
{_REACHED}
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways b WHERE b.x = n.id) AS n_links, c.c AS component_id, c.c = n.id AS kept FROM nodes n JOIN component c USING (id)"""

_OP9 = rf"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
each AS (SELECT id, unnest(s) AS g FROM nodes),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT x, y FROM common JOIN nodes a ON a.id = x JOIN nodes b ON b.id = y WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
{_REACHED}
SELECT n.id AS doc_id, len(n.s) AS n_shingles, c.c AS component_id, c.c = n.id AS kept FROM nodes n JOIN component c USING (id)"""

#: The other queries learn, draw or hash, which SQL can't express; tests hold them to brute force or held-out labels.
ORACLE = {"op4_embedding_dedup": _OP4, "op9_minhash": _OP9}
