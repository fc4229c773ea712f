"""A corpus pipeline: quality, near duplicates, secrets, mixing and encoding, each by an operator of ``cartulary.llm``.

Each stage takes all that the one before it kept, as written and read again, and returns the columns of documents; the
last returns tokens. Texts that are null or empty are rows as all others, and so are nulls in any other column and texts
of any length; an empty table stays empty. Other columns of the first table are dropped, whatever their names. Of
near duplicates the smallest id stays, of equal rows one; the classifier judges repeated rows alike; ties in the order of
the mix are broken by hashes. A document without words is not in the mix, as it takes none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import minhash, mixing, piece_codec, quality, secret_scan
from cartulary.sources.lake import discard, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores at 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.train(docs, labels)).where("score >= 0.3").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five words, similarity of 0.8.

    Where ids are repeated, one row of each id and text stays as a document of its own, and the texts of an id are judged
    one by one, in the order of their hashes. Rows without an id all stay.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    rows = rows.groupBy("doc_id", "digest").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    # numbers that grow with the id and the hash: ranges are in order, and so are the rows in each
    rows = stored(rows.orderBy("doc_id", "digest").select(F.monotonically_increasing_id().alias("number"), "doc_id", "row.*"))
    gone = minhash.near_duplicates(rows, "number").where("not kept").select("number").distinct()
    return rows.join(gone, "number", "left_anti").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts; every document stays."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, shuffled in output shards; a document may come up to three times."""
    return mixing.mixed(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each copy."""
    return piece_codec.encode(docs).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: The classifier and the models of secrets are trained, which SQL can't express; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage kept is stored; a stage's table is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return kept
        kept, before = stored(kept), docs
        if k:
            discard(before)
        docs = kept
    return docs
