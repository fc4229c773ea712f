"""Joining documents with labels, and the fold that is never learned from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.rows import bounded_sample, slices

#: Bytes of text that a fit takes to the driver at most.
MOST_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> tuple[np.ndarray, pa.Array]:
    """(labels, texts) of at most ``most`` labelled documents, and ``most_bytes`` of text, outside the held-out fold.

    Null labels and ids don't count; an id with several labels gets the largest. The labels drawn, those with the
    smallest hashes of their ids, are bounded in number and broadcast, so the documents aren't shuffled. Documents with
    one id are drawn by their texts, equal ones as one.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("label"))
    count, rows = known.count(), docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    share = 1.25 * most / max(1, count)
    while True:
        drawn = known.withColumn("draw", F.xxhash64("doc_id", F.lit("labels")))
        drawn = drawn if share >= 1 else drawn.where(F.col("draw") < int((share - 0.5) * 2**64))
        drawn = F.broadcast(drawn.orderBy("draw").limit(most).drop("draw"))
        some = bounded_sample(rows.join(drawn, "doc_id"), "doc_id", "text", most, most_bytes)
        if share >= 1 or not some.isEmpty():
            table = some.select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")).toArrow()
            table = table.sort_by([("label", "ascending"), ("text", "ascending")]).combine_chunks()
            return table.column("label").to_numpy(), table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
        share *= 1000


def batches(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of the texts, of bounded size."""
    return (part.column(0) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"))
