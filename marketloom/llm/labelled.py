"""Choice of labelled rows for training, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import staged

#: Bytes of the texts of all training rows together.
BYTES = 12_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def training_rows(docs: DataFrame, labels: DataFrame, target: str, bound: int, folds: int = 5) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled documents outside fold 0.

    They are the first by a hash of their id, so they are spread over everything; one
    that would bring their texts over ``BYTES`` together is passed over. Null labels are
    left out; of repeated ids the largest label and smallest text count. The bounded
    list of ids is broadcast: documents aren't shuffled for it.
    """
    chosen = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
    sizes = sorted(tuple(r) for r in rows.select(F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).collect())
    kept, total = [], 0
    for _, doc_id, size in sizes:
        if total + size <= BYTES:
            total += size
            kept.append((doc_id,))
    if len(kept) == len(sizes):
        return rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")
