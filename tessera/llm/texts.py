"""What the text operators share: documents whose rows may repeat an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text) of rows with an id and a text.

    Where ids are unique ``copy`` is 0; where any row repeats one, it is a hash of the text, so that
    different texts under one id keep their own places and equal rows fall together. Only ids are read to learn that.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    unique = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return named.select("doc_id", (F.lit(0).cast("bigint") if unique else F.xxhash64("text")).alias("copy"), "text")
