"""Filling containers of fixed capacity with documents: vector bin packing with a dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.sources.tables import materialize


@dataclass(frozen=True)
class Limits:
    """What one container holds at most: tokens, segments (pieces), and loss-bearing tokens (those behind the prompt)."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


def count_tokens(docs: DataFrame, id_col: str, text_col: str, prompt_end: str = "\n\n") -> DataFrame:
    """(id, n_tokens, n_loss): tokens of the word-and-punctuation tokenizer in ASCII over whole texts; null and empty texts have 0.

    The prompt ends at the first ``prompt_end`` (by default an empty line); the tokens behind it bear loss, or all where it is absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, loss = kernels.token_counts(kernels.binary_column(batch.column(1)), prompt_end.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(loss)], names=["id", "n_tokens", "n_loss"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, n_tokens bigint, n_loss bigint")


def pieces(counts: DataFrame, limits: Limits) -> DataFrame:
    """(id, piece, n_pieces, tok_from, tok_to, loss): one piece per item, more only where the item exceeds a container.

    An item beyond the token or the loss limit is cut into equal pieces that keep both, and a rest. Loss lies on the
    last ``n_loss`` tokens of an item. Items without tokens have no piece.
    """
    fits, least = (F.col("n_tokens") <= limits.tokens) & (F.col("n_loss") <= limits.loss_tokens), min(limits.tokens, limits.loss_tokens)
    step = F.when(fits, F.col("n_tokens")).when(F.col("n_loss") <= limits.loss_tokens, limits.tokens).otherwise(least).cast("bigint")
    cut = counts.where("n_tokens > 0").withColumn("step", step)
    each = cut.withColumn("n_pieces", F.ceil(F.col("n_tokens") / F.col("step")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece") * F.col("step")
    stop = F.least(start + F.col("step"), F.col("n_tokens"))
    loss = F.greatest(stop - F.greatest(start, F.col("n_tokens") - F.col("n_loss")), F.lit(0))
    return each.select("id", "piece", "n_pieces", start.alias("tok_from"), stop.alias("tok_to"), loss.alias("loss"))


def _fill(size: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each piece: the open container takes, of the pieces that fit, the one whose sizes point most along what is left."""
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    need = np.stack([size, np.ones(len(size)), loss], 1).astype(float)
    order = np.lexsort((-loss, -size))
    need, share = need[order], (need[order] / caps)
    out, alive, number = np.full(len(size), -1), np.arange(len(size)), 0
    left = caps.copy()
    while len(alive):
        fits = (need[alive] <= left).all(1)
        if fits.any():
            score = np.where(fits, share[alive] @ (left / caps), -1.0)
            at = int(score.argmax())
            out[order[alive[at]]] = number
            left -= need[alive[at]]
            alive = np.delete(alive, at)
        else:
            number, left = number + 1, caps.copy()
    return out


def pack(counts: DataFrame, limits: Limits = Limits(), shard_items: int = 2000) -> DataFrame:
    """Each piece with its ``container`` (shard and number within it); no item is split unless it exceeds a container.

    Pieces are spread over shards of about ``shard_items`` by hash and each shard is packed by itself, so a
    task holds a bounded number of small rows whatever the corpus; the last container of a shard is the
    only one left open for want of pieces. ``counts`` is read twice: give it materialized.
    """
    cut = pieces(counts, limits)
    total = cut.count()
    shards = max(1, -(-total // shard_items))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "piece"], ignore_index=True)
        number = _fill((shard.tok_to - shard.tok_from).to_numpy(), shard.loss.to_numpy(), limits)
        return shard.assign(container=[f"{s}-{n}" for s, n in zip(shard.shard, number)]).drop(columns="shard")

    schema = "id bigint, piece int, n_pieces int, tok_from bigint, tok_to bigint, loss bigint, container string"
    # the rows are small and the work is not: a fixed number of partitions, which Spark doesn't merge by bytes
    tasks = min(shards, max(4 * counts.sparkSession.sparkContext.defaultParallelism, shards // 32))
    return cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards))).repartition(tasks, "shard").groupBy("shard").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The packing of ``docs`` (doc_id, text)."""
    return pack(materialize(count_tokens(docs, "doc_id", "text"), "tokens"), limits)
