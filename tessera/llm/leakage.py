"""Evaluation texts inside a corpus, by a distributed positional inverted index.

Terms are 64-bit hashes of words. Postings are rows (term, doc_id, pos). Evaluation texts are a stated
query set: they are taken in blocks of bounded size, and each block is matched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.texts import documents
from tessera.sources.tables import materialize

#: Bytes of evaluation text in a block: bounds the terms that are sent to the tasks.
BLOCK_BYTES = 4 << 20
KEYS = ["item_id", "field", "version"]
ROW = ["doc_id", "copy"]
_MASK = (1 << 64) - 1


def item_terms(items: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(item_id, field, version, pos, term) of every word of the items' texts; ``version`` tells apart texts of rows that repeat an id."""
    flat = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.explode(F.create_map(*[x for c in text_cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "text")).where("text is not null and item_id is not null").distinct().withColumn("version", F.xxhash64("text")).select("item_id", "field", "version", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fields, versions = (batch.column(i) for i in range(3))
            for index, hashes, pos in kernels.placed_words(kernels.binary_column(batch.column(3))):
                rows = pa.array(index)
                yield pa.RecordBatch.from_arrays([ids.take(rows), fields.take(rows), versions.take(rows), pa.array(pos.astype(np.int32)), pa.array(hashes.view(np.int64))], names=[*KEYS, "pos", "term"])

    return flat.mapInArrow(run, "item_id bigint, field string, version bigint, pos int, term bigint")


def _vocabulary(terms: DataFrame) -> np.ndarray:
    return np.sort(np.array([r[0] for r in terms.select("term").distinct().collect()], np.int64).view(np.uint64))


def _lookup(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(term, n) over the whole corpus for the broadcast terms; counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, hashes, _ in kernels.word_hashes(kernels.binary_column(batch.column(1))):
                at = _lookup(hashes, terms)
                n += np.bincount(at[at >= 0], minlength=len(terms))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(terms[seen].view(np.int64)), pa.array(n[seen])], names=["term", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _pairs(patterns: DataFrame) -> dict[str, np.ndarray]:
    """Patterns as arrays sorted by their first term; a block bounds their number."""
    rows = sorted(((int(a) & _MASK, int(b) & _MASK, int(g)) for a, b, g in patterns.select("a_term", "b_term", "gap").collect()))
    return {n: np.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("a", np.uint64), ("b", np.uint64), ("gap", np.int64)))}


def _holds_pair(hashes: np.ndarray, index: np.ndarray, pairs: dict[str, np.ndarray]) -> np.ndarray:
    """Of texts (index of each word's text, in order) those that hold the two terms of some pattern at its distance."""
    low, high = np.searchsorted(pairs["a"], hashes, "left"), np.searchsorted(pairs["a"], hashes, "right")
    hit = np.flatnonzero(high > low)
    found, times = [], (high - low)[hit]
    ends = np.cumsum(times)
    for a, b in _slices(ends, 1 << 20):
        word = np.repeat(hit[a:b], times[a:b])
        which = np.arange(len(word)) - np.repeat(np.cumsum(times[a:b]) - times[a:b], times[a:b]) + np.repeat(low[hit[a:b]], times[a:b])
        other = word + pairs["gap"][which]
        ok = (other >= 0) & (other < len(hashes))
        word, other, which = word[ok], other[ok], which[ok]
        ok = (hashes[other] == pairs["b"][which]) & (index[other] == index[word])
        found.append(np.unique(index[word[ok]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes, given by their running total, are about ``most`` together, at least one each."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def postings(docs: DataFrame, vocabulary, pairs) -> DataFrame:
    """(term, doc_id, copy, pos) of each occurrence of the broadcast terms in the documents that hold a broadcast pair of terms at its distance.

    ``pos`` counts all words of the document. So a document enters the index only with a chance to match, however
    common a term is. Documents in several pieces are taken whole: their words are gathered first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        for batch in batches:
            ids, copies, texts = batch.column(0), batch.column(1), kernels.binary_column(batch.column(2))
            for index, hashes, pos in kernels.whole_words(texts):
                kept = np.isin(index, _holds_pair(hashes, index, pairs.value))
                hit = np.flatnonzero(kept)
                hit = hit[_lookup(hashes[hit], terms) >= 0]
                row = pa.array(index[hit])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hit].view(np.int64)), ids.take(row), copies.take(row), pa.array(pos[hit].astype(np.int64))], names=["term", *ROW, "pos"])

    return docs.select(*ROW, "text").mapInArrow(run, "term bigint, doc_id bigint, copy bigint, pos bigint")


def _rarest(terms: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(KEYS, a_term, a_pos, b_term, b_pos): the two rarest places of each window of ``words`` words that can occur at all."""
    rated = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(0, words - 1)
    place = F.struct("n", "pos", "term")
    two = F.slice(F.array_sort(F.collect_list(place).over(ahead)), 1, 2)
    windows = rated.select(*KEYS, two.alias("two"), F.count("*").over(ahead).alias("size")).where(F.col("size") == words)
    a, b = F.element_at("two", 1), F.try_element_at("two", F.lit(2))
    b = F.coalesce(b, a)
    return windows.where(a["n"] > 0).select(*KEYS, a["term"].alias("a_term"), a["pos"].alias("a_pos"), b["term"].alias("b_term"), b["pos"].alias("b_pos")).distinct()


NOTHING = "doc_id bigint, item_id bigint, field string, first_word bigint, longest_run bigint, n_matched bigint"


def _block_matches(docs: DataFrame, terms: DataFrame, words: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = _vocabulary(terms)
    if not len(vocabulary):
        return spark.createDataFrame([], NOTHING)
    known = spark.sparkContext.broadcast(vocabulary)
    rare = materialize(_rarest(terms, term_counts(docs, known), words), "rare")
    # what windows have in common: two terms and their distance, each once
    patterns = rare.select("a_term", "b_term", (F.col("b_pos") - F.col("a_pos")).alias("gap")).distinct()
    pairs = _pairs(patterns)
    if not len(pairs["a"]):
        return spark.createDataFrame([], NOTHING)
    index = materialize(postings(docs, known, spark.sparkContext.broadcast(pairs)), "postings")
    # offset-adjusted intersection of the two rarest lists; a block bounds patterns, places and terms, so the lists stay where they are
    pattern = F.broadcast(patterns.withColumnRenamed("a_term", "term"))
    first = index.join(pattern, "term").select(*ROW, F.col("term").alias("a_term"), "pos", "b_term", "gap", (F.col("pos") + F.col("gap")).alias("b_at"))
    second = index.select(*ROW, F.col("term").alias("b_term"), F.col("pos").alias("b_at"))
    met = first.join(second, [*ROW, "b_term", "b_at"], "left_semi")
    places = F.broadcast(rare.select(*KEYS, "a_term", "b_term", "a_pos", (F.col("b_pos") - F.col("a_pos")).alias("gap")))
    placed = materialize(met.join(places, ["a_term", "b_term", "gap"]).select(*ROW, *KEYS, (F.col("pos") - F.col("a_pos")).alias("shift")).distinct(), "placed")
    # the lists of all terms at the places where each text's words would stand
    expected = placed.join(F.broadcast(terms), KEYS).select(*ROW, *KEYS, "shift", "term", F.col("pos").alias("word"), (F.col("shift") + F.col("pos")).alias("pos"))
    matched = expected.join(index, [*ROW, "term", "pos"], "left_semi")
    by = Window.partitionBy(*ROW, *KEYS, "shift").orderBy("word")
    runs = matched.withColumn("run", F.col("word") - F.row_number().over(by)).groupBy(*ROW, *KEYS, "shift", "run").agg(F.count("*").alias("n"))
    return runs.groupBy(*ROW, *KEYS, "shift").agg(F.max("n").alias("longest_run"), F.sum("n").alias("n_matched")).withColumnRenamed("shift", "first_word").drop("version", "copy")


def matches(docs: DataFrame, items: DataFrame, id_col: str, text_cols: list[str], words: int = 12) -> DataFrame:
    """Each placement of an item's text in a document: ``longest_run`` of consecutive words, ``n_matched`` words in place.

    A placement is the document word at which the text's first word would stand. All placements with a run
    of at least ``words`` words are returned (exact phrases); placements whose two rarest terms of some
    window stand right, but that are broken elsewhere, come with a shorter run (proximity matches). Texts
    of fewer words, null texts and null items match nothing; repeated items each match; null and empty
    documents match nothing; different texts under one doc_id are matched each. Every document is read whole,
    twice for a block of items: for the counts of the terms, and for their places.
    """
    docs, terms = documents(docs), item_terms(items, id_col, text_cols)
    size = items.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_cols), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    terms = materialize(terms, "terms")
    found = None
    for block in range(blocks):
        part = _block_matches(docs, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), words)
        found = part if found is None else found.unionByName(part)
    return found
