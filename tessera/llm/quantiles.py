"""Mergeable percentiles with a deterministic rank error: compressed dyadic-tree counts (q-digests).

Values are quantized to a bounded ordered universe of ``2**BITS`` cells: sign, exponent and the first MANTISSA bits
of a double, in the order of the numbers. So there is no range to choose; a cell is 2^-20 of its value wide,
and whole numbers below 2^20 have cells of their own. A digest is a set of rows (keys, node, n). ``node``
numbers a binary tree over the cells: the root is 1, the children of v are 2v and 2v+1, cell c is the leaf
``2**BITS + c``. Each value is counted once, in a node whose range holds its cell. Merging adds the counts
of equal nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import attach
from tessera.sources.tables import materialize

BITS, MANTISSA = 32, 20
_ZERO = 1 << (BITS - 1)  # the cell of 0; cells below are negative


def cell_of(value: Column) -> Column:
    """The cell of a number; magnitudes under the least normal double count as 0, infinities have the outermost cells."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess)
    code = (e + 1023) * (1 << MANTISSA) + F.floor((size / two(e) - 1) * (1 << MANTISSA))
    code = F.when(size < 2.0**-1022, 0).when(size == float("inf"), 2047 << MANTISSA).otherwise(code)
    return F.when(value >= 0, code + _ZERO).otherwise(_ZERO - 1 - code).cast("bigint")


def _size(code: Column) -> Column:
    """The least magnitude of a code; 0 for those of no normal number."""
    e = F.shiftright(code, MANTISSA)
    return F.when(e < 1, 0.0).otherwise(F.pow(F.lit(2.0), e - 1023) * (1 + code.bitwiseAND(F.lit((1 << MANTISSA) - 1)) / (1 << MANTISSA)))


def _edges(cell: Column) -> tuple[Column, Column]:
    """The least and the greatest number of a cell."""
    up, down = cell - _ZERO, _ZERO - 1 - cell
    wide = lambda code: F.when(code == 0, 0.0).otherwise(_size(code + 1))
    return F.when(cell >= _ZERO, _size(up)).otherwise(-wide(down)), F.when(cell >= _ZERO, wide(up)).otherwise(-_size(down))


def leaf_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Digest rows without compression; null and NaN values are not counted. Counts before the shuffle, so repeated values of a hot key cost one row a task."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys, (cell_of(F.col(value)) + (1 << BITS)).alias("node")).agg(F.count("*").alias("n"))


def _squeeze(group: np.ndarray, node: np.ndarray, n: np.ndarray, eps: float, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move light siblings into their parent, bottom up, for all groups of a batch at once."""
    most = np.floor(eps * np.bincount(group, weights=n) / bits).astype(np.int64)
    for _ in range(bits):
        if not (most > 0).any():
            break
        depth_first = np.lexsort((node, group))
        group, node, n = group[depth_first], node[depth_first], n[depth_first]
        level = np.frexp(node.astype(np.float64))[1]  # the place of the highest bit
        deepest = level == bits + 1 - _
        parent = node >> 1
        family = np.where(deepest, parent, node)
        head = np.ones(len(node), bool)
        order = np.lexsort((family, group))
        g, f = group[order], family[order]
        head[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
        at = np.cumsum(head) - 1
        total = np.bincount(at, weights=n[order]).astype(np.int64)[at]
        move = np.empty(len(node), bool)
        move[order] = total <= most[g]
        node = np.where(deepest & move, parent, node)
        order = np.lexsort((node, group))
        group, node, n = group[order], node[order], n[order]
        head = np.ones(len(node), bool)
        head[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
        starts = np.flatnonzero(head)
        group, node, n = group[starts], node[starts], np.add.reduceat(n, starts)
    return group, node, n


def compress(digest: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    """The digest with at most about ``3 * BITS / eps`` rows a key and a rank error of at most ``eps`` times its count.

    A family of siblings and parent that counts at most ``floor(eps * count / BITS)`` together becomes one
    node, level by level from the leaves; every value moves up by at most ``BITS`` such nodes. Keys with
    fewer than ``BITS / eps`` values stay exact and pass by as they are. Groups are bounded by the universe, not by their
    rows, and are handled many at a time in sorted batches.
    """
    digest = materialize(digest.select(*keys, "node", "n"), "digest")
    sizes = digest.groupBy(*keys).agg(F.sum("n").alias("__all"), F.count("*").alias("__rows")).where(F.col("__all") * eps >= BITS)
    large = materialize(sizes.select(*keys, "__rows", F.lit(True).alias("__large")), "large")
    if large.isEmpty():
        return digest
    marked = attach(digest, large, keys, "__rows", "left")
    small = marked.where("__large is null").drop("__large")
    return small.unionByName(materialize(_compressed(marked.where("__large").drop("__large"), keys, eps), "compressed"))


def _compressed(digest: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    schema, bits = digest.select(*keys, "node", "n").schema, BITS
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def finish(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for i in range(width):
                codes = t.column(i).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            node, n = (t.column(width + i).to_numpy() for i in (0, 1))
            g, v, c = _squeeze(group, node, n, eps)
            keyed = t.select(list(range(width))).take(pa.array(heads[g]))
            return pa.Table.from_arrays([*keyed.columns, pa.array(v), pa.array(c)], names=[*keyed.column_names, "node", "n"]).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = [t.column(i)[t.num_rows - 1] for i in range(width)]
            same = np.ones(t.num_rows, bool)
            for i, value in enumerate(last):
                column = t.column(i).combine_chunks()
                codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same &= codes == codes[-1]
            cut = t.num_rows - int(same.sum())
            if cut:
                yield finish(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield finish(rest)

    return digest.select(*keys, "node", "n").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, schema)


def merge(digest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One digest for each (coarser) key: equal nodes are added, as in days into slides."""
    return digest.groupBy(*keys, "node").agg(F.sum("n").alias("n"))


def _ends() -> tuple[Column, Column]:
    """The first and the last cell of a node."""
    shift = F.expr(f"shiftleft(CAST(1 AS BIGINT), {BITS} - (length(bin(node)) - 1))")
    left = F.col("node") * shift - F.lit(1 << BITS)
    return left, left + shift - 1


def bounds(digest: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """For each key ``count`` and, for each named share q, ``{name}_low`` and ``{name}_high``.

    They enclose the q-quantile under every common definition: the lower bound that of the
    ``floor(q (count - 1)) + 1``-th value, the upper bound that of the next.
    """
    left, right = _ends()
    by_right = Window.partitionBy(*keys).orderBy("__r")
    by_left = Window.partitionBy(*keys).orderBy(F.desc("__l"))
    per = digest.withColumns({"__l": left, "__r": right})
    per = per.withColumns({"__up": F.sum("n").over(by_right), "__all": F.sum("n").over(Window.partitionBy(*keys))})
    if digest.where(F.col("node") < 1 << BITS).isEmpty():  # cells only: what lies at or above one is what isn't below it
        before = F.coalesce(F.sum("n").over(by_right.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("__down", F.col("__all") - before)
    else:
        per = per.withColumn("__down", F.sum("n").over(by_left))
    out = [F.max("__all").alias("count")]
    for name, q in shares.items():
        first = F.floor(F.lit(q) * (F.col("__all") - 1)) + 1
        second = F.least(first + 1, F.col("__all"))
        out += [F.max(F.when(F.col("__down") >= F.col("__all") - first + 1, F.col("__l"))).alias(f"__a_{name}"), F.min(F.when(F.col("__up") >= second, F.col("__r"))).alias(f"__b_{name}")]
    cells = per.groupBy(*keys).agg(*out)
    return cells.select(*keys, "count", *[x for name in shares for x in (_edges(F.col(f"__a_{name}"))[0].alias(f"{name}_low"), _edges(F.col(f"__b_{name}"))[1].alias(f"{name}_high"))])


def quantiles(digest: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """For each key ``count`` and one value per named share: that of the cell that the digest gives for rank ``ceil(q count)``.

    The value's true rank is within ``eps`` times the count of the asked one, ``eps`` being that of
    ``compress``; without compression the value is exact to its cell, of which the edge nearer 0 is given.
    """
    _, right = _ends()
    by_right = Window.partitionBy(*keys).orderBy("__r")
    per = digest.withColumn("__r", right).withColumns({"__up": F.sum("n").over(by_right), "__all": F.sum("n").over(Window.partitionBy(*keys))})
    out = [F.max("__all").alias("count")] + [F.min(F.when(F.col("__up") >= F.greatest(F.ceil(F.lit(q) * F.col("__all")), F.lit(1)), F.col("__r"))).alias(name) for name, q in shares.items()]
    cell = lambda c: F.when(c >= _ZERO, _size(c - _ZERO)).otherwise(-_size(_ZERO - 1 - c))
    return per.groupBy(*keys).agg(*out).select(*keys, "count", *[cell(F.col(name)).alias(name) for name in shares])


def settled_medians(rows: DataFrame, brackets: DataFrame, row_keys: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median) of the keys in ``brackets`` (row_keys, keys, low, high, count), exact.

    A digest's bounds of the median are its bracket: values under ``low`` are only counted, those above ``high``
    not looked at, and of those within, a share of ``eps`` and ties, only the distinct ones are sorted.
    ``count`` is the key's number of values; brackets are attached to rows by ``row_keys``. Give brackets materialized.
    """
    v = F.col(value)
    near = attach(rows.where(v.isNotNull() & ~F.isnan(v)), brackets.withColumn("__count", F.col("count")), row_keys, "count").where(v <= F.col("high"))
    names = [c for c in keys if c not in rows.columns]
    at = near.select(*[c for c in keys if c not in names], *names, F.when(v < F.col("low"), F.lit(float("-inf"))).otherwise(v).alias("__v"), "__count")
    counts = at.groupBy(*keys, "__v", "__count").agg(F.count("*").alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v")))
    pick = lambda k: F.min(F.when(F.col("__upto") >= k, F.col("__v")))
    return upto.groupBy(*keys).agg(((pick(F.floor((F.col("__count") - 1) / 2) + 1) + pick(F.floor(F.col("__count") / 2) + 1)) / 2).alias("median"))
