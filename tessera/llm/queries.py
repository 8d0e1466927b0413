"""Queries of the problems tagged llm (3, 4, 6, 7, 8) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import leakage, packing, quantiles, spans, topn
from tessera.operators.joins import attach
from tessera.operators.references import patch_xy
from tessera.sources.tables import materialize, table

TYPES = ("cancer", "immune", "healthy")


def _top_cells(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = patch_xy("patch_id")
    kind = F.lower(F.trim("cell_type"))
    trust = F.lower(F.trim("cell_type_confidence"))
    p = F.coalesce(*[F.when(kind == t, F.nanvl(f"p_final_{t}", F.lit(None))) for t in TYPES])
    cells = (
        table(spark, d, "cell_assignments")
        .select("slide_id", x0.alias("x0"), y0.alias("y0"), kind.alias("cell_type"), F.when(trust == "high", 0).when(trust == "medium", 1).otherwise(2).alias("trust"), p.alias("p"), "cell_id")
        .where(F.col("cell_type").isin(*TYPES) & F.col("x0").isNotNull() & F.col("y0").isNotNull())
    )
    score = 2.0 * (2 - F.col("trust")) + F.coalesce(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)), F.lit(-0.5))
    order = [F.asc("trust"), F.desc_nulls_last("p"), F.asc("cell_id")]
    return topn.top_n(cells, ["slide_id", "x0", "y0", "cell_type"], "cell_id", score, order, 3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The three most trusted cells of each slide, patch and type."""
    return _top_cells(spark, d).select("cell_id").distinct()


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with their groups and ranks."""
    return _top_cells(spark, d).select("slide_id", "x0", "y0", "cell_type", "cell_id", "group_rank")


EPS = 0.01
DAY = ["slide_id", "channel", "taken_on"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channel_values").select("slide_id", "channel_index", F.date_format("taken_at", "yyyy-MM-dd").alias("taken_on"), "intensity")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """(slide_id, channel_index, channel) of each slide's highest revision."""
    top = table(spark, d, "slide_index").groupBy("slide_id").agg(F.max_by("channels", "rev").alias("channels"))
    return top.select("slide_id", F.posexplode("channels").alias("channel_index", "channel"))


def _day_digest(spark: SparkSession, d: str) -> DataFrame:
    leaves = quantiles.leaf_counts(_readings(spark, d), ["slide_id", "channel_index", "taken_on"], "intensity")
    named = quantiles.merge(leaves.join(_places(spark, d), ["slide_id", "channel_index"]), DAY)
    return quantiles.compress(named, DAY, EPS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Days of at least 20 readings whose median is over twice that of all days of the slide and channel.

    The digests' bounds decide all but the days that lie within their error of the limit; for these the
    medians are settled within the digests' brackets.
    """
    half, whole_key = {"m": 0.5}, DAY[:2]
    day = _day_digest(spark, d).repartition(*whole_key)  # one shuffle for days, for all days and for their join
    days = quantiles.bounds(day, DAY, half).where("count >= 20 and taken_on is not null")
    whole = quantiles.bounds(day, whole_key, half).select(*[F.col(c).alias(f"w_{c}") for c in whole_key], F.col("m_low").alias("all_low"), F.col("m_high").alias("all_high"), F.col("count").alias("n_all"))
    near = days.join(whole, [days[c].eqNullSafe(whole[f"w_{c}"]) for c in whole_key]).where("m_high > 2 * all_low")
    near = materialize(near.withColumn("sure", F.col("m_low") > 2 * F.col("all_high")), "near")
    open_days = near.where("not sure").join(_places(spark, d), whole_key)
    brackets = [F.col("m_low").alias("low"), F.col("m_high").alias("high"), "count"]
    of_day = materialize(open_days.select("slide_id", "channel_index", "taken_on", "channel", *brackets), "day_brackets")
    of_all = materialize(open_days.select("slide_id", "channel_index", "channel", F.col("all_low").alias("low"), F.col("all_high").alias("high"), F.col("n_all").alias("count")).distinct(), "brackets")
    rows = _readings(spark, d)
    exact_day = quantiles.settled_medians(rows, of_day, ["slide_id", "channel_index", "taken_on"], DAY, "intensity")
    exact_all = quantiles.settled_medians(rows, of_all, ["slide_id", "channel_index"], whole_key, "intensity").withColumnRenamed("median", "all")
    checked = exact_day.join(exact_all, whole_key).where("median > 2 * all")
    return near.where("sure").select(*DAY).unionByName(checked.select(*DAY))


SHARES = {"p01": 0.01, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def p4_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each slide, channel and day, within 1 % of rank; exact for days of fewer than 3,200 readings."""
    return quantiles.quantiles(_day_digest(spark, d), DAY, SHARES)


def p4_slide_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each slide and channel, merged from the digests of its days; exact where all its days are."""
    return quantiles.quantiles(quantiles.merge(_day_digest(spark, d), DAY[:2]), DAY[:2], SHARES)


def p4_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Groups and readings of each channel, and how many of its percentiles by merged and again compressed digests miss their rank by more than the bound.

    Slides and channels are compressed to 1 % of rank, then merged into channels over all slides; the true ranks are counted from the readings.
    """
    by = ["channel"]
    digest = quantiles.compress(quantiles.merge(_day_digest(spark, d), DAY[:2]), DAY[:2], EPS)
    digest = quantiles.compress(quantiles.merge(digest, by), by, EPS)
    said = materialize(quantiles.quantiles(digest, by, SHARES), "said")
    rows = attach(_readings(spark, d).where("intensity is not null and not isnan(intensity)"), materialize(_places(spark, d).withColumn("w", F.lit(1)), "places"), ["slide_id", "channel_index"], "w")
    values = rows.groupBy(*by, "intensity").agg(F.count("*").alias("n"))
    ranks = values.join(F.broadcast(said), by)  # a row a channel name
    edge = lambda name: (F.sum(F.when(F.col("intensity") < F.col(name), F.col("n")).otherwise(0)), F.sum(F.when(F.col("intensity") <= F.col(name) * (1 + 2.0**-19), F.col("n")).otherwise(0)))
    total = F.sum("n")
    misses = [F.when((edge(n)[0] - 3 * EPS * total - 1 > q * total) | (edge(n)[1] + 3 * EPS * total + 1 < q * total), 1).otherwise(0) for n, q in SHARES.items()]
    return ranks.groupBy(*by).agg(total.alias("n_readings"), sum(misses[1:], misses[0]).alias("n_missed"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split."""
    return packing.packed_documents(_documents(spark, d)).where("n_pieces > 1 and piece = 0").select(F.col("id").alias("doc_id"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, pieces, tokens and filled share of the packing, by number of pieces in a container."""
    packed = packing.packed_documents(_documents(spark, d))
    each = packed.groupBy("container").agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("tokens"), F.count("*").alias("n_pieces"))
    return each.groupBy("n_pieces").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("tokens") / packing.Limits().tokens), 4).alias("filled"))


def p6_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What is packed and into how many containers at least: pieces and tokens, none lost."""
    packed = packing.packed_documents(_documents(spark, d))
    return packed.agg(F.count_distinct("id").alias("n_docs"), F.count("*").alias("n_pieces"), F.sum(F.col("tok_to") - F.col("tok_from")).alias("n_tokens"))


INSTRUCTION = packing.Limits(tokens=2048, segments=4, loss_tokens=1700)


def p6_instructions(spark: SparkSession, d: str) -> DataFrame:
    """The packing under limits of which each binds somewhere: what it carries, whether all limits hold, and which are reached.

    ``tight``: at most 25 % more containers than the scarcest limit asks for.
    """
    packed = packing.packed_documents(_documents(spark, d), INSTRUCTION)
    each = packed.groupBy("container").agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"), F.count_if(F.col("piece") == 0).alias("docs"))
    limits = (("t", INSTRUCTION.tokens), ("s", INSTRUCTION.segments), ("l", INSTRUCTION.loss_tokens))
    within = F.min(F.least(*[(F.col(c) <= most).cast("int") for c, most in limits])) == 1
    reached = [(F.max(c) >= 0.99 * most).alias(f"{name}_bind") for (c, most), name in zip(limits, ("tokens", "segments", "loss"))]
    least = F.greatest(*[F.ceil(F.sum(c) / most) for c, most in limits])
    return each.agg(F.sum("docs").alias("n_docs"), F.sum("s").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.sum("l").alias("n_loss"), within.alias("within"), *reached, (F.count("*") <= F.ceil(least * 1.25)).alias("tight"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.matches(_documents(spark, d), table(spark, d, "eval_items"), "item_id", ["passage", "question"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item's passage or question."""
    return _leaks(spark, d).where("longest_run >= 12").select("doc_id", "item_id").distinct()


def p7_placements(spark: SparkSession, d: str) -> DataFrame:
    """Exact and proximity matches: each placement with its longest run and its words in place."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document that stand in a stretch of 300 found in another document."""
    return spans.shared_characters(_documents(spark, d))


_TOP_SQL = r"""
WITH c AS (SELECT slide_id, cell_id, lower(trim(cell_type)) AS cell_type,
  TRY_CAST(regexp_extract(patch_id, '^\s*([0-9]+)(?:\.0)?_([0-9]+)(?:\.0)?\s*$', 1) AS BIGINT) AS x0,
  TRY_CAST(regexp_extract(patch_id, '^\s*([0-9]+)(?:\.0)?_([0-9]+)(?:\.0)?\s*$', 2) AS BIGINT) AS y0,
  CASE lower(trim(cell_type_confidence)) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS trust,
  CASE lower(trim(cell_type)) WHEN 'cancer' THEN p_final_cancer WHEN 'immune' THEN p_final_immune ELSE p_final_healthy END AS q FROM cell_assignments),
k AS (SELECT *, CASE WHEN isnan(q) THEN NULL ELSE q END AS p FROM c WHERE cell_type IN ('cancer', 'immune', 'healthy') AND x0 IS NOT NULL AND y0 IS NOT NULL),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY slide_id, x0, y0, cell_type, cell_id ORDER BY trust, p DESC NULLS LAST) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY slide_id, x0, y0, cell_type ORDER BY trust, p DESC NULLS LAST, cell_id) AS group_rank FROM o)
"""
_MEDIAN_SQL = """
WITH s AS (SELECT slide_id, channels FROM slide_index QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY rev DESC) = 1),
v AS (SELECT c.slide_id, s.channels[c.channel_index + 1] AS channel, strftime(taken_at, '%Y-%m-%d') AS taken_on, intensity FROM channel_values c JOIN s USING (slide_id)
  WHERE intensity IS NOT NULL AND NOT isnan(intensity) AND channel_index >= 0 AND channel_index < len(channels)),
m AS (SELECT slide_id, channel, taken_on, count(*) AS n, quantile_cont(intensity, 0.5) AS md FROM v GROUP BY ALL),
o AS (SELECT slide_id, channel, quantile_cont(intensity, 0.5) AS mo FROM v GROUP BY ALL)
"""



def _percentile_sql(by: str) -> str:
    picks = ", ".join(f"max(CASE WHEN rn = greatest(ceil({q}::DOUBLE * n), 1) THEN intensity END) AS {name}" for name, q in SHARES.items())
    return _MEDIAN_SQL + f", r AS (SELECT {by}, intensity, row_number() OVER (PARTITION BY {by} ORDER BY intensity) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM v) SELECT {by}, count(*) AS count, {picks} FROM r GROUP BY {by}"


_TOKENS_SQL = r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]+')) AS n FROM documents) "

_LOSS_SQL = r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]+')) AS n, len(regexp_extract_all(CASE WHEN strpos(text, chr(10) || chr(10)) > 0 THEN substr(text, strpos(text, chr(10) || chr(10))) ELSE text END, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]+')) AS l FROM documents) "

_WORDS_SQL = r"list_transform(regexp_extract_all(regexp_replace({0}, '\\[A-Za-z]+', ' ', 'g'), '[A-Za-z0-9]+'), lambda w: lower(w))"
_GRAMS_SQL = "(SELECT DISTINCT {0}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM {1}))"
_LEAK_SQL = (
    f"WITH dw AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), "
    f"iw AS (SELECT item_id, {_WORDS_SQL.format('t')} AS w FROM (SELECT item_id, unnest([passage, question]) AS t FROM eval_items) WHERE t IS NOT NULL AND item_id IS NOT NULL) "
    f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS_SQL.format('doc_id', 'dw')} d JOIN {_GRAMS_SQL.format('item_id', 'iw')} i USING (g)"
)
_SPAN_SQL = (
    "WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL), w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d)), "
    "r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM w JOIN r USING (h)) "
    "SELECT doc_id, sum(least(coalesce(j - i, 300), 300))::INT AS shared_chars FROM s GROUP BY doc_id"
)

QUERIES = {f.__name__: f for f in (p3_found, p3_ranked, p4_found, p4_day_percentiles, p4_slide_percentiles, p4_rank_errors, p6_found, p6_fill, p6_tokens, p6_instructions, p7_found, p7_placements, p8_found)}
ORACLE = {
    "p3_found": _TOP_SQL + "SELECT DISTINCT cell_id FROM r WHERE group_rank <= 3",
    "p3_ranked": _TOP_SQL + "SELECT slide_id, x0, y0, cell_type, cell_id, group_rank FROM r WHERE group_rank <= 3",
    "p4_found": _MEDIAN_SQL + "SELECT slide_id, channel, taken_on FROM m JOIN o USING (slide_id, channel) WHERE n >= 20 AND taken_on IS NOT NULL AND md > 2 * mo",
    "p4_day_percentiles": _percentile_sql("slide_id, channel, taken_on"),
    "p4_slide_percentiles": _percentile_sql("slide_id, channel"),
    "p4_rank_errors": _MEDIAN_SQL + "SELECT channel, count(*) AS n_readings, 0 AS n_missed FROM v GROUP BY channel",
    "p6_found": _TOKENS_SQL + "SELECT doc_id FROM t WHERE n > 2048",
    "p6_instructions": _LOSS_SQL + "SELECT count(*) AS n_docs, sum(CASE WHEN n <= 2048 AND l <= 1700 THEN 1 WHEN l <= 1700 THEN ceil(n / 2048.0) ELSE ceil(n / 1700.0) END)::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens, sum(l)::BIGINT AS n_loss, TRUE AS within, TRUE AS tokens_bind, TRUE AS segments_bind, TRUE AS loss_bind, TRUE AS tight FROM t WHERE n > 0",
    "p7_found": _LEAK_SQL,
    "p8_found": _SPAN_SQL,
    "p6_tokens": _TOKENS_SQL + "SELECT count(*) AS n_docs, sum(ceil(n / 2048.0))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens FROM t WHERE n > 0",
}
