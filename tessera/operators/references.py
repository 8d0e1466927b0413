"""Orphan references, found by as-of matching against contiguous runs of parent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import attach
from tessera.sources.tables import materialize

#: Two non-negative integers joined by ``_``, each perhaps followed by ``.0``; blanks at the ends do not count.
READABLE_PATCH = r"^\s*([0-9]+)(?:\.0)?_([0-9]+)(?:\.0)?\s*$"


def patch_xy(patch_id: str) -> tuple:
    """The two numbers of a readable patch name, else nulls."""
    part = [F.regexp_extract(patch_id, READABLE_PATCH, i).try_cast("bigint") for i in (1, 2)]
    return tuple(part)


def compress_runs(parents: DataFrame, group: Sequence[str], key: str, step: str, payload: Sequence[str]) -> DataFrame:
    """Runs (group, run_start, run_end, run_step, payload) of parent keys that follow each other by ``step``.

    ``parents`` holds each (group, key) once. A run ends where the next key is not one step further or the
    payload changes, so runs never overlap and a step that does not fit costs length, not truth.
    """
    by = Window.partitionBy(*group).orderBy(key)
    same = F.lit(True)
    for c in payload:
        same = same & F.lag(c).over(by).eqNullSafe(F.col(c))
    starts = F.coalesce((F.col(key) - F.lag(key).over(by) != F.col(step)) | ~same, F.lit(True))
    marked = parents.withColumn("__new", starts.cast("int")).withColumn("__run", F.sum("__new").over(by))
    return marked.groupBy(*group, "__run").agg(F.min(key).alias("run_start"), F.max(key).alias("run_end"), F.first(step).alias("run_step"), *[F.first(c).alias(c) for c in payload]).drop("__run")


def asof_runs(refs: DataFrame, runs: DataFrame, group: Sequence[str], key: str, payload: Sequence[str]) -> DataFrame:
    """Each row of ``refs`` with ``in_run`` and the payload of the run that holds its key.

    References and run starts are sorted together; each reference looks at the last run start before or at
    it, and is outside if its key is beyond the run's end or between two steps. ``refs`` must hold distinct
    keys (pre-aggregate first): a key that many rows name is then one row here.
    """
    others = [c for c in refs.columns if c not in (*group, key)]
    run = F.struct(F.col("run_start"), F.col("run_end"), F.col("run_step"), *payload)
    a = refs.select(*group, F.col(key).alias("__key"), F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__one"), *others).alias("__ref"), F.lit(None).cast("int").alias("__none"))
    b = runs.select(*group, F.col("run_start").alias("__key"), F.lit(0).alias("__side"), run.alias("__run"))
    both = a.drop("__none").unionByName(b, allowMissingColumns=True)
    by = Window.partitionBy(*group).orderBy("__key", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("__run", F.last("__run", ignorenulls=True).over(by)).where("__side = 1")
    inside = F.coalesce((F.col("__key") <= F.col("__run.run_end")) & ((F.col("__key") - F.col("__run.run_start")) % F.col("__run.run_step") == 0), F.lit(False))
    return matched.select(*group, F.col("__key").alias(key), *[F.col(f"__ref.{c}").alias(c) for c in others], inside.alias("in_run"), *[F.when(inside, F.col(f"__run.{c}")).alias(c) for c in payload])


def patch_runs(slide_index: DataFrame) -> DataFrame:
    """Runs of y0 by (slide_id, x0), with ``live`` (the highest revision holds it) and ``first_at``.

    Revisions delivered twice count once. A revision whose patches are null or empty still counts as the
    highest: what older ones hold is then deleted. Null coordinates are no patches.
    """
    top = slide_index.groupBy("slide_id").agg(F.max("rev").alias("top_rev"), F.max(F.greatest("stride", F.lit(1))).alias("step"))
    held = slide_index.select("slide_id", "rev", "indexed_at", F.explode("patches").alias("p")).select("slide_id", "rev", "indexed_at", F.col("p.x0").cast("bigint").alias("x0"), F.col("p.y0").cast("bigint").alias("y0"))
    keys = held.where("slide_id is not null and x0 is not null and y0 is not null").groupBy("slide_id", "x0", "y0").agg(F.max("rev").alias("last_rev"), F.min(F.struct("rev", "indexed_at")).alias("f"))
    parents = keys.join(top, "slide_id").select("slide_id", "x0", "y0", F.coalesce("step", F.lit(1)).cast("bigint").alias("step"), (F.col("last_rev") == F.col("top_rev")).alias("live"), F.col("f.indexed_at").alias("first_at"))
    return compress_runs(parents, ["slide_id", "x0"], "y0", "step", ["live", "first_at"])


def orphan_patches(slide_index: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl_name, row_id, loaded_at, orphan_kind) of rows whose patch reference does not hold.

    ``missing``: unreadable, no slide_id, or in no revision of the slide; ``deleted``: not in the highest
    revision; ``late``: first held by a revision indexed after the row was loaded. Null references are no
    references; a null loaded_at is never late. Tables need row_id, slide_id, patch_id and loaded_at; other
    columns are not read. Rows are reduced to one per named patch (with the earliest load) before any
    shuffle, so a patch that many rows name costs one row. The patches with something to report are attached
    to the rows: broadcast while they are few, else hot patches broadcast and the others shuffled.
    """
    rows = None
    for name, df in tables.items():
        x0, y0 = patch_xy("patch_id")
        part = df.where("patch_id is not null").select(F.lit(name).alias("tbl_name"), "row_id", "slide_id", "loaded_at", x0.alias("x0"), y0.alias("y0"))
        rows = part if rows is None else rows.unionByName(part)
    whole = F.col("slide_id").isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull()
    refs = rows.where(whole).groupBy("slide_id", "x0", "y0").agg(F.min("loaded_at").alias("first_load"), F.count("*").alias("n_rows"))
    state = asof_runs(refs, patch_runs(slide_index), ["slide_id", "x0"], "y0", ["live", "first_at"])
    kind = F.when(~F.col("in_run"), "missing").when(~F.col("live"), "deleted").when(F.col("first_at") > F.col("first_load"), "late")
    bad = materialize(state.select("slide_id", "x0", "y0", "first_at", "n_rows", kind.alias("orphan_kind")).where("orphan_kind is not null"), "orphans")
    matched = attach(rows.where(whole), bad, ["slide_id", "x0", "y0"], "n_rows").where((F.col("orphan_kind") != "late") | (F.col("first_at") > F.col("loaded_at")))
    unreadable = rows.where(~whole).select("tbl_name", "row_id", "loaded_at", F.lit("missing").alias("orphan_kind"))
    return matched.select("tbl_name", "row_id", "loaded_at", "orphan_kind").unionByName(unreadable)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans by table, month of ``loaded_at`` and kind; rows without a load time under a null month."""
    return orphans.groupBy("tbl_name", F.date_format("loaded_at", "yyyy-MM").alias("loaded_month"), "orphan_kind").agg(F.count("*").alias("n_rows"))
