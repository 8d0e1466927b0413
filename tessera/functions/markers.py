"""Marker names: normal form, canonical name and candidates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical marker names and their spellings, in lookup order.
SPELLINGS = {
    "Keratin": ("Keratin", "Pan-CK", "PanCK", "Pan CK"),
    "PanCK": ("PanCK", "Pan-CK", "Pan CK", "Keratin"),
    "aSMA": ("aSMA", "SMA", "Aortic smooth muscle actin"),
    "PD1": ("PD1", "PD-1"),
    "Ecadherin": ("Ecadherin", "E-cadherin", "E cadherin"),
    "CD3": ("CD3", "CD3e"),
    "CD3e": ("CD3e", "CD3"),
    "NaKATPase": ("NaKATPase", "Na/K ATPase", "Na-K-ATPase"),
}


def _letters(name: str) -> str:
    return re.sub(r"[\W_]+", "", name).lower()


def _meanings() -> dict[str, str]:
    """Normal form of each spelling to the marker it means: the marker of that very name, else the last that lists it."""
    rows = [(rank == 0, place, _letters(spelling), marker) for place, (marker, all_) in enumerate(SPELLINGS.items()) for rank, spelling in enumerate(all_)]
    return {form: marker for _, _, form, marker in sorted(rows)}


def normal_form(name: Column) -> Column:
    """Letters and digits of a name in lower case; null stays null."""
    return F.lower(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}]", ""))


def canonical_name(name: Column) -> Column:
    """The canonical name of a marker, or the trimmed name itself where none is known."""
    known = F.create_map(*[F.lit(x) for pair in _meanings().items() for x in pair])
    return F.coalesce(F.try_element_at(known, normal_form(name)), F.trim(name))


def by_marker(columns: Sequence[str]) -> dict[str, list[str]]:
    """The columns that hold each canonical marker, in the order of its spellings; others under their own trimmed name."""
    meanings, out = _meanings(), {}
    for c in columns:
        out.setdefault(meanings.get(_letters(c), c.strip()), []).append(c)
    place = {(m, _letters(spelling)): -i for m, all_ in SPELLINGS.items() for i, spelling in reversed(list(enumerate(all_)))}
    return {m: sorted(own, key=lambda c, m=m: -place.get((m, _letters(c)), -99)) for m, own in out.items()}


def marker_value(columns: Sequence[str], marker: str) -> Column:
    """The first number among the columns of a marker, under any of its names; null and NaN become 0, as does a missing column.

    Columns of a marker that its spellings name too (CD3 for CD3e) come after its own.
    """
    held = by_marker(columns)
    wanted = next(iter(by_marker([marker])))
    names = [c for m in dict.fromkeys((wanted, *by_marker(SPELLINGS.get(wanted, ())))) for c in held.get(m, ())]
    return F.coalesce(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in names], F.lit(0.0))


def find_channels(listed: DataFrame, keys: Sequence[str], index: str, name: str, wanted: Sequence[str]) -> DataFrame:
    """(keys, wanted, index, how): for each key the channel of each wanted marker, null where it has none.

    A channel of that name, whatever the case (``exact``), else one that means the same marker (``canonical``), else one
    whose normal form holds the wanted one's (``contains``); the lowest index of equals. Null names are none. ``wanted``
    is a short list: each channel meets it in its own row, and is reduced within its task.
    """
    each = listed.select(*keys, F.col(index).alias("__i"), F.col(name).alias("__n"), F.explode(F.array(*[F.lit(w) for w in wanted])).alias("wanted"))
    exact, same = F.lower(F.trim("__n")) == F.lower("wanted"), canonical_name(F.col("__n")) == canonical_name(F.col("wanted"))
    rank = F.when(exact, 0).when(same, 1).when(F.contains(normal_form(F.col("__n")), normal_form(F.col("wanted"))), 2)
    best = each.groupBy(*keys, "wanted").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "__i"))).alias("b"))
    how = F.when(F.col("b.r") == 0, "exact").when(F.col("b.r") == 1, "canonical").when(F.col("b.r") == 2, "contains")
    return best.select(*keys, "wanted", F.col("b.__i").alias(index), how.alias("how"))


def require_channels(found: DataFrame, listed: DataFrame, index: str, name: str) -> None:
    """ValueError with every wanted marker that some key lacks and every name there is; both are as few as a panel has names."""
    lacking = sorted(r[0] for r in found.where(F.col(index).isNull()).select("wanted").distinct().collect())
    if lacking:
        there = sorted(r[0] for r in listed.select(F.trim(name)).distinct().collect() if r[0])
        raise ValueError(f"no channel for {', '.join(lacking)}; there are {', '.join(there)}")
