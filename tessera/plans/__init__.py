"""Registered queries and their SQL twins."""

from tessera.plans import celltyping, rastering, reporting, tiling, training
from tessera.plans.celltyping import assigned_patch_summary as flagship

_PARTS = (training, celltyping, rastering, reporting, tiling)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
