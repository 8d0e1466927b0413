"""Class, confidence and state expressions of cell typing.

Fixed values: classes in the order that breaks ties, priors and model weights by segmentation class id,
marker signatures and weights, thresholds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("cancer", "immune", "healthy")
PRIORS = {0: (1 / 3, 1 / 3, 1 / 3), 1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 1.0), 4: (1 / 3, 1 / 3, 1 / 3), 5: (0.5, 0.0, 0.5)}
MODEL_WEIGHTS = {0: 0.5, 1: 0.3, 2: 0.7, 3: 0.4, 4: 0.5, 5: 0.5}
DEFAULT_MODEL_WEIGHT = 0.85
LEAST_MODEL_CONFIDENCE = 0.40
HIGH_MARGIN, MEDIUM_MARGIN = 0.25, 0.12
DEAD_CLASS = 4
SIGNATURES = {
    "epithelial": ("PanCK", "Ecadherin"),
    "cd4_t": ("CD45", "CD3e", "CD4", "CD45RO"),
    "cd8_t": ("CD45", "CD3e", "CD8a", "CD45RO"),
    "treg": ("CD45", "CD3e", "CD4", "FOXP3"),
    "b_cell": ("CD45", "CD20"),
    "macrophage": ("CD45", "CD68", "CD163"),
    "endothelial": ("CD31",),
    "sma_stromal": ("SMA",),
}
FINE_WEIGHTS = {"epithelial": ("cancer", 1.0), "cd4_t": ("immune", 0.2), "cd8_t": ("immune", 0.2), "treg": ("immune", 0.2), "b_cell": ("immune", 0.2), "macrophage": ("immune", 0.2), "endothelial": ("healthy", 0.5), "sma_stromal": ("healthy", 0.5)}
SIGNATURE_PENALTY = 0.35
TEMPERATURE = 0.75
LEGACY_TYPES = {
    "tumor": ("Keratin", "NaKATPase", "CDX2"),
    "immune": ("CD45", "CD3", "CD4", "CD8a", "CD20", "CD45RO", "CD68", "CD163", "FOXP3", "PD1"),
    "stromal": ("SMA", "CD31", "Desmin", "Collagen"),
}


def safe_double(value: Column, default: float = 0.0) -> Column:
    """A number; null, NaN and text that is none become ``default``."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None)), F.lit(default))


def argmax_class(scores: Mapping[str, Column]) -> Column:
    """The class of the greatest score; ties go to the earlier of ``CLASSES``."""
    c, i, h = (scores[k] for k in CLASSES)
    return F.when((c >= i) & (c >= h), "cancer").when(i >= h, "immune").otherwise("healthy")


def by_class_id(type_id: Column, values: Mapping[int, float], default: float) -> Column:
    """A value by segmentation class id."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(type_id == k, F.lit(v)).otherwise(out)
    return out


def prior(type_id: Column) -> dict[str, Column]:
    """Prior probability of each class; unknown ids have equal thirds."""
    return {c: by_class_id(type_id, {k: v[i] for k, v in PRIORS.items()}, 1 / 3) for i, c in enumerate(CLASSES)}


def fuse(type_id: Column, model: Mapping[str, Column], model_weight: float = DEFAULT_MODEL_WEIGHT) -> dict[str, Column]:
    """Model and prior mixed by the class id's weight; a model whose best class is under the least confidence does not count."""
    weight = by_class_id(type_id, MODEL_WEIGHTS, min(max(model_weight, 0.0), 1.0))
    first = prior(type_id)
    unsure = F.greatest(*[model[c] for c in CLASSES]) < LEAST_MODEL_CONFIDENCE
    return {c: F.when(unsure, first[c]).otherwise(weight * model[c] + (1.0 - weight) * first[c]) for c in CLASSES}


def margin(probs: Sequence[Column]) -> Column:
    """The greatest minus the second greatest."""
    ranked = F.sort_array(F.array(*probs), asc=False)
    return ranked[0] - ranked[1]


def confidence(gap: Column, mismatch: Column) -> Column:
    """high, medium or low by margin; a mismatch lowers it one level."""
    return F.when(gap >= HIGH_MARGIN, F.when(mismatch, "medium").otherwise("high")).when(gap >= MEDIUM_MARGIN, F.when(mismatch, "low").otherwise("medium")).otherwise("low")


def confidence_score(name: Column) -> Column:
    """low 0, medium 1, high 2, anything else 0."""
    low = F.lower(name)
    return F.when(low == "high", 2).when(low == "medium", 1).otherwise(0)


def state(type_id: Column, ki67: Column, threshold: Column) -> Column:
    """dead, proliferative or quiescent."""
    return F.when(type_id == DEAD_CLASS, "dead").when(ki67 >= threshold, "proliferative").otherwise("quiescent")


def legacy_state(type_id: Column, value: Mapping[str, Column], threshold: Mapping[str, Column]) -> Column:
    """The six states of the older scheme."""
    keratin, ecad = value["Keratin"], value["Ecadherin"]
    return (
        F.when(type_id == DEAD_CLASS, "apoptotic")
        .when((value["Ki67"] >= threshold["Ki67"]) | (value["PCNA"] >= threshold["PCNA"]), "proliferative")
        .when((value["Vimentin"] >= threshold["Vimentin"]) & (ecad < threshold["Ecadherin"]), "emt")
        .when((keratin >= threshold["Keratin"]) & (ecad >= threshold["Ecadherin_high"]), "quiescent")
        .when((ecad >= threshold["Ecadherin_high"]) & (keratin < threshold["Keratin"]), "healthy")
        .otherwise("other")
    )


def legacy_type(value: Mapping[str, Column], threshold: Mapping[str, Column]) -> Column:
    """The first class of which any marker reaches its threshold."""
    out = F.lit("other")
    for name, markers in reversed(LEGACY_TYPES.items()):
        hit = F.lit(False)
        for m in markers:
            if m in value and m in threshold:
                hit = hit | (value[m] >= threshold[m])
        out = F.when(hit, name).otherwise(out)
    return out


def mean(columns: Sequence[Column]) -> Column:
    """The plain mean of columns."""
    return sum(columns[1:], columns[0]) / len(columns)


def rule_scores(r: Mapping[str, Column]) -> dict[str, Column]:
    """Class probabilities from marker ranks."""
    immune = 0.55 * r["CD45"] + 0.30 * mean([r[m] for m in ("CD3e", "CD4", "CD8a", "CD45RO", "FOXP3", "PD1")]) + 0.15 * mean([r[m] for m in ("CD20", "CD68", "CD163")])
    cancer = 0.55 * r["PanCK"] + 0.25 * r["Ecadherin"] + 0.20 * (1.0 - r["CD45"])
    healthy = 0.60 * mean([r["SMA"], r["CD31"]]) + 0.40 * mean([1.0 - r["PanCK"], 1.0 - r["CD45"]])
    return normalised({"cancer": cancer, "immune": immune, "healthy": healthy})


def normalised(scores: Mapping[str, Column]) -> dict[str, Column]:
    """Scores at 0 or above divided by their sum; a sum of 0 divides by 1."""
    above = {k: F.greatest(v, F.lit(0.0)) for k, v in scores.items()}
    total = sum(list(above.values())[1:], list(above.values())[0])
    return {k: v / F.when(total > 0, total).otherwise(1.0) for k, v in above.items()}


def softmax(scores: Mapping[str, Column], temperature: float = TEMPERATURE) -> dict[str, Column]:
    """Softmax with the greatest score subtracted first."""
    top = F.greatest(*scores.values())
    t = max(temperature, 1e-6)
    raised = {k: F.exp((v - top) / t) for k, v in scores.items()}
    total = sum(list(raised.values())[1:], list(raised.values())[0])
    return {k: v / total for k, v in raised.items()}


def collapse(fine: Mapping[str, Column]) -> dict[str, Column]:
    """Fine types weighted into the three classes, renormalised."""
    sums = {c: F.lit(0.0) for c in CLASSES}
    for name, (c, weight) in FINE_WEIGHTS.items():
        sums[c] = sums[c] + fine[name] * weight
    return normalised(sums)


def signature_scores(center: Mapping[str, Column]) -> dict[str, Column]:
    """For each fine type: mean of its markers minus the penalty on the positive part of the others."""
    out = {}
    for name, markers in SIGNATURES.items():
        present = [m for m in markers if m in center]
        others = [m for m in center if m not in present]
        if not present:
            out[name] = F.lit(0.0)
            continue
        penalty = mean([F.greatest(center[m], F.lit(0.0)) for m in others]) if others else F.lit(0.0)
        out[name] = mean([center[m] for m in present]) - SIGNATURE_PENALTY * penalty
    return out


def mapped_class(type_id: Column, prior_name: Column) -> Column:
    """Segmentation id to class: 1, 2, 3; 5 takes the prior's name where that is a class; else other."""
    k = type_id.try_cast("int")
    named = F.lower(F.trim(prior_name))
    return F.when(k == 1, "cancer").when(k == 2, "immune").when(k == 3, "healthy").when((k == 5) & named.isin(*CLASSES), named).otherwise("other")


def truthy(value: Column) -> Column:
    """1, true and yes, whatever the case; null is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def class_margin(label: Column, probs: Mapping[str, Column]) -> Column:
    """The probability of the labelled class minus the greatest of the others; null for other labels."""
    out = F.lit(None).cast("double")
    for c in CLASSES:
        out = F.when(label == c, probs[c] - F.greatest(*[probs[o] for o in CLASSES if o != c])).otherwise(out)
    return out
