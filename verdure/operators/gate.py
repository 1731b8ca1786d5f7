"""Acceptance: photo quality, cue bands, vetoes, and the fusion of rule and model scores. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import band

#: Low, high and softness of each cue's band.
BANDS = {
    "coverage": (0.04, 0.95, 0.04), "green_frac": (0.30, 1.0, 0.25), "leafcolor_frac": (0.80, 1.0, 0.20), "solidity": (0.55, 0.985, 0.20), "elongation": (1.0, 4.5, 2.0),
    "convexity_ratio": (1.02, 1.80, 0.25), "vein_ridge": (1.2, 14.0, 1.0), "texture_energy": (1.5, 22.0, 6.0), "orientation_coherence": (0.0, 0.70, 0.20), "boundary_contrast": (12.0, 400.0, 6.0),
}
#: The cues' weights; serration counts .4 + .6 times its value.
WEIGHTS = {"green_frac": 0.16, "leafcolor_frac": 0.12, "solidity": 0.14, "elongation": 0.08, "convexity_ratio": 0.10, "serration": 0.08, "vein_ridge": 0.12, "texture_energy": 0.08, "orientation_coherence": 0.04, "boundary_contrast": 0.08}
#: The model scores' weights.
DEEP = {"ood_gate_prob": 0.40, "maha_score": 0.40, "energy_score": 0.10, "msp": 0.10}
ACCEPT, DEEP_WEIGHT, WEAK_EDGE = 0.62, 0.60, 0.85


#: What is wrong with a photo, in the order of the tests.
QUALITY = ("unreadable_or_not_rgb", "resolution_too_low", "blank_or_solid_colour", "too_blurry", "too_dark", "overexposed")


def quality_reason() -> Column:
    """Null for a usable photo. Columns: height, width, std, sharpness, mean, dark, bright."""
    col = F.col
    tests = (
        col("height").isNull() | col("width").isNull(), F.least("height", "width") < 64, col("std") < 3, col("sharpness") < 12,
        (col("mean") < 18) | (col("dark") > 0.8), (col("mean") > 245) | (col("bright") > 0.8),
    )
    return F.coalesce(*(F.when(test, name) for test, name in zip(tests, QUALITY, strict=True)))


def cue_scores() -> dict[str, Column]:
    out = {k: band(k, *BANDS[k]) for k in WEIGHTS if k in BANDS}
    out["serration"] = F.lit(0.4) + F.lit(0.6) * F.coalesce("serration", F.lit(0.0))
    return {k: out[k] for k in WEIGHTS}


def heuristic_score() -> Column:
    total = F.lit(0.0)
    for k, x in cue_scores().items():
        total = total + F.lit(WEIGHTS[k]) * x
    return total


def segmentation_confidence(separation, solidity, agreement, coverage) -> Column:
    """Fixed weights of the four sub-scores, each cut to 0 .. 1."""
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x)))
    return F.lit(0.30) * cut(separation) + F.lit(0.25) * cut(solidity) + F.lit(0.25) * cut(agreement) + F.lit(0.20) * cut(coverage)


def with_overrides(defaults: dict[str, float], overrides: Column) -> Column:
    """A map of the defaults, with the values that `overrides` (a map, or null) has for their names or for others."""
    base = F.map_from_arrays(F.array(*map(F.lit, defaults)), F.array(*(F.lit(float(x)) for x in defaults.values())))
    given = F.coalesce(overrides, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


def stops_early(veto: Column) -> Column:
    """After the first pass a photo is turned away for any reason but a low confidence, which the models may still mend."""
    return veto.isNotNull() & (veto != "low_confidence")


def weakest(n: int = 3) -> Column:
    """The n lowest cues, equal ones in the order of WEIGHTS."""
    pairs = F.array(*(F.struct(x.alias("s"), F.lit(i).alias("i"), F.lit(k).alias("cue")) for i, (k, x) in enumerate(cue_scores().items())))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: x["cue"])


def deep_score() -> Column:
    """Weighted mean of the scores that are there; null without any."""
    top = sum((F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(0.0) for k, w in DEEP.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in DEEP.items()), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def deep_vetoes(thresholds: dict[str, float]) -> Column:
    """Names of the scores strictly below their thresholds."""
    return F.array_compact(F.array(*(F.when(F.col(k) < F.lit(thresholds[k]), k) for k in DEEP if k in thresholds))) if thresholds else F.array().cast("array<string>")


def veto() -> Column:
    """The first rule that holds, else null. Further columns: segmentation, skin_like_frac, n_margin_teeth."""
    return (
        F.when((F.col("segmentation") == "no_leaf_found") | (F.col("coverage") < BANDS["coverage"][0]) | (F.col("green_frac") < 0.12), "no_leaf").when(F.col("skin_like_frac") > 0.35, "skin")
        .when(F.col("solidity") < 0.40, "not_leaf_structure").when((F.col("vein_ridge") < 1.2) & (F.col("texture_energy") < 1.0), "featureless_object")
        .when((F.col("solidity") > 0.975) & (F.col("n_margin_teeth") <= 1) & (F.col("convexity_ratio") < 1.06), "geometric_shape")
    )


def decide(cues: DataFrame, thresholds: dict[str, float] | None = None, accept: float = ACCEPT, deep_weight: float = DEEP_WEIGHT) -> DataFrame:
    """Adds heuristic, deep, confidence, veto, accepted and weakest. Model scores count only where they have a threshold."""
    thresholds = thresholds or {}
    out = cues
    for k in DEEP:
        if k not in thresholds:
            out = out.withColumn(k, F.lit(None).cast("double"))
    weak = F.col("green_background") & (F.col("boundary_contrast") < 11) & (F.col("texture_contrast") < 0.15)
    out = out.withColumn("heuristic", heuristic_score() * F.when(weak, WEAK_EDGE).otherwise(1.0)).withColumn("deep", deep_score())
    out = out.withColumn("confidence", F.when(F.col("deep").isNotNull(), F.col("heuristic") * (1 - deep_weight) + F.col("deep") * deep_weight).otherwise(F.col("heuristic")))
    rule = F.coalesce(veto(), F.when(F.size(deep_vetoes(thresholds)) > 0, "not_tomato"), F.when(F.col("confidence") < accept, "low_confidence"))
    out = out.withColumn("veto", rule).withColumn("accepted", F.col("veto").isNull())
    return out.withColumn("weakest", F.when(F.col("veto") == "low_confidence", F.array_join(weakest(), ",")))


#: The least and the most coverage, and the least confidence of a reliable segmentation.
COVERAGE, RELIABLE = (0.03, 0.97), 0.45
#: What a background that fills most of the frame is called.
BACKGROUNDS = {"green": "grass or mixed vegetation", "soil": "bare soil / ground", "stone": "stones, gravel or a plain grey surface"}
NO_LEAF, DOMINANT = "an object or scene without a tomato leaf", 0.55


def segmentation_reason(coverage: str = "coverage", confidence: str = "confidence", earlier: str | None = None) -> Column:
    """Null for a reliable segmentation, else the first reason; one found earlier stays."""
    low, high = COVERAGE
    found = (
        F.when(F.col(coverage) < low, "coverage_too_low_likely_failed_segmentation").when(F.col(coverage) > high, "coverage_too_high_likely_no_background_present")
        .when(F.col(confidence) < RELIABLE, "low_segmentation_confidence")
    )
    return F.coalesce(earlier, found) if earlier else found


def background_name() -> Column:
    """What dominates the frame, by the columns green, soil, stone and other; of equal shares the first counts."""
    most = F.greatest("green", "soil", "stone", "other")
    out = F.when(most.isNull() | (most <= DOMINANT), NO_LEAF)
    for k, name in BACKGROUNDS.items():
        out = out.when(F.col(k) == most, name)
    return out.otherwise(NO_LEAF)
