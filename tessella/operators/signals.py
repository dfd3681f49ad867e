"""The gate's own checks: what is read from a picture, its mask and the mask's probabilities, against thresholds.

Features are columns named as in the functions; thresholds that are None switch their condition off. Each check has the
precedence and the strictness of its rule: `<` for what may be too small, `>=` for what may be too large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.gate import Ladder, Rated, Step, _any

#: Thresholds of the published policy.
THRESHOLDS = {
    "scale": {"warning_foreground": 0.0999275, "retake_foreground": 0.063845, "warning_width": 0.349375, "retake_width": 0.28419999999999995, "warning_height": 0.331, "retake_height": 0.2517},
    "completeness": {"warning_side": 0.02, "retake_side": 0.4198999999999995, "warning_bottom": 0.2639999999999986, "retake_bottom": 0.6122999999999991, "warning_top": 0.05},
    "integrity": {"warning_largest": 0.95, "retake_largest": 0.85, "warning_probability": 0.9, "retake_components": 5.0},
    "focus": {"retake": 5.28003999710083, "warning": 10.448310279846192},
    "exposure": {
        "warning_dark": 0.11580557721457649, "retake_dark": 0.1592732976556388, "warning_bright": 0.060150849837606574, "retake_bright": 0.17296331014180452,
        "warning_shadow": 0.013768678284326949, "retake_shadow": 0.04700706389221267, "warning_highlight": 0.0021701881350913318, "retake_highlight": 0.011015224330453195,
    },
    "illumination": {"warning": 0.9486678357347298, "retake": 1.201061970189598},
    "resolution": {"warning_pixels": 16051.6, "retake_pixels": 10215.2, "warning_short": 124.0, "retake_short": 99.36},
    "cast": {"warning": 20.088847335301597, "retake": 28.600699292150182},
    "occlusion": {"warning": 0.23593363954037233, "retake": 0.28615079033942487},
}
#: Checks in their order, and whether they need a region in the picture.
ORDER = {"presence": False, "scale": True, "completeness": True, "integrity": True, "focus": True, "exposure": True, "illumination": True, "cast": True, "occlusion": True, "resolution": True}


def nothing() -> Column:
    """Whether the picture shows no region."""
    return (F.coalesce(F.col("region_status"), F.lit("")) == "none_detected") | F.coalesce(F.col("pixel_count") <= 0, F.lit(False))


def _under(c: str, limit: float | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(F.col(c) < limit, F.lit(False))


def _from(c: str, limit: float | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(F.col(c) >= limit, F.lit(False))


def _known(*names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def presence() -> Ladder:
    return Ladder("presence", (Step(nothing(), "absent", "severe", "retake", "NOTHING_DETECTED"),), "present", F.col("foreground_ratio"))


def scale(t: Mapping[str, float | None]) -> Ladder:
    """Too small where two of foreground, width and height are, or the foreground is; small where one is, or is nearly."""
    sides = [("foreground_ratio", "foreground"), ("width_ratio", "width"), ("height_ratio", "height")]
    severe = [_under(c, t.get(f"retake_{k}")) for c, k in sides]
    mild = [~s & _under(c, t.get(f"warning_{k}")) for s, (c, k) in zip(severe, sides, strict=True)]
    hits = sum((s.cast("int") for s in severe), F.lit(0))
    steps = (Step((hits >= 2) | severe[0], "too_small", "severe", "retake", "TOO_SMALL"), Step(_any(severe) | _any(mild), "small", "mild", "warning", "SLIGHTLY_SMALL"))
    return Ladder("scale", steps, "adequate", F.col("foreground_ratio"), _known("foreground_ratio", "width_ratio", "height_ratio"))


def completeness(t: Mapping[str, float | None]) -> Ladder:
    """Contact with the sides and the bottom can be severe; with the top it is a warning at most."""
    severe = _from("left_touch", t.get("retake_side")) | _from("right_touch", t.get("retake_side")) | _from("bottom_touch", t.get("retake_bottom"))
    mild = _from("left_touch", t.get("warning_side")) | _from("right_touch", t.get("warning_side")) | _from("bottom_touch", t.get("warning_bottom")) | _from("top_touch", t.get("warning_top"))
    steps = (Step(severe, "cropped", "severe", "retake", "CROPPED"), Step(mild, "possibly_cropped", "mild", "warning", "TOUCHES_FRAME"))
    return Ladder("completeness", steps, "complete", F.col("border_touch"), _known("left_touch", "right_touch", "top_touch", "bottom_touch"))


def integrity(t: Mapping[str, float | None]) -> Ladder:
    """A mask in pieces; many pieces matter only where the largest is not nearly all."""
    loose, unsure = _under("largest_ratio", t.get("warning_largest")), _under("mean_probability", t.get("warning_probability"))
    steps = (
        Step(_under("largest_ratio", t.get("retake_largest")), "fragmented", "severe", "retake", "MASK_FRAGMENTED"),
        Step(_from("component_count", t.get("retake_components")) & loose, "uncertain", "moderate", "retake", "MASK_IMPLAUSIBLE"),
        Step(loose | unsure, "uncertain", "mild", "warning", ((unsure, "MASK_LOW_CONFIDENCE"), (~unsure, "MASK_FRAGMENTED"))),
    )
    return Ladder("integrity", steps, "good", F.col("largest_ratio"), _known("largest_ratio", "component_count"))


def focus(t: Mapping[str, float | None]) -> Ladder:
    steps = (Step(_under("region_blur", t.get("retake")), "blurred", "severe", "retake", "REGION_BLUR"), Step(_under("region_blur", t.get("warning")), "slightly_blurred", "mild", "warning", "IMAGE_BLUR"))
    return Ladder("focus", steps, "sharp", F.col("region_blur"), _known("region_blur"))


def exposure(t: Mapping[str, float | None]) -> Ladder:
    """Too bright before too dark, severe before mild; clipping names the reason where it is severe. The score is of the side that hit."""
    hit = {k: _from(c, t.get(k)) for k, c in [(f"{level}_{side}", c) for level in ("retake", "warning") for side, c in (("highlight", "highlight_clip"), ("bright", "bright_ratio"), ("shadow", "shadow_clip"), ("dark", "dark_ratio"))]}
    bright, dark = hit["retake_highlight"] | hit["retake_bright"], hit["retake_shadow"] | hit["retake_dark"]
    mild_bright, mild_dark = hit["warning_highlight"] | hit["warning_bright"], hit["warning_shadow"] | hit["warning_dark"]
    steps = (
        Step(bright, "overexposed", "severe", "retake", ((hit["retake_highlight"], "HIGHLIGHT_CLIPPING"), (~hit["retake_highlight"], "OVEREXPOSED"))),
        Step(dark, "underexposed", "severe", "retake", ((hit["retake_shadow"], "SHADOW_CLIPPING"), (~hit["retake_shadow"], "UNDEREXPOSED"))),
        Step(mild_bright, "slightly_overexposed", "mild", "warning", "OVEREXPOSED"),
        Step(mild_dark, "slightly_underexposed", "mild", "warning", "UNDEREXPOSED"),
    )
    score = F.when(bright, F.col("bright_ratio")).when(dark, F.col("dark_ratio")).when(mild_bright, F.col("bright_ratio")).when(mild_dark, F.col("dark_ratio")).otherwise(F.col("mean_luminance"))
    return Ladder("exposure", steps, "normal", score, _known("dark_ratio", "bright_ratio", "shadow_clip", "highlight_clip", "mean_luminance"))


def illumination(t: Mapping[str, float | None]) -> Ladder:
    steps = (Step(_from("luminance_range", t.get("retake")), "nonuniform", "severe", "retake", "STRONG_SHADOW"), Step(_from("luminance_range", t.get("warning")), "mildly_nonuniform", "mild", "warning", "UNEVEN_LIGHTING"))
    return Ladder("illumination", steps, "uniform", F.col("luminance_range"), _known("luminance_range"))


def resolution(t: Mapping[str, float | None]) -> Ladder:
    severe = _under("pixel_count", t.get("retake_pixels")) | _under("short_side", t.get("retake_short"))
    mild = _under("pixel_count", t.get("warning_pixels")) | _under("short_side", t.get("warning_short"))
    steps = (Step(severe, "too_low", "severe", "retake", "REGION_RESOLUTION_TOO_LOW"), Step(mild, "low", "mild", "warning", "IMAGE_RESOLUTION_TOO_LOW"))
    return Ladder("resolution", steps, "adequate", F.col("pixel_count"), _known("pixel_count", "short_side"))


def cast(t: Mapping[str, float | None]) -> Ladder:
    """Unavailable without enough neutral pixels, or thresholds: that is no pass."""
    steps = (Step(_from("cast_magnitude", t.get("retake")), "severe", "severe", "retake", "SEVERE_CAST"), Step(_from("cast_magnitude", t.get("warning")), "suspected", "moderate", "warning", "CAST_SUSPECTED"))
    usable = F.col("cast_support") & F.lit(t.get("warning") is not None and t.get("retake") is not None)
    return Ladder("cast", steps, "acceptable", F.col("cast_magnitude"), available=usable)


def occlusion(t: Mapping[str, float | None], several: bool = True) -> Ladder:
    """With `several`, a single weak evidence is a warning at most. Unavailable without probabilities, or thresholds."""
    severe = _from("occlusion_score", t.get("retake"))
    weak = F.coalesce(F.col("occlusion_evidence"), F.lit(0)) < 2
    steps = (
        *((Step(severe & weak, "possible_occlusion", "moderate", "warning", "OCCLUDED"),) if several else ()),
        Step(severe, "major", "severe", "retake", "OCCLUDED"), Step(_from("occlusion_score", t.get("warning")), "possible_occlusion", "moderate", "warning", "OCCLUDED"),
    )
    usable = F.col("occlusion_available") & F.lit(t.get("warning") is not None and t.get("retake") is not None)
    return Ladder("occlusion", steps, "none", F.col("occlusion_score"), available=usable)


def signal_checks(thresholds: Mapping[str, Mapping[str, float | None]] = THRESHOLDS, disabled: Sequence[str] = (), deferred: Sequence[str] = ()) -> list[Rated]:
    """All checks in order. Where the picture shows no region, those that need one are not evaluated; the rest stands."""
    made = {
        "presence": presence(), "scale": scale(thresholds["scale"]), "completeness": completeness(thresholds["completeness"]), "integrity": integrity(thresholds["integrity"]), "focus": focus(thresholds["focus"]),
        "exposure": exposure(thresholds["exposure"]), "illumination": illumination(thresholds["illumination"]), "cast": cast(thresholds["cast"]), "occlusion": occlusion(thresholds["occlusion"]), "resolution": resolution(thresholds["resolution"]),
    }
    out: list[Rated] = []
    for name, region in ORDER.items():
        c = made[name]
        known, available = c.known, c.available
        if region:
            known = ~nothing() if known is None else ~nothing() & known
            available = None if available is None else nothing() | F.coalesce(available, F.lit(False))
        out.append(Ladder(c.name, c.steps, c.otherwise, c.score, known, available, enabled=name not in disabled, deferred=name in deferred))
    return out
