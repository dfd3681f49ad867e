"""Queries of the gate's own checks, of its decisions by them, and of what is audited about them, with their SQL.

Lines of orders stand in for pictures: their numbers are spread over the ranges of the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import gate, reports, signals
from tessella.plans import bindings as B

#: Features, as expressions that both engines read alike.
FEATURES = {
    "sample_id": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string))",
    "dataset": "l_returnflag",
    "region_status": "case when l_orderkey % 97 = 0 then 'none_detected' else 'ok' end",
    "pixel_count": "(l_orderkey * 37 + l_partkey * 11) % 40000",
    "foreground_ratio": "l_quantity / 100",
    "width_ratio": "case when l_suppkey % 89 <> 5 then (l_partkey % 80) / 100e0 end",
    "height_ratio": "(l_suppkey * 7 % 70) / 100e0",
    "left_touch": "(l_orderkey % 60) / 100e0",
    "right_touch": "(l_partkey % 50) / 100e0",
    "top_touch": "(l_suppkey % 12) / 100e0",
    "bottom_touch": "((l_orderkey + l_partkey) % 80) / 100e0",
    "border_touch": "((l_orderkey + l_suppkey) % 90) / 100e0",
    "largest_ratio": "(80 + l_partkey % 25) / 100e0",
    "component_count": "l_linenumber + l_orderkey % 4",
    "mean_probability": "case when l_orderkey % 13 <> 4 then (85 + l_suppkey % 16) / 100e0 end",
    "region_blur": "case when l_returnflag <> 'R' then l_extendedprice / 1000 end",
    "dark_ratio": "l_discount * 2",
    "bright_ratio": "l_tax * 3",
    "shadow_clip": "(l_orderkey % 70) / 1000e0",
    "highlight_clip": "(l_partkey % 15) / 1000e0",
    "mean_luminance": "case when l_partkey % 31 <> 0 then 0.5e0 end",
    "luminance_range": "(l_suppkey % 150) / 100e0",
    "short_side": "l_partkey % 160",
    "cast_magnitude": "l_quantity * 0.8e0",
    "cast_support": "l_partkey % 5 <> 0",
    "occlusion_score": "(l_orderkey % 40) / 100e0",
    "occlusion_evidence": "l_linenumber % 3",
    "occlusion_available": "l_suppkey % 4 <> 0",
    "probability": "(l_orderkey * 3 % 101) / 100e0",
}


def _features(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in FEATURES.items()])


_COLUMNS = ("sample_id", "evaluation_state", "finding", "severity", "decision_effect", "score", "reason_code")


def _check(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        one = [c for c in signals.signal_checks() if c.name == name]
        return gate.evaluate(_features(s, d), one).select(*_COLUMNS)

    return query


def _evaluated(s: SparkSession, d: str, *keep: str) -> gate.Evaluated:
    return gate.evaluated(_features(s, d), [*signals.signal_checks(), gate.three_state("stain", "probability", 0.95, 0.96, "STAIN", deferred=True)], keep=keep)


PRIORITY = ("NOTHING_DETECTED", "OCCLUDED", "TOO_SMALL", "CROPPED", "REGION_BLUR", "SEVERE_CAST")


def m19_runtime_decisions(s, d):
    """The whole gate: checks, decision, reasons, completeness, a picture without a region being never complete."""
    return gate.decide_arrays(_evaluated(s, d), PRIORITY, nothing="presence")


def m20_retake_deltas(s, d):
    base = ["presence", "scale", "completeness", "integrity", "focus", "exposure", "illumination", "resolution"]
    layers = {"base": base, "with_cast": [*base, "cast"], "full": [*base, "cast", "occlusion"]}
    return gate.ablation_deltas(gate.ablation_arrays(_evaluated(s, d), layers), list(layers))


def m21_attribution_buckets(s, d):
    return gate.attribution_buckets(_evaluated(s, d), {"size": ["presence", "scale", "completeness"], "focus": ["focus"], "cast": ["cast"], "occlusion": ["occlusion"]})


def d10_newly_rejected(s, d):
    return gate.newly_rejected(_evaluated(s, d), ["presence", "scale", "focus"]).select("sample_id", "before", "primary_reason")


def f26_decision_report(s, d):
    return reports.decision_report(gate.decide_arrays(_evaluated(s, d, "dataset"), PRIORITY)).withColumn("retake_rate", F.round("retake_rate", 9))


def f29_unavailable_counts(s, d):
    return gate.unavailable_counts(_evaluated(s, d), ["cast", "occlusion"])


def f30_score_by_decision(s, d):
    some = gate.decide_arrays(_evaluated(s, d, "probability"), only=["presence", "scale", "focus"])
    out = reports.by_stratum(some, "decision", "probability", 0.3, 0.6)
    return out.withColumns({c: F.round(c, 9) for c in ("median", "true_rate", "uncertain_rate")})


def m23_recommendation(s, d):
    every = _evaluated(s, d)
    return reports.recommendation(every, base=["presence", "scale", "focus"], cast="cast", occlusion="occlusion", others=["presence", "scale", "completeness", "focus", "occlusion"], bugs=0, shifted=True)


def l10_band_violations(s, d):
    """Bands of a probability against findings, some of them wrong on purpose."""
    rows = gate.evaluate(_features(s, d), [gate.three_state("stain", "probability", 0.3, 0.6, "STAIN")])
    rows = rows.withColumn("finding", F.when(F.col("score") == 0.5, "false").otherwise(F.col("finding"))).withColumn("decision_effect", F.when(F.col("score") == 0.9, None).otherwise(F.col("decision_effect")))
    return reports.band_violations(rows, 0.3, 0.6)


_QUERIES = {f.__name__: f for f in (m19_runtime_decisions, m20_retake_deltas, m21_attribution_buckets, d10_newly_rejected, f26_decision_report, f29_unavailable_counts, f30_score_by_decision, m23_recommendation, l10_band_violations)}
NUMBERS = {"m1_presence": "presence", "m2_scale": "scale", "m3_completeness": "completeness", "m4_integrity": "integrity", "m5_focus": "focus", "m6_exposure": "exposure", "m7_illumination": "illumination", "m8_resolution": "resolution", "m9_cast": "cast", "m10_occlusion": "occlusion"}
QUERIES = {**{n: _check(c) for n, c in NUMBERS.items()}, **_QUERIES}

_F = "f AS (SELECT *, region_status = 'none_detected' OR pixel_count <= 0 AS gone FROM (SELECT " + ", ".join(f"{e.replace('as string', 'as varchar')} AS {c}" for c, e in FEATURES.items()) + " FROM lineitem))"
_T = signals.THRESHOLDS
#: Of each check: its state, and the (condition, finding, severity, effect, reason) of its levels in order, then what it finds if none holds, and its score.
_S, _C, _I, _E, _R = (_T[k] for k in ("scale", "completeness", "integrity", "exposure", "resolution"))
_HITS = f"(foreground_ratio < {_S['retake_foreground']})::INT + (width_ratio < {_S['retake_width']})::INT + (height_ratio < {_S['retake_height']})::INT"
_SPEC = {
    "presence": ("'evaluated'", [("gone", "absent", "severe", "retake", "'NOTHING_DETECTED'")], "present", "foreground_ratio"),
    "scale": ("CASE WHEN gone OR foreground_ratio IS NULL OR width_ratio IS NULL OR height_ratio IS NULL THEN 'not_evaluated' ELSE 'evaluated' END",
              [(f"{_HITS} >= 2 OR foreground_ratio < {_S['retake_foreground']}", "too_small", "severe", "retake", "'TOO_SMALL'"),
               (f"{_HITS} >= 1 OR foreground_ratio < {_S['warning_foreground']} OR width_ratio < {_S['warning_width']} OR height_ratio < {_S['warning_height']}", "small", "mild", "warning", "'SLIGHTLY_SMALL'")], "adequate", "foreground_ratio"),
    "completeness": ("CASE WHEN gone THEN 'not_evaluated' ELSE 'evaluated' END",
                     [(f"greatest(left_touch, right_touch) >= {_C['retake_side']} OR bottom_touch >= {_C['retake_bottom']}", "cropped", "severe", "retake", "'CROPPED'"),
                      (f"greatest(left_touch, right_touch) >= {_C['warning_side']} OR bottom_touch >= {_C['warning_bottom']} OR top_touch >= {_C['warning_top']}", "possibly_cropped", "mild", "warning", "'TOUCHES_FRAME'")], "complete", "border_touch"),
    "integrity": ("CASE WHEN gone THEN 'not_evaluated' ELSE 'evaluated' END",
                  [(f"largest_ratio < {_I['retake_largest']}", "fragmented", "severe", "retake", "'MASK_FRAGMENTED'"),
                   (f"component_count >= {_I['retake_components']} AND largest_ratio < {_I['warning_largest']}", "uncertain", "moderate", "retake", "'MASK_IMPLAUSIBLE'"),
                   (f"largest_ratio < {_I['warning_largest']} OR coalesce(mean_probability, 1) < {_I['warning_probability']}", "uncertain", "mild", "warning", f"CASE WHEN mean_probability < {_I['warning_probability']} THEN 'MASK_LOW_CONFIDENCE' ELSE 'MASK_FRAGMENTED' END")], "good", "largest_ratio"),
    "focus": ("CASE WHEN gone OR region_blur IS NULL THEN 'not_evaluated' ELSE 'evaluated' END",
              [(f"region_blur < {_T['focus']['retake']}", "blurred", "severe", "retake", "'REGION_BLUR'"), (f"region_blur < {_T['focus']['warning']}", "slightly_blurred", "mild", "warning", "'IMAGE_BLUR'")], "sharp", "region_blur"),
    "exposure": ("CASE WHEN gone OR mean_luminance IS NULL THEN 'not_evaluated' ELSE 'evaluated' END",
                 [(f"highlight_clip >= {_E['retake_highlight']}", "overexposed", "severe", "retake", "'HIGHLIGHT_CLIPPING'"), (f"bright_ratio >= {_E['retake_bright']}", "overexposed", "severe", "retake", "'OVEREXPOSED'"),
                  (f"shadow_clip >= {_E['retake_shadow']}", "underexposed", "severe", "retake", "'SHADOW_CLIPPING'"), (f"dark_ratio >= {_E['retake_dark']}", "underexposed", "severe", "retake", "'UNDEREXPOSED'"),
                  (f"highlight_clip >= {_E['warning_highlight']} OR bright_ratio >= {_E['warning_bright']}", "slightly_overexposed", "mild", "warning", "'OVEREXPOSED'"),
                  (f"shadow_clip >= {_E['warning_shadow']} OR dark_ratio >= {_E['warning_dark']}", "slightly_underexposed", "mild", "warning", "'UNDEREXPOSED'")], "normal",
                 f"CASE WHEN highlight_clip >= {_E['retake_highlight']} OR bright_ratio >= {_E['retake_bright']} THEN bright_ratio WHEN shadow_clip >= {_E['retake_shadow']} OR dark_ratio >= {_E['retake_dark']} THEN dark_ratio "
                 f"WHEN highlight_clip >= {_E['warning_highlight']} OR bright_ratio >= {_E['warning_bright']} THEN bright_ratio WHEN shadow_clip >= {_E['warning_shadow']} OR dark_ratio >= {_E['warning_dark']} THEN dark_ratio ELSE mean_luminance END"),
    "illumination": ("CASE WHEN gone THEN 'not_evaluated' ELSE 'evaluated' END",
                     [(f"luminance_range >= {_T['illumination']['retake']}", "nonuniform", "severe", "retake", "'STRONG_SHADOW'"), (f"luminance_range >= {_T['illumination']['warning']}", "mildly_nonuniform", "mild", "warning", "'UNEVEN_LIGHTING'")], "uniform", "luminance_range"),
    "resolution": ("CASE WHEN gone THEN 'not_evaluated' ELSE 'evaluated' END",
                   [(f"pixel_count < {_R['retake_pixels']} OR short_side < {_R['retake_short']}", "too_low", "severe", "retake", "'REGION_RESOLUTION_TOO_LOW'"), (f"pixel_count < {_R['warning_pixels']} OR short_side < {_R['warning_short']}", "low", "mild", "warning", "'IMAGE_RESOLUTION_TOO_LOW'")], "adequate", "pixel_count::DOUBLE"),
    "cast": ("CASE WHEN gone THEN 'not_evaluated' WHEN NOT cast_support THEN 'unavailable' ELSE 'evaluated' END",
             [(f"cast_magnitude >= {_T['cast']['retake']}", "severe", "severe", "retake", "'SEVERE_CAST'"), (f"cast_magnitude >= {_T['cast']['warning']}", "suspected", "moderate", "warning", "'CAST_SUSPECTED'")], "acceptable", "cast_magnitude"),
    "occlusion": ("CASE WHEN gone THEN 'not_evaluated' WHEN NOT occlusion_available THEN 'unavailable' ELSE 'evaluated' END",
                  [(f"occlusion_score >= {_T['occlusion']['retake']} AND occlusion_evidence >= 2", "major", "severe", "retake", "'OCCLUDED'"), (f"occlusion_score >= {_T['occlusion']['warning']}", "possible_occlusion", "moderate", "warning", "'OCCLUDED'")], "none", "occlusion_score"),
}


def _sql(name: str, at: int = 0) -> str:
    state, levels, otherwise, score = _SPEC[name]
    case = lambda i, last: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[i] if i == 4 else chr(39) + x[i] + chr(39)}" for x in levels) + f" {last} END"
    done = lambda x: f"CASE WHEN {state} = 'evaluated' THEN {x} END"
    return (
        f"SELECT sample_id, {at} AS seq, '{name}' AS check_id, {state} AS evaluation_state, {done(case(1, f'ELSE {chr(39)}{otherwise}{chr(39)}'))} AS finding, {done(case(2, 'ELSE ' + repr('none')))} AS severity, "
        f"{done(case(3, 'ELSE ' + repr('pass')))} AS decision_effect, {score} AS score, {done(case(4, ''))} AS reason_code, dataset, probability FROM f"
    )


_ALL = f"WITH {_F}, c AS (" + " UNION ALL ".join(_sql(n, i) for i, n in enumerate(signals.ORDER)) + ")"
_LIST = "[" + ", ".join(f"'{p}'" for p in PRIORITY) + "]"
_EFFECT = "CASE WHEN bool_or(decision_effect = 'retake') THEN 'retake' WHEN bool_or(decision_effect = 'warning') THEN 'warning' ELSE 'pass' END"
_BASE = "check_id IN ('presence', 'scale', 'focus')"
_DECIDED = f"""{_ALL}, decided AS (
  SELECT sample_id, any_value(dataset) AS dataset, any_value(probability) AS probability, {_EFFECT} AS decision, first(reason_code ORDER BY decision_effect <> 'retake', coalesce(list_position({_LIST}, reason_code), 99), seq) FILTER (reason_code IS NOT NULL) AS primary_reason,
         first(reason_code ORDER BY decision_effect <> 'retake', seq) FILTER (reason_code IS NOT NULL) AS plain_reason, list(reason_code ORDER BY seq) FILTER (reason_code IS NOT NULL) AS r,
         bool_and(evaluation_state = 'evaluated') AND NOT bool_or(check_id = 'presence' AND decision_effect = 'retake') AS evaluation_complete, {_EFFECT.replace("bool_or(", f"bool_or({_BASE} AND ")} AS lesser
  FROM c GROUP BY sample_id
)"""
_SOURCES = """SELECT sample_id, coalesce(bool_or(check_id IN ('presence', 'scale', 'completeness') AND decision_effect = 'retake'), false) AS a, coalesce(bool_or(check_id = 'focus' AND decision_effect = 'retake'), false) AS b,
  coalesce(bool_or(check_id = 'cast' AND decision_effect = 'retake'), false) AS c, coalesce(bool_or(check_id = 'occlusion' AND decision_effect = 'retake'), false) AS d, coalesce(bool_or(decision_effect = 'retake'), false) AS any_ FROM c GROUP BY sample_id"""
_BUCKETS = ["size_only", "focus_only", "cast_only", "occlusion_only", "size_plus_focus", "size_plus_cast", "size_plus_occlusion", "focus_plus_cast", "focus_plus_occlusion", "cast_plus_occlusion", "three_or_more", "none"]
_NEW = f"{_DECIDED}, g AS ({_SOURCES}), n AS (SELECT d.sample_id, g.* FROM decided d JOIN g USING (sample_id) WHERE decision = 'retake' AND lesser <> 'retake')"
ORACLE_SQL = {
    **{n: f"WITH {_F} SELECT {', '.join(_COLUMNS)} FROM ({_sql(c)})" for n, c in NUMBERS.items()},
    "m19_runtime_decisions": f"{_DECIDED} SELECT sample_id, decision, primary_reason, coalesce(array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), '|'), '') AS reasons, decision <> 'retake' AS usable, evaluation_complete FROM decided",
    "m20_retake_deltas": f"{_ALL}, n AS (SELECT sample_id, bool_or(decision_effect = 'retake' AND check_id NOT IN ('cast', 'occlusion')) AS a, bool_or(decision_effect = 'retake' AND check_id <> 'occlusion') AS b, bool_or(decision_effect = 'retake') AS c FROM c GROUP BY 1), t AS (SELECT count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c FROM n) SELECT 'with_cast' AS layer, 'base' AS before, b - a AS delta FROM t UNION ALL SELECT 'full', 'with_cast', c - b FROM t",
    "m21_attribution_buckets": f"""{_ALL}, g AS ({_SOURCES}), s AS (SELECT CASE WHEN a::INT + b::INT + c::INT + d::INT = 0 THEN 'none' WHEN a::INT + b::INT + c::INT + d::INT >= 3 THEN 'three_or_more' ELSE concat_ws('_plus_', CASE WHEN a THEN 'size' END, CASE WHEN b THEN 'focus' END, CASE WHEN c THEN 'cast' END, CASE WHEN d THEN 'occlusion' END) || CASE WHEN a::INT + b::INT + c::INT + d::INT = 1 THEN '_only' ELSE '' END END AS bucket FROM g WHERE any_)
      SELECT b.bucket, count(s.bucket) AS n FROM unnest({_BUCKETS}) AS b(bucket) LEFT JOIN s ON s.bucket = b.bucket GROUP BY 1""",
    "d10_newly_rejected": f"{_DECIDED} SELECT sample_id, lesser AS before, plain_reason AS primary_reason FROM decided WHERE decision = 'retake' AND lesser <> 'retake'",
    "f26_decision_report": f"{_DECIDED}, x AS (SELECT dataset, decision FROM decided UNION ALL SELECT 'overall', decision FROM decided) SELECT dataset, count(*) AS n, count(*) FILTER (decision = 'pass') AS n_pass, count(*) FILTER (decision = 'warning') AS n_warning, count(*) FILTER (decision = 'retake') AS n_retake, round(count(*) FILTER (decision = 'retake') / count(*)::DOUBLE, 9) AS retake_rate, count(*) FILTER (decision = 'retake') / count(*)::DOUBLE >= 0.25 AS review FROM x GROUP BY dataset",
    "f29_unavailable_counts": f"{_ALL}, s AS (SELECT sample_id, bool_and(evaluation_state = 'evaluated') AS complete, bool_or(check_id = 'cast' AND evaluation_state = 'unavailable') AS a, bool_or(check_id = 'occlusion' AND evaluation_state = 'unavailable') AS b, bool_and(evaluation_state = 'evaluated') FILTER (check_id IN ('cast', 'occlusion')) AS fine FROM c GROUP BY 1) SELECT 'cast_unavailable' AS why, count(*) FILTER (NOT complete AND a) AS n FROM s UNION ALL SELECT 'occlusion_unavailable', count(*) FILTER (NOT complete AND b) FROM s UNION ALL SELECT 'other', count(*) FILTER (NOT complete AND fine) FROM s",
    "f30_score_by_decision": f"{_DECIDED} SELECT lesser AS decision, count(*) AS n, round(quantile_cont(probability, 0.5), 9) AS median, round(count(*) FILTER (probability >= 0.6) / count(*)::DOUBLE, 9) AS true_rate, round(count(*) FILTER (probability > 0.3 AND probability < 0.6) / count(*)::DOUBLE, 9) AS uncertain_rate FROM decided GROUP BY 1",
    "m23_recommendation": f"""{_NEW}, t AS (SELECT (SELECT count(*) FROM n) AS newly_rejected, (SELECT count(*) FROM n WHERE c AND NOT a AND NOT b AND NOT d) AS by_cast_only, (SELECT count(*) FROM g WHERE c) AS cast_retakes, (SELECT count(*) FROM g WHERE d) AS occlusion_retakes),
      k AS (SELECT *, concat_ws('|', CASE WHEN by_cast_only >= greatest(20, floor(0.4 * greatest(newly_rejected, 1))) THEN 'DOMAIN_CONCERN' END, CASE WHEN cast_retakes >= 20 THEN 'CAST_CONCERN' END, CASE WHEN occlusion_retakes >= 10 THEN 'OCCLUSION_CONCERN' END) AS concerns FROM t)
      SELECT CASE WHEN contains(concerns, '|') THEN 'MULTIPLE_CONCERNS' WHEN concerns <> '' THEN concerns ELSE 'READY' END AS recommendation, concerns, newly_rejected, cast_retakes, occlusion_retakes FROM k""",
    "l10_band_violations": f"WITH {_F} SELECT sample_id, CASE WHEN probability = 0.5 THEN 'uncertain' ELSE 'stain' END AS band, CASE WHEN probability = 0.5 THEN 'false' ELSE 'true' END AS finding, CASE WHEN probability = 0.5 THEN 'warning' END AS decision_effect FROM f WHERE probability IN (0.5, 0.9)",
}
