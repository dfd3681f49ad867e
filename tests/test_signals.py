import pytest
from pyspark.sql import functions as F

from tessella.operators import gate, manifests, reports, signals

GOOD = dict(
    region_status="ok", pixel_count=20_000, foreground_ratio=0.3, width_ratio=0.5, height_ratio=0.5, left_touch=0.0, right_touch=0.0, top_touch=0.0, bottom_touch=0.0, border_touch=0.0, largest_ratio=1.0, component_count=1,
    mean_probability=0.95, region_blur=20.0, dark_ratio=0.0, bright_ratio=0.0, shadow_clip=0.0, highlight_clip=0.0, mean_luminance=0.5, luminance_range=0.1, short_side=300, cast_magnitude=1.0, cast_support=True, occlusion_score=0.0, occlusion_evidence=0, occlusion_available=True,
)
T = signals.THRESHOLDS
CASES = {
    "good": ({}, "pass", ""),
    "blur at the limit": ({"region_blur": T["focus"]["retake"]}, "warning", "IMAGE_BLUR"),
    "blur below": ({"region_blur": T["focus"]["retake"] - 1e-9}, "retake", "REGION_BLUR"),
    "blur at the upper limit": ({"region_blur": T["focus"]["warning"]}, "pass", ""),
    "top only": ({"top_touch": 1.0}, "warning", "TOUCHES_FRAME"),
    "side": ({"left_touch": T["completeness"]["retake_side"]}, "retake", "CROPPED"),
    "one weak evidence": ({"occlusion_score": 0.9, "occlusion_evidence": 1}, "warning", "OCCLUDED"),
    "two evidences": ({"occlusion_score": 0.9, "occlusion_evidence": 2}, "retake", "OCCLUDED"),
    "small in one side": ({"width_ratio": 0.1}, "warning", "SLIGHTLY_SMALL"),
    "small foreground": ({"foreground_ratio": 0.01}, "retake", "TOO_SMALL"),
    "pieces": ({"component_count": 5, "largest_ratio": 0.9}, "retake", "MASK_IMPLAUSIBLE"),
    "pieces but whole": ({"component_count": 9, "largest_ratio": 0.96}, "pass", ""),
    "unsure": ({"mean_probability": 0.5}, "warning", "MASK_LOW_CONFIDENCE"),
    "clipped and bright": ({"highlight_clip": 0.5, "bright_ratio": 0.5}, "retake", "HIGHLIGHT_CLIPPING"),
    "bright before dark": ({"bright_ratio": 0.07, "dark_ratio": 0.9}, "retake", "UNDEREXPOSED"),
    "two reasons": ({"region_blur": 1.0, "cast_magnitude": 50.0}, "retake", "REGION_BLUR|SEVERE_CAST"),
    "nothing": ({"region_status": "none_detected"}, "retake", "NOTHING_DETECTED"),
    "no pixels": ({"pixel_count": 0}, "retake", "NOTHING_DETECTED"),
    "no support": ({"cast_support": False, "cast_magnitude": 99.0}, "pass", ""),
    "unknown blur": ({"region_blur": None}, "pass", ""),
}
INCOMPLETE = {"nothing", "no pixels", "no support", "unknown blur"}


def test_checks_at_their_limits(spark):
    schema = "sample_id string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in GOOD.items())
    df = spark.createDataFrame([(name, *(GOOD | change).values()) for name, (change, _, _) in CASES.items()], schema)
    checks = signals.signal_checks()
    wide = {r.sample_id: r for r in gate.decide_arrays(gate.evaluated(df, checks), ["CROPPED"], nothing="presence").collect()}
    assert {k: (r.decision, r.reasons) for k, r in wide.items()} == {k: (d, r) for k, (_, d, r) in CASES.items()}
    assert {k for k, r in wide.items() if not r.evaluation_complete} == INCOMPLETE
    rows = gate.evaluate(df, checks)
    assert {r.sample_id: (r.decision, r.reasons) for r in gate.decide(rows).collect()} == {k: (r.decision, r.reasons) for k, r in wide.items()}
    states = {r.check_id: r.evaluation_state for r in rows.filter("sample_id = 'nothing'").collect()}
    assert states.pop("presence") == "evaluated" and set(states.values()) == {"not_evaluated"} and len(states) == 9
    assert rows.filter("sample_id = 'no support' and check_id = 'cast'").first().evaluation_state == "unavailable"


def test_thresholds_and_checks_can_be_switched_off(spark):
    df = spark.createDataFrame([("a", 0.0)], "sample_id string, region_blur double")
    for k, v in GOOD.items():
        if k != "region_blur":
            df = df.withColumn(k, F.lit(v))
    loose = signals.THRESHOLDS | {"focus": {"retake": None, "warning": None}, "cast": {"warning": None, "retake": None}}
    assert gate.decide_arrays(gate.evaluated(df, signals.signal_checks(loose))).first().decision == "pass"
    off = gate.decide_arrays(gate.evaluated(df, signals.signal_checks(disabled=["focus"]))).first()
    assert (off.decision, off.evaluation_complete) == ("pass", True)
    assert gate.ready(signals.signal_checks(), list(signals.ORDER)) == (True, True)
    assert gate.ready(signals.signal_checks(deferred=["cast"]), ["presence"]) == (False, False)


def test_manifests_say_what_is_wrong(spark):
    samples = spark.createDataFrame([(str(i), "d", f"m{i // 2}", i) for i in range(6)], "sample_id string, dataset string, md5 string, n int")
    splits = spark.createDataFrame([(str(i), "train" if i < 3 else "val") for i in range(6)], "sample_id string, split string")
    labels = spark.createDataFrame([(str(i), "t", "Yes " if i % 2 else "no") for i in range(6)] + [("5", "t", "no"), ("1", "u", "x")], "sample_id string, canonical_task string, canonical_label string")
    rows = manifests.labelled(samples, labels, splits, "d", "t", "yes", "no")
    assert sorted((r.sample_id, r.label) for r in rows.collect()) == [("0", 0), ("1", 1), ("2", 0), ("3", 1), ("4", 0), ("5", 0), ("5", 1)]
    assert sorted(map(tuple, manifests.labelled_violations(rows, labels, ["u"]).collect())) == [("barred_task", "1"), ("md5_in_one_split", "m1"), ("one_label", "5"), ("split_is_missing", "test")]
    with pytest.raises(Exception, match="unknown label"):
        manifests.labelled(samples, labels, splits, "d", "u", "yes", "no").collect()
    found = spark.createDataFrame([("0", True, None), ("1", False, "small"), ("2", False, None)], "sample_id string, ok boolean, reason string")
    after, rate = manifests.with_preflight(rows.filter("sample_id < '4'"), found, 0.5)
    assert sorted((r.sample_id, r.eligible, r.exclusion_reason) for r in after.collect()) == [("0", True, None), ("1", False, "small"), ("2", False, "failed"), ("3", False, "pending")]
    assert tuple(rate.first()) == (4, 0.25, False)


def test_features_that_leak_are_refused():
    reports.no_leaking_features(["chars", "words"])
    with pytest.raises(ValueError, match="dataset"):
        reports.no_leaking_features(["chars", "dataset"])


def test_tail_proposals_stay_monotone(spark):
    df = spark.createDataFrame([(1.0,)] * 50, "v double")
    r = reports.tail_proposals(df, "v").first()
    assert (r.warning, round(r.retake, 9)) == (1.0, 1.21)
