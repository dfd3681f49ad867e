import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators import calibrate, gate, matching, metrics, order, stats
from tessella.plans import bindings, evaluation
from tessella.sources import ingest
from tessella.policy import MappingItem


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(g, v, r.randint(1, 5)) for g in "ab" for v in r.sample(range(5000), 1500)] + [(None, 3, 2)]
    got = order.running(spark.createDataFrame(rows, "g string, v int, n int"), ["g"], "v", {"up": "n"}).collect()
    assert len(got) == len(rows)
    for x in got[::37]:
        assert x.up == sum(n for g, v, n in rows if g == x.g and v <= x.v)
    down = order.running(spark.createDataFrame(rows, "g string, v int, n int").filter("g = 'a'"), [], "v", {"up": "n"}, descending=True).collect()
    for x in down[::37]:
        assert x.up == sum(n for g, v, n in rows if g == "a" and v >= x.v)


def test_ranking_metrics(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 1), int(r.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.auroc(df).first().auroc, want)
    assert metrics.auroc(df.filter("label = 1")).first().auroc is None
    ap, seen, hit = 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        own = [y for t, y in rows if t == s]
        seen, hit = seen + len(own), hit + sum(own)
        ap += sum(own) / len(pos) * hit / seen
    assert math.isclose(metrics.average_precision(df).first().average_precision, ap)


@pytest.mark.parametrize(("p", "state"), [(0.95, "clear"), (0.955, "uncertain"), (0.96, "stain"), (None, None), (float("nan"), None)])
def test_bands(spark, p, state):
    assert spark.createDataFrame([(p,)], "p double").select(X.band("p", 0.95, 0.96, ("clear", "uncertain", "stain"))).first()[0] == state
    with pytest.raises(ValueError):
        X.band("p", 0.5, 0.5)


def test_thresholds_twice_are_the_same(spark):
    df = spark.range(500).selectExpr("(id % 100) / 100.0D as score", "cast(id % 100 > 60 as int) as label")
    a = calibrate.dual_thresholds(df).first()
    assert a == calibrate.dual_thresholds(df).first()
    assert a.status == "targets_met" and a.t_clear < a.t_retake and a.coverage > 0.95
    assert calibrate.dual_thresholds(df.withColumn("label", F.lit(0)), 0.99, 0.99).first().status == "fallback"
    with pytest.raises(Exception, match="test split"):
        calibrate.no_test(spark.createDataFrame([("test",)], "split string")).collect()


def test_distances(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 9.0]
    long = spark.createDataFrame([("f", v, 0) for v in a] + [("f", v, 1) for v in b], "feature string, value double, label int")
    points = sorted({*a, *b})
    cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    got = stats.distances(long).first()
    assert math.isclose(got.ks, max(abs(cdf(a, v) - cdf(b, v)) for v in points))
    assert math.isclose(got.wasserstein, sum(abs(cdf(a, v) - cdf(b, v)) * (w - v) for v, w in zip(points, points[1:], strict=False)))


def test_matching_keeps_the_caliper_and_uses_negatives_once(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(str(i), int(i % 3 == 0), r.gauss(0, 1), r.gauss(0, 1) if i % 11 else None) for i in range(200)], "sample_id string, label int, a double, b double")
    pairs = stats.caliper_candidates(df, ["a", "b"], "label", 0.2)
    z = {x.sample_id: x for x in stats.standardised(df, ["a", "b"]).collect()}
    want = {(p, n) for p, x in z.items() for n, y in z.items() if x.label == 1 and y.label == 0 and math.hypot(x.a - y.a, x.b - y.b) <= 0.2}
    assert {(p.positive, p.negative) for p in pairs.collect()} == want
    got = stats.matched(pairs).collect()
    assert len({m.negative for m in got}) == len({m.positive for m in got}) == len(got) > 10
    assert all(m.distance <= 0.2 for m in got)


def one_after_another(pairs):
    used, out = set(), []
    for p in sorted({x.positive for x in pairs if x.positive is not None}):
        free = min(((x.distance, x.negative) for x in pairs if x.positive == p and x.negative is not None and x.negative not in used), default=None)
        if free:
            used.add(free[1])
            out.append((p, free[1], free[0]))
    return out


@pytest.mark.parametrize(("caliper", "features"), [(0.0, "abc"), (0.25, "a"), (0.6, "abcd")])
def test_matching_on_points_is_that_on_pairs(spark, caliper, features):
    """Equal points, equal distances, keys of several rows and of both sides, and what is missing."""
    r, features = random.Random(5), list(features)
    rows = [(str(r.randrange(260)), r.choice([0, 1, 1, 1]), float(r.randrange(8)), float(r.randrange(8)), r.choice([0.0, 1.0]), r.choice([0.0, 1.0])) for _ in range(300)]
    rows += [(None, 1, 1.0, 1.0, 0.0, 0.0), (None, 0, 2.0, 2.0, 0.0, 0.0), ("x", None, 3.0, 3.0, 0.0, 0.0), ("y", 1, None, 3.0, 0.0, 0.0), ("z", 2, 3.0, 3.0, 1.0, 0.0), ("far", 1, 40.0, 40.0, 0.0, 0.0), ("far", 1, 3.0, 3.0, 1.0, 0.0), ("far", 0, 41.0, 40.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sample_id string, label int, a double, b double, c double, d double")
    if caliper:
        pairs = stats.caliper_candidates(df, features, "label", caliper).collect()
    else:
        z = stats.standardised(df, features).collect()
        pairs = [Row(positive=p.sample_id, negative=n.sample_id, distance=0.0) for p in z for n in z if (p.label, n.label) == (1, 0) and all(p[f] == n[f] for f in features)]
    got = sorted(tuple(x) for x in stats.caliper_matches(df, features, "label", caliper).collect())
    assert got == one_after_another(pairs) and len(got) > 20


@pytest.mark.parametrize("leaf", [1, 3, 512])
def test_matching_in_leaves_and_batches_of_any_size(monkeypatch, leaf):
    monkeypatch.setattr(matching, "LEAF", leaf)
    r = random.Random(leaf)
    rows = sorted((root, side, f"{r.randrange(150)}", float(r.randrange(9)), float(r.choice([0, 0, 1, r.random()]))) for root in "ab" for side in (0, 1, 1) for _ in range(150))
    pairs = {root: [Row(positive=p[2], negative=n[2], distance=math.sqrt((p[3] - n[3]) * (p[3] - n[3]) + (p[4] - n[4]) * (p[4] - n[4]))) for p in rows for n in rows if p[:2] == (root, 1) and n[:2] == (root, 0)] for root in "ab"}
    want = [m for root in "ab" for m in one_after_another([x for x in pairs[root] if x.distance <= 2])]
    table = pa.table(dict(zip(["root", "side", "key", "x", "y"], map(list, zip(*rows, strict=True)), strict=True)))
    got = [tuple(m.values()) for b in matching.Greedy(2).match(iter(table.to_batches(7))) for m in b.to_pylist()]
    assert got == want and len(got) > 100
    assert not list(matching.Greedy(2).match(iter(table.filter(pc.equal(table["side"], 1)).to_batches())))


def test_the_matching_query_makes_no_pairs_and_moves_no_text(spark, monkeypatch):
    monkeypatch.setattr(stats, "caliper_candidates", None)
    assert evaluation.p10_caliper_matching(spark, "/root/testdata/sf0.01").count() == 33
    plan = bindings.features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "stops" in plan.left().output().mkString(",") and "text" not in plan.left().output().mkString(",")


GATE = (gate.Check("a", (gate.Rule("x", "<", 1.0, "retake", "A"), gate.Rule("x", "<", 2.0, "warning", "A2"))),)


def test_gate(spark):
    df = spark.createDataFrame([("in", 0.5), ("edge", 1.0), ("out", 2.0), ("none", None)], "sample_id string, x double")
    got = {r.sample_id: r for r in gate.evaluate(df, [*GATE, gate.Check("off", enabled=False), gate.Check("need", (gate.Rule("x", ">", 9.0, "retake", "N"),), needs=F.col("x") > 1.5)]).filter("check_id = 'a'").collect()}
    assert [got[k].decision_effect for k in ("in", "edge", "out", "none")] == ["retake", "warning", "pass", None]
    assert got["none"].evaluation_state == "not_evaluated" and got["in"].reason_code == "A"


@pytest.mark.parametrize("effects", [["pass", "warning", "retake"], ["retake", "pass", "warning"], ["pass", None], [None]])
def test_the_worst_effect_decides(spark, effects):
    rows = [("s", i, f"c{i}", "evaluated" if e else "unavailable", e, f"R{i}" if e in ("warning", "retake") else None) for i, e in enumerate(effects)]
    d = gate.decide(spark.createDataFrame(rows, "sample_id string, seq int, check_id string, evaluation_state string, decision_effect string, reason_code string"), ("R9",)).first()
    assert d.decision == max((e or "pass" for e in effects), key=gate.RANK.get)
    assert d.usable == (d.decision != "retake") and d.evaluation_complete == (None not in effects)
    if d.decision == "retake":
        assert d.primary_reason == f"R{effects.index('retake')}"


def test_too_few_hits_only_warn(spark):
    c = gate.Check("o", (gate.Rule("x", ">=", 1.0, "retake", "X"), gate.Rule("y", ">=", 1.0, "retake", "Y")), at_least=2)
    df = spark.createDataFrame([("1", 1.0, 0.0), ("2", 1.0, 1.0)], "sample_id string, x double, y double")
    assert [r.decision_effect for r in gate.evaluate(df, [c]).orderBy("sample_id").collect()] == ["warning", "retake"]


def test_what_is_not_known_is_not_negative(spark):
    values = spark.createDataFrame([("1", "pale", "1"), ("2", "pale", "0"), ("3", "pale", " NA "), ("4", "crack", "0"), ("5", "crack", "yes"), ("6", "odd", "1"), ("7", "pale", "2")], "sample_id string, source_field string, source_value string")
    mapping = {"pale": MappingItem("color", positive="pale", derive=(("body", "any"),)), "crack": MappingItem("crack", positive="true", negative="false")}
    facts, warnings = ingest.mapped_facts(values, mapping)
    got = sorted((r.sample_id, r.canonical_label, r.value, r.note) for r in facts.collect())
    assert got == [("1", "any", 1, "derived"), ("1", "pale", 1, None), ("2", "pale", 0, "explicit_negative"), ("4", "false", 1, None), ("5", "true", 1, None), ("7", "pale", 0, "explicit_negative")]
    assert [r.source_field for r in warnings.collect()] == ["odd"]


def test_files(spark, tmp_path):
    for name, text in {"a/train/x.jpg": "1", "a/val/y.png": "2", "a/__MACOSX/z.jpg": "3", "a/._q.jpg": "4", "m/x.png": "5", "m/w.png": "6", "t/x.txt": "0 0.5 0.5 0.5 0.5\n1 2\n\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = ingest.sample_rows(ingest.files(spark, str(tmp_path / "a")), "d", str(tmp_path / "a"))
    assert sorted((r.sample_id, r.source_split, r.stem) for r in found.collect()) == [("d::train/x.jpg", "train", "x"), ("d::val/y.png", "val", "y")]
    masks = ingest.sample_rows(ingest.files(spark, str(tmp_path / "m")), "d", str(tmp_path / "m"))
    paired, warnings = ingest.paired_masks(found, masks)
    assert paired.count() == 2 and sorted(r.warning for r in warnings.collect()) == ["image_missing", "mask_missing"]
    images = spark.createDataFrame([("x", 100, 50)], "stem string, width int, height int")
    boxes, bad = ingest.yolo_boxes(spark, str(tmp_path / "t"), {0: "crack"}, images)
    assert [(b.canonical_label, b.x_min, b.y_min, b.x_max, b.y_max) for b in boxes.collect()] == [("crack", 25.0, 12.5, 75.0, 37.5)]
    assert [b.n for b in bad.collect()] == [1]
    for name, text in {"c.csv": "a,b\n1,2\n", "t.tsv": "a\tb\n1\t2\n", "w.txt": "a b\n1  2\n"}.items():
        (tmp_path / name).write_text(text)
        (r,) = ingest.delimited(spark, str(tmp_path / name)).collect()
        assert (r.a, r.b) == ("1", "2")


def test_letterbox_rounds_half_to_even(spark):
    got = spark.range(1).select(*[c.alias(k) for k, c in X.letterbox(F.lit(5), F.lit(2), 5, 5).items()]).first()
    assert (got.resized_width, got.resized_height, got.pad_top, got.pad_bottom) == (5, 2, 1, 2)


def test_arrays_and_rows_decide_alike(spark):
    df = spark.range(300).selectExpr("cast(id as string) as sample_id", "if(id % 7 = 0, null, id % 5 * 1.0D) as x", "id % 3 * 1.0D as y")
    rules = [gate.Check("a", (gate.Rule("x", "<", 1.0, "retake", "A"), gate.Rule("x", "<", 3.0, "warning", "A2"))), gate.Check("b", (gate.Rule("y", ">=", 2.0, "warning", "B"),)), gate.Check("c", (gate.Rule("y", ">=", 1.0, "retake", "C"),), enabled=False)]
    rows, arrays = gate.evaluate(df, rules), gate.evaluated(df, rules)
    for only in (None, ["b"]):
        same = lambda d: sorted(map(tuple, d.select("sample_id", "decision", "primary_reason", "reasons", "usable").collect()), key=str)
        assert same(gate.decide(rows, ["B", "A"], only)) == same(gate.decide_arrays(arrays, ["B", "A"], only))
    layers, sources = {"1": ["a"], "2": ["a", "b"]}, {"left": ["a"], "right": ["b", "c"]}
    assert sorted(map(tuple, gate.ablation(rows, layers).collect())) == sorted(map(tuple, gate.ablation_arrays(arrays, layers).collect()))
    assert sorted(map(tuple, gate.attribution(rows, sources).collect())) == sorted(map(tuple, gate.attribution_arrays(arrays, sources).collect()))


def test_completeness_is_of_active_checks_only(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0), ("c", 5.0, None), ("d", 0.0, 3.0)], "sample_id string, x double, y double")
    checks = [*GATE, gate.three_state("later", "y", 1.5, 2.5, "Y", deferred=True), gate.Check("off", (gate.Rule("y", ">", 0.0, "retake", "O"),), enabled=False), gate.Check("y", (gate.Rule("y", ">", 9.0, "warning", "Z"),), needs=F.col("y") < 2)]
    wide = {r.sample_id: r for r in gate.decide_arrays(gate.evaluated(df, checks), ["A"]).collect()}
    rows = gate.evaluate(df, checks)
    assert {k: tuple(r) for k, r in wide.items()} == {r.sample_id: tuple(r) for r in gate.decide(rows, ["A"]).collect()}
    assert {k: r.evaluation_complete for k, r in wide.items()} == {"a": True, "b": False, "c": False, "d": False}
    assert {r.why: r.n for r in gate.incomplete_reasons(rows).collect()} == {"complete": 1, "not_evaluated": 1, "unavailable": 2}
    assert {r.why: r.n for r in gate.unavailable_counts(gate.evaluated(df, checks), ["y"]).collect()} == {"y_unavailable": 2, "other": 1}
    nothing = {r.sample_id: r.evaluation_complete for r in gate.decide_arrays(gate.evaluated(df, checks[:1]), nothing="a").collect()}
    assert nothing == {"a": True, "b": False, "c": True, "d": False}


def test_percentiles_and_neighbours(spark):
    import numpy as np

    from tessella.operators import order

    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.integers(0, 40, 300)] + [("b", float(x)) for x in r.normal(size=77)] + [("c", 5.0), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0, 0.01, 0.33, 0.5, 0.95, 1]
    got = {x.g: x.q for x in order.percentiles(df, "v", points, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g], [100 * p for p in points]))
    assert got["d"] == [None] * 6
    assert np.allclose(order.percentiles(df, "v", points).first().q, np.percentile([v for _, v in rows if v is not None], [100 * p for p in points]))
    assert order.percentiles(df.limit(0), "v", [0.5]).first().q == [None]
    single = df.filter("v is not null").distinct()
    after = {(x.g, x.v): x.n for x in order.following(single, ["g"], "v", "n").collect()}
    for g in ("a", "b", "c", None):
        vs = sorted({v for k, v in rows if k == g})
        assert [after[g, v] for v in vs] == [*vs[1:], None]
