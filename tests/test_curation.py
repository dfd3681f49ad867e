"""Small frames with known answers, and invariants of the splits."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import curate, split, validate
from tessella.operators.graph import connected
from tessella.policy import CleaningPolicy, DatasetRule, Ontology, MappingItem, SplitPolicy, mapping_problems

S = "sample_id string, dataset string, md5 string, source_image_path string, patient_id string"
FACT = "canonical_sample_id string, origin_sample_id string, canonical_task string, canonical_label string, value int, supervision_tier string, label_source string, source_field string, source_label string, source_dataset string"


def samples(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], S)


def facts(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], FACT)


@pytest.mark.parametrize("order", [1, -1])
def test_the_first_path_stands_for_its_copies(spark, order):
    rows = [("x::b", "x", "m", "b.jpg"), ("x::a", "x", "m", "a.jpg"), ("y::c", "y", "m", "c.jpg")][::order]
    got = {r.sample_id: r for r in curate.decisions(samples(spark, *rows), CleaningPolicy()).collect()}
    assert got["x::a"].keep and not got["x::b"].keep and got["x::b"].canonical_sample_id == "x::a"
    assert got["y::c"].keep and not got["y::c"].is_duplicate and got["x::a"].duplicate_group_id == "dup::x::m"


def test_across_datasets_by_policy(spark):
    df = samples(spark, ("x::b", "x", "m", "b"), ("y::a", "y", "m", "a"))
    assert curate.decisions(df, CleaningPolicy(within_dataset=False)).filter("keep").count() == 1
    assert [(r.datasets, r.n_samples) for r in curate.collisions(df).collect()] == [("x|y", 2)]


def test_groups_of_one_may_have_no_id(spark):
    df = samples(spark, ("x::b", "x", "m", "b"), ("x::a", "x", "n", "a"), ("x::c", "x", "n", "c"))
    assert curate.decisions(df, CleaningPolicy(singleton_groups=False)).count() == 2


def test_facts_of_aliases_come_together(spark):
    moved = facts(spark, ("a", "a", "crack", "true", 1, "silver"), ("a", "b", "mark", "true", 1, "silver"), ("a", "a", "pale", "is", 1, "silver"), ("a", "b", "pale", "is", 1, "gold"))
    got = {(r.canonical_task, r.supervision_tier): r for r in curate.reconciled(moved).collect()}
    assert len(got) == 4 and got["crack", "silver"].n_origins == 1


def test_the_same_fact_twice_is_one(spark):
    moved = facts(spark, ("a", "a", "t", " TRUE ", 1, "silver", "h"), ("a", "b", "t", "true", 1, "silver", "h"))
    (r,) = curate.reconciled(moved).collect()
    assert (r.label, r.origins, r.n_facts) == ("true", "a|b", 2)


def test_a_conflict_takes_only_its_own_fact(spark):
    moved = facts(spark, ("a", "a", "t", "pale", 1), ("a", "b", "t", "pale", 0), ("a", "a", "t", "red", 1))
    assert [r.label for r in curate.reconciled(moved).collect()] == ["red"]
    assert [(r.label, r["values"], r.origins) for r in curate.value_conflicts(moved).collect()] == [("pale", "0|1", "a|b")]


def test_true_and_false(spark):
    one = facts(spark, ("a", "a", "t", "true", 1), ("a", "a", "t", "false", 1))
    assert curate.binary_conflicts(one).count() == 0  # one origin says both
    two = facts(spark, ("a", "a", "t", "true", 1), ("a", "b", "t", "FALSE", 1), ("a", "b", "u", "x", 1))
    assert curate.binary_conflicts(two).count() == 1
    assert [r.canonical_task for r in curate.reconciled(two).collect()] == ["u"]


def test_boxes(spark):
    b = "canonical_sample_id string, origin_sample_id string, annotation_id string, annotation_task string, canonical_label string, annotation_type string, mask_path string, x_min double, y_min double, x_max double, y_max double"
    df = spark.createDataFrame([("a", "a", "1", "t", "l", "bbox", None, 0.0, 0.0, 1.0, 1.0), ("a", "b", "2", "t", "l", "bbox", None, 0.0, 0.0, 1.00000001, 1.0), ("a", "a", "3", "t", "l", "bbox", None, 0.0, 0.0, 2.0, 1.0)], b)
    got = sorted((r.ordinal, r.origins) for r in curate.reconciled_spatial(df).collect())
    assert got == [(0, "a|b"), (1, "a")]
    assert [r.n_instances for r in curate.multi_instances(curate.reconciled_spatial(df)).collect()] == [2]


def test_pools(spark):
    policy = CleaningPolicy(datasets={"x": DatasetRule("silver"), "h": DatasetRule("external_holdout")}, tasks=("t",))
    unit = "sample_id string, origin_sample_id string, dataset string, canonical_task string, canonical_label string, label_source string, supervision_tier string"
    labels = spark.createDataFrame([("1", "1", "x", "t", "l", "human", "s"), ("2", "2", "x", "t", "l", "model_prediction", "s"), ("3", "3", "x", "u", "l", "human", "s"), ("4", "4", "h", "t", "l", "human", "s"), ("5", "5", "x", "u", "l", "model_prediction", "s"), ("6", "6", "z", "t", "l", "human", "s")], unit)
    spatial = spark.createDataFrame([("1", "1", "x", "t", "l", "unknown_mask_origin", "s")], unit.replace("canonical_task", "annotation_task"))
    own = samples(spark, *[(str(i), "x", "m", "p") for i in range(1, 8)])
    got = {(r.sample_id, r.unit_type): r for r in curate.assignments(labels, spatial, own, policy).collect()}
    pool = {k: r.supervision_pool for k, r in got.items()}
    assert pool == {("1", "label"): "silver", ("2", "label"): "pseudo", ("3", "label"): "excluded", ("4", "label"): "external_holdout", ("5", "label"): "pseudo", ("6", "label"): "excluded", ("1", "spatial"): "auxiliary", ("7", "sample"): "silver"}
    assert got["2", "label"].eligible_for_train and not got["2", "label"].eligible_for_test
    assert not got["4", "label"].eligible_for_train and got["4", "label"].eligible_for_test
    assert not got["5", "label"].eligible_for_train


def _grouped(spark, raw, policy):
    own = samples(spark, *raw)
    decided = curate.decisions(own, CleaningPolicy())
    return split.leakage_groups(curate.clean_samples(own, decided), decided, own, policy)


def test_patients_tie_samples(spark):
    policy = SplitPolicy(patient_datasets=("x",), holdout_datasets=("h",))
    raw = [("1", "x", "a", "1", "p"), ("2", "x", "b", "2", "p"), ("3", "x", "c", "3", None), ("4", "x", "d", "4", None), ("5", "x", "e", "5", "q"), ("6", "x", "e", "6", "r"), ("7", "x", "f", "7", "r"), ("8", "h", "g", "8"), ("9", "x", "g", "9")]
    got = {r.sample_id: r for r in _grouped(spark, raw, policy).collect()}
    g = {k: r.split_group_id for k, r in got.items()}
    assert g["1"] == g["2"] == "grp::1" and g["3"] != g["4"]
    assert g["5"] == g["7"] and "6" not in g  # an alias's patient counts
    assert g["8"] == g["9"] and got["9"].forced_split == "external_holdout"


def test_components_of_a_long_chain_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)], "a int, b int")
    assert {r.root for r in connected(edges).collect()} == {0, 100} and connected(edges).count() == 61 + 60


def test_greedy_split_keeps_ratios_and_groups(spark):
    groups = spark.range(200).selectExpr("concat('grp::', id) as split_group_id", "1 + id % 3 as n_samples", "if(id % 4 = 0, 'x', 'y') as datasets", "if(id = 0, 'external_holdout', null) as forced_split")
    vectors = spark.range(200).selectExpr("concat('grp::', id) as split_group_id", "concat('f', id % 5) as fact", "1 as n").unionByName(spark.createDataFrame([("grp::9", "rare", 1)], "split_group_id string, fact string, n int"))
    policy = SplitPolicy()
    a = {r.split_group_id: r.split for r in split.assign_splits(groups, vectors, policy).collect()}
    assert a == {r.split_group_id: r.split for r in split.assign_splits(groups, vectors, policy).collect()}
    assert a["grp::0"] == "external_holdout" and len(a) == 200
    size = {r.split_group_id: r.n_samples for r in groups.collect()}
    total = sum(size.values()) - size["grp::0"]
    assert abs(sum(n for g, n in size.items() if a[g] == "train") / total - 0.8) < 0.03
    assert [r.fact for r in split.unstratifiable(vectors).collect()] == ["rare"]
    assert a["grp::9"] == "train"


def test_many_groups_are_placed_by_global_counts(spark):
    n, facts = 50_200, 30
    groups = spark.range(n).selectExpr("concat('grp::', id) as split_group_id", "1 as n_samples", "'x' as datasets", "cast(null as string) as forced_split")
    vectors = spark.range(4 * facts).selectExpr("concat('grp::', id * 400) as split_group_id", "concat('f', id % 30) as fact", "1 as n")
    placed = split.assign_splits(groups, vectors, SplitPolicy())
    got = vectors.join(placed, "split_group_id").groupBy("fact").agg(F.count_if(F.col("split") == "train").alias("train"), F.count("*").alias("n")).collect()
    # of four groups that hold a fact the fourth is better off outside train
    assert len(got) == facts and {(r.train, r.n) for r in got} == {(3, 4)}


def test_leaks_are_counted_and_found(spark):
    t = spark.createDataFrame([("1", "g", "m", "train"), ("2", "g", "n", "test"), ("3", "h", "m", "odd"), ("3", "h", "o", "odd")], "sample_id string, split_group_id string, md5 string, split string")
    assert {r.key: r.n_leaks for r in split.leakage(t).collect()} == {"sample_id": 0, "split_group_id": 1, "md5": 1}
    assert sorted(r.rule for r in validate.splits(t).collect()) == ["md5_in_one_split", "sample_id_unique", "split_group_id_in_one_split", "split_is_known", "split_is_known"]
    with pytest.raises(ValueError, match="sample_id_unique"):
        validate.assert_empty(validate.splits(t).filter("rule = 'sample_id_unique'"))


def test_masks(spark):
    m = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "x"), ("c", "x"), ("c", "y")], "canonical_sample_id string, origin_sample_id string")
    got = sorted((r.canonical_sample_id, r.origin_sample_id, r.resolution, r.kept) for r in curate.resolved_masks(m).collect())
    assert got == [("a", "a", "single", True), ("b", "b", "own_origin", True), ("b", "x", "dropped", False), ("c", "x", "unresolved", False), ("c", "y", "unresolved", False)]


def test_policies_are_checked():
    with pytest.raises(ValueError, match="pool"):
        DatasetRule("golden")
    with pytest.raises(ValueError, match="ratios"):
        SplitPolicy(ratios={"train": 0.5, "val": 0.1, "test": 0.1})
    o = Ontology("1", {"t": ("binary", ("a", "b")), "u": ("odd", ())})
    assert len(o.problems()) == 2
    assert mapping_problems(o, {"k": MappingItem("t", "c"), "l": MappingItem("v", "a", status="needs_review")}, strict=True) == ["k: unknown label c of t", "l: needs review", "l: unknown task v"]


def _placed(groups, vectors, datasets, ratios, seed):
    """The rule by its definition: each group goes where the sum of all penalties is least."""
    import hashlib

    names, mark = list(ratios), lambda t: int(hashlib.md5(f"{seed}::{t}".encode()).hexdigest()[:16], 16)
    whole, facts, data = sum(groups.values()), {}, {}
    for g, own in vectors.items():
        for f, n in own.items():
            facts.setdefault(f, {})[g] = n
    for own in datasets.values():
        for x, n in own.items():
            data[x] = data.get(x, 0) + n
    rarity = lambda g: min((sum(facts[f].values()) for f in vectors.get(g, {})), default=10**9)
    size = dict.fromkeys(names, 0)
    held = {s: {} for s in names}
    out = {}
    for g in sorted(groups, key=lambda g: (rarity(g), -groups[g], mark(g))):
        best = None
        for i, s in enumerate(names):
            score = 2 * sum(abs((size[t] + (t == s) * groups[g]) / whole - ratios[t]) for t in names)
            for weight, own, totals in ((1, vectors.get(g, {}), {f: sum(x.values()) for f, x in facts.items()}), (1.5, datasets[g], data)):
                score += weight * sum(abs(held[t].get(k, 0) + (t == s) * n - ratios[t] * totals[k]) / totals[k] for k, n in own.items() for t in names)
            for f in vectors.get(g, {}):
                score -= 0.5 * (len(facts[f]) == 1 and s == "train") + 0.2 * (len(facts[f]) == 2 and s in ("train", "val"))
            if best is None or (round(score, 9), mark(f"{g}::{s}"), i) < best:
                best = (round(score, 9), mark(f"{g}::{s}"), i)
        s = out[g] = names[best[2]]
        size[s] += groups[g]
        for own in (vectors.get(g, {}), datasets[g]):
            for k, n in own.items():
                held[s][k] = held[s].get(k, 0) + n
    return out


def test_groups_of_several_datasets_are_balanced_by_each(spark):
    import random

    r = random.Random(1)
    datasets = {f"grp::{i}": {d: r.randint(1, 4) for d in r.sample(["x", "y", "z"], r.randint(1, 3))} for i in range(120)}
    groups = {g: sum(own.values()) for g, own in datasets.items()}
    vectors = {g: {f"f{r.randint(0, 9)}": r.randint(1, 3)} for g in list(groups)[:70]}
    vectors["grp::3"] = {"rare": 1}
    policy = SplitPolicy()
    table = spark.createDataFrame([(g, n, "|".join(sorted(datasets[g])), None) for g, n in groups.items()], "split_group_id string, n_samples long, datasets string, forced_split string")
    facts = spark.createDataFrame([(g, f, n) for g, own in vectors.items() for f, n in own.items()], "split_group_id string, fact string, n long")
    parts = spark.createDataFrame([(g, d, n) for g, own in datasets.items() for d, n in own.items()], "split_group_id string, dataset string, n long")
    got = {x.split_group_id: x.split for x in split.assign_splits(table, facts, policy, parts).collect()}
    assert got == _placed(groups, vectors, datasets, policy.ratios, policy.seed)
