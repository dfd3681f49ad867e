"""Leakage groups, stratified splits of groups, and what supervision each split may use."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators.graph import connected
from tessella.operators.order import running
from tessella.policy import SPLITS, SplitPolicy

HOLDOUT = "external_holdout"


def leakage_groups(samples: DataFrame, decided: DataFrame, raw: DataFrame, policy: SplitPolicy) -> DataFrame:
    """A group for each clean sample: samples that share a digest, or (in the policy's datasets) a patient of any of their aliases.

    A group with a sample of a holdout dataset is held out as a whole. A missing patient ties a sample to nobody.
    """
    clean = samples.select("sample_id", "dataset", "md5")
    nodes = clean.select(F.concat(F.lit("sample::"), "sample_id").alias("a"), F.concat(F.lit("md5::"), "md5").alias("b")).filter("b is not null")
    patients = (
        decided.select("sample_id", "canonical_sample_id")
        .join(raw.select("sample_id", "patient_id", F.col("dataset").alias("of")), "sample_id")
        .filter(F.col("of").isin(*policy.patient_datasets) & F.col("patient_id").isNotNull())
        .select(F.concat(F.lit("sample::"), "canonical_sample_id").alias("a"), F.concat(F.lit("patient::"), "of", F.lit("::"), "patient_id").alias("b"))
        .distinct()
    )
    roots = connected(nodes.unionByName(patients)).filter(F.col("node").startswith("sample::"))
    named = clean.join(roots.select(F.expr("substr(node, 9)").alias("sample_id"), "root"), "sample_id", "left").withColumn("root", F.coalesce("root", F.concat(F.lit("sample::"), "sample_id")))
    held = F.col("dataset").isin(*policy.holdout_datasets)
    groups = named.groupBy("root").agg(F.concat(F.lit("grp::"), F.min("sample_id")).alias("split_group_id"), F.bool_or(held).alias("held"))
    return named.join(groups, "root").select("sample_id", "dataset", "md5", "split_group_id", F.when(F.col("held"), HOLDOUT).alias("forced_split"))


def split_groups(grouped: DataFrame) -> DataFrame:
    """A row for each group."""
    return grouped.groupBy("split_group_id").agg(
        F.count("*").alias("n_samples"), F.countDistinct("md5").alias("n_digests"),
        F.array_join(F.sort_array(F.collect_set("dataset")), "|").alias("datasets"), F.max("forced_split").alias("forced_split"),
    )


def group_datasets(grouped: DataFrame) -> DataFrame:
    """(split_group_id, dataset, n): how many samples of each dataset a group has."""
    return grouped.groupBy("split_group_id", "dataset").agg(F.count("*").alias("n"))


def with_pools(groups: DataFrame, grouped: DataFrame, assigned: DataFrame) -> DataFrame:
    """Groups with flags for the pools that they hold."""
    has = grouped.select("sample_id", "split_group_id").join(assigned.select("sample_id", "supervision_pool"), "sample_id")
    pools = {"gold": "gold_candidate", "silver": "silver", "pseudo": "pseudo", "auxiliary": "auxiliary"}
    flags = has.groupBy("split_group_id").agg(*[F.bool_or(F.col("supervision_pool") == p).alias(f"contains_{k}") for k, p in pools.items()])
    return groups.join(flags, "split_group_id", "left").fillna(False, [f"contains_{k}" for k in pools])


def group_sizes(grouped: DataFrame) -> DataFrame:
    """By dataset: groups, groups of one, of several, the largest and the mean size."""
    per = grouped.groupBy("dataset", "split_group_id").agg(F.count("*").alias("n"))
    return per.groupBy("dataset").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"),
    )


def usable_facts(facts: DataFrame, assigned: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Facts of the core tasks whose (sample, task, label) is in no excluded pool."""
    core = facts.filter(F.col("canonical_task").isin(*policy.core_tasks)) if policy.core_tasks else facts
    barred = assigned.filter(F.col("supervision_pool").isin(*policy.excluded_pools)).select("sample_id", "canonical_task", "canonical_label").distinct()
    return core.join(barred, ["sample_id", "canonical_task", "canonical_label"], "left_anti")


def task_vectors(facts: DataFrame, grouped: DataFrame) -> DataFrame:
    """Facts counted by group; a fact of value 0 is one of its own."""
    fact = F.concat_ws(":", "canonical_task", X.norm_label("canonical_label"), F.when(F.col("value") == 0, F.lit("neg")))
    return facts.join(grouped.select("sample_id", "split_group_id"), "sample_id").groupBy("split_group_id", fact.alias("fact")).agg(F.count("*").alias("n"))


def _rank(seed: int, text: str) -> int:
    return int(hashlib.md5(f"{seed}::{text}".encode()).hexdigest()[:16], 16)


class _Greedy:
    """Groups are placed one after another where the shares of sizes, facts and datasets stay closest to the ratios.

    Rows come in their order with the totals that they need; what is held is a count for each split, fact and dataset.
    """

    def __init__(self, ratios: dict[str, float], seed: int):
        self.ratios, self.seed = ratios, seed

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(self.ratios)
        share = [self.ratios[s] for s in names]
        size = [0.0] * len(names)
        by_fact, by_data = defaultdict(lambda: [0] * len(names)), defaultdict(lambda: [0] * len(names))
        away = lambda held, whole: sum(abs(h - r * whole) for h, r in zip(held, share, strict=True))
        for batch in batches:
            chosen = []
            for row in batch.to_pylist():
                n, total, group, best = row["n_samples"], row["total"], row["split_group_id"], None
                datasets = [(by_data[x["dataset"]], x["n"], x["data_total"]) for x in row["x"]]
                facts = [(by_fact[f["fact"]], f["n"], f["fact_total"], f["holders"]) for f in row["f"]]
                for s, name in enumerate(names):
                    # only terms that this choice changes differ between the choices
                    change = 2 * (away([h + (j == s) * n for j, h in enumerate(size)], total) / total)
                    for held, v, fact_total, holders in facts:
                        change += (away([h + (j == s) * v for j, h in enumerate(held)], fact_total)) / fact_total
                        if holders == 1 and name == "train":
                            change -= 0.5
                        elif holders == 2 and name in ("train", "val"):
                            change -= 0.2
                    for held, v, data_total in datasets:
                        change += 1.5 * away([h + (j == s) * v for j, h in enumerate(held)], data_total) / data_total
                    mark = (round(change, 12), _rank(self.seed, f"{group}::{name}"), s)
                    if best is None or mark < best:
                        best = mark
                s = best[2]
                chosen.append(names[s])
                size[s] += n
                for held, v, *_ in datasets + facts:
                    held[s] += v
            yield pa.RecordBatch.from_arrays([batch.column("split_group_id").cast(pa.string()), pa.array(chosen, pa.string()), pa.array(["stratified"] * len(chosen), pa.string())], names=["split_group_id", "split", "split_reason"])


def assign_splits(groups: DataFrame, vectors: DataFrame, policy: SplitPolicy, datasets: DataFrame | None = None) -> DataFrame:
    """(split_group_id, split, split_reason): forced groups first, the others by greedy placement.

    datasets: group_datasets(), by which each dataset is balanced by itself; without it the groups' column `datasets` names one.

    Each choice depends on all before it, so one task places all groups, in order of their rarest fact; it reads them as
    a stream and holds counts only. Totals of sizes, facts and datasets and the holders of facts are aggregates.
    """
    free = groups.filter("forced_split is null").select("split_group_id", "n_samples", "datasets")
    if datasets is None:
        datasets = free.select("split_group_id", F.col("datasets").alias("dataset"), F.col("n_samples").alias("n"))
    parts = datasets.join(free.select("split_group_id"), "split_group_id")
    own = vectors.join(free.select("split_group_id"), "split_group_id")
    of_fact = own.groupBy(F.col("fact").alias("of")).agg(F.sum("n").alias("fact_total"), F.count("*").alias("holders"))
    of_data = parts.groupBy(F.col("dataset").alias("of")).agg(F.sum("n").alias("data_total"))
    whole = free.agg(F.sum("n_samples").alias("total"))
    # facts and datasets are as many as the counts that the placing task holds
    per = own.join(F.broadcast(of_fact), F.col("fact").eqNullSafe(F.col("of"))).groupBy("split_group_id").agg(F.sort_array(F.collect_list(F.struct("fact", "n", "fact_total", "holders"))).alias("f"), F.min("fact_total").alias("rarity"))
    of_group = parts.join(F.broadcast(of_data), F.col("dataset").eqNullSafe(F.col("of"))).groupBy("split_group_id").agg(F.sort_array(F.collect_list(F.struct("dataset", "n", "data_total"))).alias("x"))
    rows = free.join(of_group, "split_group_id").crossJoin(F.broadcast(whole)).join(per, "split_group_id", "left")
    rows = rows.select(
        "split_group_id", F.col("n_samples").cast("long").alias("n_samples"), "x", "total", F.coalesce("f", F.array().cast(per.schema["f"].dataType)).alias("f"),
        F.coalesce("rarity", F.lit(10**9)).alias("rarity"), F.md5(F.concat(F.lit(f"{policy.seed}::"), "split_group_id")).substr(1, 16).alias("at"),
    )
    ordered = rows.repartition(1).sortWithinPartitions("rarity", F.desc("n_samples"), "at", "split_group_id").drop("rarity", "at")
    placed = ordered.mapInArrow(_Greedy(dict(policy.ratios), policy.seed).place, "split_group_id string, split string, split_reason string")
    forced = groups.filter("forced_split is not null").select("split_group_id", F.col("forced_split").alias("split"), F.lit("forced").alias("split_reason"))
    return placed.unionByName(forced)


def unstratifiable(vectors: DataFrame, least: int = 3) -> DataFrame:
    """Facts that fewer groups hold than there are splits."""
    return vectors.groupBy("fact").agg(F.countDistinct("split_group_id").alias("n_groups"), F.sum("n").alias("n_facts")).filter(F.col("n_groups") < least)


def hash_splits(groups: DataFrame, policy: SplitPolicy) -> DataFrame:
    """A split without strata: by the group's hash alone, as a share of 2**32."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{policy.seed}::"), "split_group_id")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    a, b = policy.ratios["train"], policy.ratios["train"] + policy.ratios["val"]
    return groups.select("split_group_id", F.coalesce("forced_split", F.when(u < a, "train").when(u < b, "val").otherwise("test")).alias("split"))


def effective_supervision(assigned: DataFrame, splits: DataFrame) -> DataFrame:
    """assignments with the sample's split and what it may be used for there."""
    out = assigned.join(splits.select("sample_id", F.col("split").alias("sample_split")), "sample_id", "left")
    s, pool = F.col("sample_split"), F.col("supervision_pool")
    held, pseudo = (s == HOLDOUT) | (pool == HOLDOUT), pool == "pseudo"
    reason = (
        F.when(s.isNull(), "no_split").when(held, "external_holdout_only")
        .when(pseudo & (s == "train") & F.col("eligible_for_train"), "pseudo_train_only").when(pseudo, "pseudo_blocked_by_split")
        .when(s == "train", "split_aligned").when(s == "val", "val_evaluation_supervision").when(s == "test", "test_evaluation_supervision").otherwise("no_split")
    )
    open_ = ~F.coalesce(held, F.lit(False)) & s.isNotNull()
    flag = lambda name: (open_ & (s == name) & F.col(f"eligible_for_{name}") & (F.lit(name == "train") | ~pseudo)).alias(f"effective_for_{name}")
    return out.select(*assigned.columns, "sample_split", *[F.coalesce(flag(n), F.lit(False)).alias(f"effective_for_{n}") for n in SPLITS], reason.alias("effective_reason"))


def supervision_summary(samples: DataFrame, assigned: DataFrame) -> DataFrame:
    """Of each sample its pools, joined in order; none for a sample without."""
    per = assigned.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("supervision_pool")), "|").alias("summary"))
    return samples.select("sample_id").join(per, "sample_id", "left").select("sample_id", F.coalesce("summary", F.lit("none")).alias("supervision_summary"))


def split_report(splits: DataFrame) -> DataFrame:
    """By dataset: samples of each split, and the share of train among the regular ones."""
    n = splits.groupBy("dataset").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in (*SPLITS, HOLDOUT)], F.countDistinct("split_group_id").alias("n_groups"))
    regular = F.col("n_train") + F.col("n_val") + F.col("n_test")
    return n.withColumn("train_share", F.when(regular > 0, F.col("n_train") / regular))


def task_distribution(facts: DataFrame, splits: DataFrame) -> DataFrame:
    """By fact and split, and over all splits: positive and explicitly negative facts and the prevalence."""
    fact = F.concat_ws("::", "canonical_task", X.norm_label("canonical_label"))
    joined = facts.join(splits.select("sample_id", "split"), "sample_id").withColumn("fact", fact)
    out = joined.groupingSets([["fact", "split"], ["fact"]], "fact", "split").agg(
        F.count_if(F.col("value") == 1).alias("positive"), F.count_if(F.col("value") == 0).alias("explicit_negative"), F.grouping("split").alias("all_splits")
    )
    return out.select("fact", F.when(F.col("all_splits") == 1, "overall").otherwise(F.col("split")).alias("split"), "positive", "explicit_negative", (F.col("positive") / (F.col("positive") + F.col("explicit_negative"))).alias("prevalence"))


def prevalence_deviation(distribution: DataFrame, limit: float = 0.15) -> DataFrame:
    """By fact the distance between the splits' prevalences, and whether it is over the limit."""
    spread = F.max("prevalence") - F.min("prevalence")
    return distribution.filter("split <> 'overall'").groupBy("fact").agg(spread.alias("deviation")).withColumn("warning", F.col("deviation") > limit)


def leakage(splits: DataFrame, keys: tuple[str, ...] = ("sample_id", "split_group_id", "md5")) -> DataFrame:
    """For each key the number of its values that occur in more than one split."""
    out = None
    for key in keys:
        found = splits.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_leaks")).select(F.lit(key).alias("key"), "n_leaks")
        out = found if out is None else out.unionByName(found)
    return out


def balanced_batches(samples: DataFrame, per_domain: int, seed: int) -> DataFrame:
    """Batches with the same number of each domain, in hash order; what fills no batch is left out, as is the feature's sense."""
    drawn = samples.select("sample_id", "dataset", X.hash_hex(seed, "sample_id").alias("hash"), F.lit(1).cast("long").alias("one")).withColumn("by", F.conv(F.substring("hash", 1, 13), 16, 10).cast("long"))
    ranked = running(drawn, ["dataset"], "by", {"at": "one"}, ties=["hash", "sample_id"]).withColumn("batch", F.floor((F.col("at") - 1) / per_domain).cast("long"))
    full = samples.groupBy("dataset").agg(F.count("*").alias("n")).agg(F.floor(F.min("n") / per_domain).cast("long").alias("batches"))
    return ranked.crossJoin(F.broadcast(full)).filter("batch < batches").select("batch", "dataset", "sample_id")  # one row
