"""Policies: small documents that steer the operators, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from hashlib import sha256
import json

from pyspark.sql import DataFrame, SparkSession

POOLS = ("gold_candidate", "silver", "pseudo", "auxiliary", "external_holdout", "excluded")
SPLITS = ("train", "val", "test")
TASK_TYPES = ("binary", "multiclass", "multilabel", "detection", "segmentation")


@dataclass(frozen=True)
class DatasetRule:
    pool: str
    train: bool = True
    val: bool = True
    test: bool = True

    def __post_init__(self):
        if self.pool not in POOLS:
            raise ValueError(f"no such pool: {self.pool}")


@dataclass(frozen=True)
class CleaningPolicy:
    version: str = "1"
    within_dataset: bool = True
    singleton_groups: bool = True
    group_template: str = "dup::{dataset}::{md5}"
    tie_breakers: tuple[str, ...] = ("source_image_path",)
    datasets: Mapping[str, DatasetRule] = field(default_factory=dict)
    label_source_pools: Mapping[str, str] = field(default_factory=dict)
    tasks: tuple[str, ...] = ()
    default_pool: str = "excluded"

    def __post_init__(self):
        for pool in [*self.label_source_pools.values(), self.default_pool]:
            if pool not in POOLS:
                raise ValueError(f"no such pool: {pool}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r.pool, r.train, r.val, r.test) for k, r in self.datasets.items()]
        return spark.createDataFrame(rows, "dataset string, pool string, train boolean, val boolean, test boolean")


@dataclass(frozen=True)
class SplitPolicy:
    version: str = "1"
    seed: int = 20260813
    ratios: Mapping[str, float] = field(default_factory=lambda: {"train": 0.8, "val": 0.1, "test": 0.1})
    holdout_datasets: tuple[str, ...] = ()
    patient_datasets: tuple[str, ...] = ()
    excluded_pools: tuple[str, ...] = ("excluded", "external_holdout")
    core_tasks: tuple[str, ...] = ()

    def __post_init__(self):
        if tuple(self.ratios) != SPLITS or abs(sum(self.ratios.values()) - 1) > 1e-9 or min(self.ratios.values()) < 0:
            raise ValueError("ratios must be for train, val and test, and add up to 1")


@dataclass(frozen=True)
class Ontology:
    """Tasks: name -> (type, labels)."""

    version: str
    tasks: Mapping[str, tuple[str, tuple[str, ...]]]

    def problems(self) -> list[str]:
        out = [] if self.version else ["no version"]
        for name, (kind, labels) in self.tasks.items():
            if kind not in TASK_TYPES:
                out.append(f"{name}: unknown type {kind}")
            if not labels or len(set(labels)) != len(labels):
                out.append(f"{name}: labels are empty or not unique")
        return out


@dataclass(frozen=True)
class MappingItem:
    """What a source's key means: a direct label, or labels for yes and no; derived labels follow a yes."""

    task: str
    label: str | None = None
    positive: str | None = None
    negative: str | None = None
    status: str = "mapped"
    tier: str = "silver"
    derive: tuple[tuple[str, str], ...] = ()


def mapping_problems(ontology: Ontology, mapping: Mapping[str, MappingItem], strict: bool = False) -> list[str]:
    out = []
    for key, item in mapping.items():
        if item.status not in ("mapped", "excluded", "needs_review"):
            out.append(f"{key}: unknown status {item.status}")
        if item.status == "needs_review" and strict:
            out.append(f"{key}: needs review")
        for task, label in [(item.task, x) for x in (item.label, item.positive, item.negative) if x] + list(item.derive):
            if task not in ontology.tasks:
                out.append(f"{key}: unknown task {task}")
            elif label not in ontology.tasks[task][1]:
                out.append(f"{key}: unknown label {label} of {task}")
    return out


def overlay(default: Mapping, group: Mapping, item: Mapping) -> dict:
    """The item's entries over its group's over the defaults."""
    return {**default, **group, **{k: v for k, v in item.items() if v is not None}}


def document_hash(document: Mapping, digits: int = 12) -> str:
    return sha256(json.dumps(document, sort_keys=True, default=str).encode()).hexdigest()[:digits]
