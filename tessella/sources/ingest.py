"""Scans of files and folders into the tables of the data model."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.policy import MappingItem


def files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(path, length, md5) of the files under a folder, junk left out; bytes never leave the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = raw.filter(~X.is_skipped("path"))
    return kept.select("path", "length", *([F.md5("content").alias("md5")] if content else []))


def delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A table of text whose delimiter (tab, comma, semicolon, else white space) its first line tells."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    sep = next((s for s in ("\t", ",", ";") if s in line), None)
    if sep:
        return spark.read.option("header", header).option("sep", sep).csv(path)
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).filter("c[0] <> ''")
    names = line.split() if header else [f"_c{i}" for i in range(len(line.split()))]
    body = rows.filter(F.col("c") != F.array(*[F.lit(n) for n in names])) if header and names else rows
    return body.select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cells) of every line that is not blank, cut at tabs where it has any, else at commas."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.transform(F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split("value", ",")), F.trim).alias("cells"))


def sample_rows(found: DataFrame, dataset: str, root: str) -> DataFrame:
    """Files as samples; ids are paths below the root."""
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return found.withColumn("rel", relative).select(X.sample_id(F.lit(dataset), "rel").alias("sample_id"), F.lit(dataset).alias("dataset"), "md5", F.col("path").alias("source_image_path"), X.infer_split("rel").alias("source_split"), X.stem("rel").alias("stem"), X.path_part("rel", 2).alias("folder"))


def paired_masks(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with their masks by stem, warnings for images without and for masks without an image)."""
    m = masks.select("stem", F.col("source_image_path").alias("mask_path"))
    both = images.select("sample_id", "stem").join(m, "stem", "full_outer")
    warnings = both.filter("mask_path is null or sample_id is null").select("stem", F.when(F.col("mask_path").isNull(), "mask_missing").otherwise("image_missing").alias("warning"))
    return images.join(m, "stem", "left"), warnings


def folder_labels(samples: DataFrame, mapping: Mapping[str, MappingItem]) -> tuple[DataFrame, DataFrame]:
    """Facts from the names of folders."""
    return mapped_facts(samples.select("sample_id", F.col("folder").alias("source_field"), F.lit("1").alias("source_value")), mapping)


def mapped_facts(values: DataFrame, mapping: Mapping[str, MappingItem]) -> tuple[DataFrame, DataFrame]:
    """(facts, warnings) of values(sample_id, source_field, source_value).

    No value makes no fact: what is not known is not negative. A yes makes the positive label, or the direct one; a no makes
    the negative label with value 1 where there is one, else the positive label with value 0. Derived labels follow where the
    value is 1. Fields that are not mapped, or need review, make warnings; excluded ones make nothing.
    """
    spark = values.sparkSession
    rows = [(k, m.task, m.label, m.positive, m.negative, m.status, m.tier, [list(d) for d in m.derive]) for k, m in mapping.items()]
    table = spark.createDataFrame(rows, "source_field string, task string, label string, positive string, negative string, status string, tier string, derive array<array<string>>")
    known = values.withColumn("source_value", X.normalize_na("source_value")).filter("source_value is not null")
    joined = known.join(F.broadcast(table), "source_field", "left")  # a policy document
    warnings = joined.filter("status is null or status = 'needs_review'").groupBy("source_field").agg(F.count("*").alias("n")).withColumn("warning", F.lit("not_mapped"))
    yes = X.truth("source_value") == 1
    label = F.when(F.col("label").isNotNull(), F.col("label")).when(yes, F.col("positive")).when(F.col("negative").isNotNull(), F.col("negative")).otherwise(F.col("positive"))
    value = F.when(F.col("label").isNotNull() | yes | F.col("negative").isNotNull(), 1).otherwise(0)
    own = joined.filter("status = 'mapped'").withColumn("canonical_label", label).withColumn("value", value).filter("canonical_label is not null")
    more = own.filter("value = 1").select("sample_id", "source_field", "tier", F.explode("derive").alias("d")).select("sample_id", F.col("d")[0].alias("canonical_task"), F.col("d")[1].alias("canonical_label"), F.lit(1).alias("value"), "source_field", F.lit("derived").alias("note"), F.col("tier").alias("supervision_tier"))
    note = F.when(F.col("value") == 0, "explicit_negative")
    facts = own.select("sample_id", F.col("task").alias("canonical_task"), "canonical_label", "value", "source_field", note.alias("note"), F.col("tier").alias("supervision_tier"))
    return facts.unionByName(more), warnings


def yolo_boxes(spark: SparkSession, folder: str, names: Mapping[int, str], images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, warnings) of label files `class xc yc w h` joined by stem to images(stem, width, height)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).select(X.stem(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("c")).filter("c[0] <> ''")
    cast = lines.select("stem", F.size("c").alias("n"), F.col("c")[0].try_cast("int").alias("k"), *[F.get("c", F.lit(i)).try_cast("double").alias(f"v{i}") for i in range(1, 5)])
    fine = (F.col("n") == 5) & F.col("k").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull() & F.col("v4").isNotNull()
    box = X.yolo_box(F.col("v1"), F.col("v2"), F.col("v3"), F.col("v4"), F.col("width"), F.col("height"))
    named = X.lookup(F.col("k").cast("string"), {str(k): v for k, v in names.items()})
    good = cast.filter(fine).join(images.select("stem", "width", "height"), "stem").select("stem", named.alias("canonical_label"), *[v.alias(k) for k, v in box.items()])
    bad = cast.filter(~F.coalesce(fine, F.lit(False))).groupBy("stem").agg(F.count("*").alias("n")).withColumn("warning", F.lit("bad_row"))
    return good, bad


def wide_labels(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A wide table of labels in long form: every row speaks."""
    return table.unpivot([key], columns, "source_field", "source_value")


def first_rows(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return table.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_at = 1").drop("_at")


def fuzzy_matches(keys: DataFrame, rid: str, names: DataFrame, stem: str) -> DataFrame:
    """(key, stem, how): equal ones, and for the rest the only stem that holds the key or is held by it.

    Containment is found by shared 3-grams: a key of three characters or more that holds another shares its first 3-gram;
    only shorter ones are compared with all, which is a bounded set of texts under three characters.
    """
    k, s = keys.select(F.col(rid).alias("rid")).distinct(), names.select(F.col(stem).alias("stem")).distinct()
    exact = k.join(s, F.col("rid") == F.col("stem")).select("rid", "stem", F.lit("exact").alias("how"))
    rest = k.join(exact.select("rid"), "rid", "left_anti")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, 3))))
    long_k, long_s = rest.filter(F.length("rid") >= 3), s.filter(F.length("stem") >= 3)
    inside = long_k.withColumn("g", F.substring("rid", 1, 3)).join(long_s.withColumn("g", grams("stem")), "g").filter(F.contains("stem", F.col("rid")))
    around = long_s.withColumn("g", F.substring("stem", 1, 3)).join(long_k.withColumn("g", grams("rid")), "g").filter(F.contains("rid", F.col("stem")))
    short = rest.filter(F.length("rid") < 3).join(s, F.contains("stem", F.col("rid"))).select("rid", "stem").unionByName(long_k.join(s.filter(F.length("stem") < 3), F.contains("rid", F.col("stem"))).select("rid", "stem"))
    pairs = inside.select("rid", "stem").unionByName(around.select("rid", "stem")).unionByName(short).distinct()
    only = pairs.groupBy("rid").agg(F.count("*").alias("n"), F.min("stem").alias("stem")).filter("n = 1").select("rid", "stem", F.lit("contained").alias("how"))
    return exact.unionByName(only)


ADAPTERS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"paired_mask": paired_masks, "folder": folder_labels, "yolo": yolo_boxes, "mapped": mapped_facts}


def adapter(name: str) -> Callable[..., tuple[DataFrame, DataFrame]]:
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]
