"""Queries of scalar functions, manifests, reports, audits and picture kernels, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import kernels
from tessella.functions import scalars as X
from tessella.operators import audit, calibrate, curate, gate, manifests, metrics, reports, validate
from tessella.plans import bindings as B
from tessella.plans import curation as C
from tessella.plans import evaluation as E

TRUTH_WORDS = ("TRUE", " yes", "positive", "1", "1.9", "0", "no", "2", "nan?", "False")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def c1_sample_id(s, d):
    return B.table(s, d, "pages").select("page_id", X.sample_id(F.lit("web"), F.replace("url", F.lit("/"), F.lit("\\"))).alias("sample_id"))


def c2_null_tokens(s, d):
    word = F.element_at(F.array(*[F.lit(w) for w in (" NA ", "n/a", "NaN", "None", "null", "", "nan0", " x ")]), (F.col("event_id") % 8 + 1).cast("int"))
    return B.table(s, d, "events").select("event_id", X.normalize_na(word).alias("value"))


def c9_sample_seed(s, d):
    return B.table(s, d, "customer").select("c_custkey", X.sample_seed("c_name", 17).alias("seed"))


def c10_strict_flag(s, d):
    word = F.when(F.col("event_id") % 3 == 0, " Yes").when(F.col("event_id") % 3 == 1, "0").otherwise("TRUE")
    return B.table(s, d, "events").select("event_id", X.strict_flag(word).alias("flag"), X.truth(F.element_at(F.array(*[F.lit(w) for w in TRUTH_WORDS]), (F.col("event_id") % 10 + 1).cast("int"))).alias("truth"))


def c11_bands(s, d):
    return B.scores(s, d).select("sample_id", X.band("score", 0.3, 0.7).alias("finding"), X.band(F.when(F.col("score") < 0.9, F.col("score")), 0.3, 0.7, ("clear", "uncertain", "stain")).alias("band"))


def c14_yolo_boxes(s, d):
    li = B.table(s, d, "lineitem").withColumn("w", (F.col("l_partkey") % 50 + 100).cast("int")).withColumn("h", (F.col("l_suppkey") % 40 + 60).cast("int"))
    box = X.yolo_box(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50, F.col("l_tax") * 5 + 0.1, F.col("w"), F.col("h"))
    out = li.select("l_orderkey", "l_linenumber", "w", "h", *[v.alias(k) for k, v in box.items()])
    ratios = X.box_ratios(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max"), F.col("w"), F.col("h"))
    return _rounded(out.select("l_orderkey", "l_linenumber", "x_min", "y_min", "x_max", "y_max", *[v.alias(k) for k, v in ratios.items()]), "x_min", "y_min", "x_max", "y_max", "bbox_width_ratio", "bbox_height_ratio", "bbox_area_ratio")


def c17_expanded_boxes(s, d):
    li = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 1).alias("x0"), F.lit(3.0).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), F.lit(40.0).alias("y1"))
    box = X.expand_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(60), F.lit(45), 0.15)
    return li.select("l_orderkey", "l_linenumber", *[v.cast("long").alias(k) for k, v in box.items()])


GUIDANCE = {"BLUR": "hold still", "CAST": "use daylight"}


def c24_guidance(s, d):
    rows = gate.decide_arrays(E._arrays(s, d), E.PRIORITY)
    each = rows.select("sample_id", F.explode(F.split("reasons", r"\|")).alias("reason")).filter("reason <> ''")
    return each.select("sample_id", X.lookup("reason", GUIDANCE, "try again").alias("guidance")).distinct()


def c29_warmup(s, d):
    return B.table(s, d, "part").select("p_partkey", F.round(X.warmup("p_partkey", 150), 9).alias("linear"), F.round(X.warmup("p_partkey", 150, "sigmoid"), 9).alias("smooth"), F.round(X.logistic(F.col("p_size") / 10.0), 9).alias("logistic"))


def d4_calibration_rows(s, d):
    own = B.scores(s, d).withColumn("split", F.when(F.col("source") < "src2", "train").otherwise("val"))
    return calibrate.no_test(own).groupBy("split").agg(F.count("*").alias("n"))


def d9_finite(s, d):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).when(F.col("event_id") % 5 == 2, None).otherwise(F.col("value"))
    return B.table(s, d, "events").withColumn("x", x).filter(X.finite("x")).select("event_id", "x")


def e1_labels_on_canonical(s, d):
    facts = B.labels(s, d).select("sample_id", "canonical_task", "value")
    return curate.on_canonical(facts, C._decided(s, d)[1]).select("origin_sample_id", "canonical_sample_id", "canonical_task", "value", "duplicate_group_id")


def f16_class_quantiles(s, d):
    out = metrics.quantile_summary(B.scores(s, d), "score", ["label"], (5, 50, 95))
    return _rounded(out.select("label", "count", "mean", "std", "min", "max", "p05", "p50", "p95"), "mean", "std", "p05", "p50", "p95")


def f21_class_balance(s, d):
    own = B.scores(s, d).withColumn("split", F.when(F.col("source") < "src3", "train").otherwise("val"))
    return _rounded(reports.class_balance(own), "positive_rate")


def f23_top_collisions(s, d):
    return curate.top_collisions(curate.collisions(B.samples(s, d).withColumn("dataset", F.col("source"))), 10)


def f25_supervision_counts(s, d):
    return reports.supervision_counts(B.labels(s, d))


def f31_running_means(s, d):
    return _rounded(reports.running_means(B.features(s, d), ["chars", "words", "lines"]), "chars", "words", "lines")


def g6_ranked_candidates(s, d):
    t = B.table(s, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("a"), (F.col("n_nationkey") % 3).alias("b"))
    return gate.ranked_candidates(t, {"a": (True, -1), "b": (False, 99)}, "n_name")


def g9_round_robin(s, d):
    return reports.round_robin(B.samples(s, d).select("dataset", "sample_id"), 10)


def g9_heads(s, d):
    return reports.heads(B.samples(s, d).select("dataset", "sample_id"), {"en": 3, "fr": 2})


def h2_largest_effects(s, d):
    return reports.largest_effects(E.p1_cohens_d(s, d).select("feature", "d"), 2)


def h8_review_lists(s, d):
    own = B.features(s, d)
    return reports.review_lists(own, {"longest": ("chars", True), "fewest_lines": ("lines", False), "most_stops": ("stops", True)}, 5).withColumn("value", F.round("value", 6))


def _mask_rows(s, d):
    """Lines of orders as masks of documents; some have two, or none of their own."""
    docs = B.samples(s, d).select("doc_id", "sample_id")
    li = B.table(s, d, "lineitem").filter("l_linenumber <= 2").select(
        (F.col("l_orderkey") % 250).alias("doc_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("annotation_id"), F.when(F.col("l_orderkey") % 11 != 3, F.concat(F.lit("m/"), F.col("l_orderkey").cast("string"))).alias("mask_path"),
        F.lit("region").alias("annotation_task"), F.when(F.col("l_orderkey") % 2 == 0, "mask").otherwise("bbox").alias("annotation_type"), (F.col("l_quantity") / 50 - 0.1).alias("foreground_ratio"), (F.col("l_linenumber") == 1).alias("own"),
    ).filter("l_orderkey < 270")
    both = li.join(docs, "doc_id", "left").select(F.coalesce("sample_id", F.concat(F.lit("lost::"), F.col("doc_id").cast("string"))).alias("sample_id"), "annotation_id", "mask_path", "annotation_task", "annotation_type", F.when(F.col("doc_id") % 13 == 5, "other").otherwise("here").alias("source_dataset"), "foreground_ratio", "own")
    return both.withColumn("origin_sample_id", F.when(F.col("own"), F.col("sample_id")).otherwise("elsewhere")).withColumn("mask_width", F.lit(100)).withColumn("mask_height", F.lit(100)).drop("own")


def _manifest(s, d):
    own = B.samples(s, d).withColumn("width", F.when(F.col("doc_id") % 17 == 0, 99).otherwise(100)).withColumn("height", F.lit(100))
    splits = own.select("sample_id", F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 == 7, "val").when(F.col("doc_id") % 10 == 8, "odd").otherwise("test").alias("split"), F.col("md5").alias("split_group_id")).filter("substr(sample_id, 5) <> '42'")
    assigned = own.filter("doc_id % 3 = 0").select("sample_id", F.lit("spatial").alias("unit_type"), F.lit("region").alias("canonical_task"), F.lit("silver").alias("supervision_pool"))
    masks = manifests.mask_candidates(_mask_rows(s, d), "region", "mask", ["here"])
    return manifests.segmentation(masks, own, splits, assigned, "region")


def k11_segmentation_manifest(s, d):
    return _manifest(s, d).select("sample_id", "annotation_id", "split", "supervision_pool", F.round("foreground_ratio", 6).alias("foreground_ratio"), "problem")


def k11_segmentation_audit(s, d):
    return _rounded(manifests.segmentation_audit(_manifest(s, d)), "pairing_rate")


def l5_segmentation_violations(s, d):
    return manifests.segmentation_violations(_manifest(s, d))


def _labelled(s, d):
    own = B.samples(s, d)
    splits = own.select("sample_id", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val").alias("split"))
    labels = B.labels(s, d).filter("canonical_task = 'quality'").select("sample_id", F.col("canonical_task"), F.when(F.col("value") == 1, " Good").otherwise("bad ").alias("canonical_label"))
    return manifests.labelled(own, labels, splits, "en", "quality", "good", "bad"), labels


def k12_labelled_manifest(s, d):
    return _labelled(s, d)[0].select("sample_id", "md5", "label", "split", "eligible", "exclusion_reason")


def k12_labelled_violations(s, d):
    return manifests.labelled_violations(_labelled(s, d)[0], _labelled(s, d)[1], ["quality"]).distinct()


def k13_preflight(s, d):
    rows = _labelled(s, d)[0]
    found = rows.filter("doc_id % 7 <> 0").select("sample_id", (F.col("doc_id") % 5 != 0).alias("ok"), F.lit("too small").alias("reason"))
    return _rounded(manifests.with_preflight(rows, found, 0.9)[1], "rate")


def k14_confounding_manifest(s, d):
    rows = _labelled(s, d)[0].withColumn("eligible", F.col("doc_id") % 4 != 0).withColumn("source_image_path", F.concat_ws("/", F.lit("root"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".JPG"))))
    return manifests.confounding(rows, "train").select("sample_id", "label", "folder_batch", "file_extension")


def i2_diagnosis_pool(s, d):
    a, b = B.scores(s, d).filter("dataset = 'en'").select("sample_id", "score", "label"), B.scores(s, d).filter("dataset = 'fr'").select("sample_id", "score")
    return manifests.diagnosis_pool({"known": a, "other": b}).groupBy("domain_group").agg(F.count("*").alias("n"), F.count("label").alias("n_labels"))


def l3_clean_violations(s, d):
    own, decided = C._decided(s, d)
    decided = decided.withColumn("keep", F.col("keep") & ~F.col("sample_id").endswith("00"))
    facts = B.line_facts(s, d).withColumnRenamed("canonical_sample_id", "sample_id").select("sample_id", "canonical_task", "canonical_label").filter("canonical_task = 'A'")
    conflicts = curate.value_conflicts(B.line_facts(s, d)).select("canonical_sample_id", "canonical_task", "label")
    assigned = C._assigned(s, d).withColumn("eligible_for_train", F.lit(True))
    return validate.clean(curate.clean_samples(own, C._decided(s, d)[1]), decided, facts.limit(0), conflicts, assigned)


def l8_check_violations(s, d):
    rows = E._rows(s, d).withColumn("finding", F.when(F.col("check_id") == "later", "true").otherwise(F.col("finding"))).withColumn("reason_code", F.when(F.col("score") != 0.09, F.col("reason_code")))
    return validate.checks(rows).groupBy("rule").agg(F.count("*").alias("n"))


def n2_frozen_thresholds(s, d):
    own = B.scores(s, d).withColumn("finding", X.band("score", 0.25, 0.75))
    return own.groupBy("dataset", "finding").agg(F.count("*").alias("n"))


def n5_tail_proposals(s, d):
    return _rounded(reports.tail_proposals(B.features(s, d), "stops"), "warning", "retake", "p50", "p95")


def n8_sweep_rates(s, d):
    li = E._gate_features(s, d).withColumn("discount", F.col("discount") * 1.1)
    rows = gate.evaluate(li, [c for c in E.checks() if c.name == "cast"]).join(B.table(s, d, "lineitem").select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("sample_id"), F.col("l_returnflag").alias("direction"), F.col("l_linestatus").alias("strength")), "sample_id")
    return _rounded(reports.sweep_rates(rows), "detection_rate", "retake_rate")


def o7_ranking_summary(s, d):
    out = reports.ranking_summary(B.scores(s, d))
    return _rounded(out, *out.columns)


def o10_evaluation_report(s, d):
    images = B.scores(s, d).select("sample_id", "dataset", F.col("score").alias("dice"), (F.col("score") < 0.05).alias("empty_prediction"), (F.col("score") > 0.95).alias("near_full_prediction"))
    return _rounded(reports.evaluation_report(images), "mean", "p05", "p50", "p95", "gap")


def o14_frozen_test(s, d):
    out = reports.frozen_test(B.scores(s, d), 0.3, 0.7, {"auroc": 0.9}, {"auroc": 0.2, "stain_precision": 0.1, "stain_recall": 0.1, "clear_purity": 0.1})
    return _rounded(out.select("auroc", "stain_precision", "stain_recall", "clear_purity", "coverage", "false_negatives", "false_positives", "status", "low_coverage"), "auroc", "stain_precision", "stain_recall", "clear_purity", "coverage")


def e7_ranking_by_stratum(s, d):
    own = B.scores(s, d)
    strata = own.filter("source <> 'src1'").select("sample_id", F.when(F.col("n_chars") % 3 == 0, "pass").when(F.col("n_chars") % 3 == 1, "warning").otherwise("retake").alias("decision"))
    return _rounded(reports.ranking_by_stratum(own, strata, 0.3, 0.7), "uncertain_rate", "auroc")


def p14_domain_comparison(s, d):
    return _rounded(reports.domain_comparison(B.features(s, d), ["chars", "words", "lines", "stops"], "dataset", "en", "fr"), "median_a", "median_b", "difference", "d")


def p22_data_actions(s, d):
    level = F.when(F.col("n_regionkey") == 0, "SEVERE").when(F.col("n_regionkey") == 1, "HIGH").when(F.col("n_regionkey") == 2, "MODERATE").otherwise("LOW")
    rate, support = (F.col("n_nationkey") % 10) / 10, (F.col("n_nationkey") % 7) / 7
    return B.table(s, d, "nation").select("n_name", audit.data_action(level, rate, support).alias("action"), audit.evidence(rate - 0.5).alias("evidence"), audit.candidate_verdict(rate / 20, support).alias("verdict"), F.round(audit.gap_reduction(support, rate), 6).alias("reduction"), audit.gate_status(rate, 0.8, 0.3).alias("status"))


def p24_shift_report(s, d):
    return _rounded(reports.shift_report(B.scores(s, d), 0.3, 0.7), "stain_rate", "uncertain_rate", "p05", "p50", "p95")


def p25_coarse_confounding(s, d):
    return _rounded(reports.coarse_confounding(B.features(s, d), "label", {"chars": 500.0, "lines": 20.0}), "chars_0", "chars_1", "lines_0", "lines_1", "chars_gap", "lines_gap")


def p28_style_sensitivity(s, d):
    rows = B.scores(s, d).select("dataset", "sample_id", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.8, 1.2, 1.5)])).alias("gain"), "score")
    rows = rows.select("dataset", "sample_id", F.col("score").alias("base_1"), (F.col("score") * F.col("gain")).alias("styled_1"), F.col("score").alias("base_2"), (F.col("score") * (F.col("gain") + 1) / 2).alias("styled_2"))
    return _rounded(reports.style_sensitivity(rows), "delta_1", "delta_2", "improvement")


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of 64 numbers as gray pictures of 8 x 8, and what kernels say of them; the mask is where a number is over 0."""
    for batch in batches:
        found: list[list] = [[] for _ in range(7)]
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            gray = np.floor(np.asarray(v, np.float64).reshape(8, 8) * 1000)
            mask = (gray > 0).astype(np.uint8)
            box, touch = kernels.bounding_box(mask), kernels.border_touch(mask)
            row = (i, kernels.laplacian_variance(gray), kernels.gradient_energy(gray), float(mask.mean()), touch["left_touch_ratio"], touch["border_touch_ratio"], None if box is None else "-".join(map(str, box)))
            for to, x in zip(found, row, strict=True):
                to.append(x)
        kinds = [pa.int64(), *[pa.float64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["vec_id", "laplacian", "gradient", "foreground", "left_touch", "border_touch", "box"])


def q2_picture_kernels(s, d):
    out = B.table(s, d, "embeddings").select("vec_id", "embedding").mapInArrow(_pictures, "vec_id long, laplacian double, gradient double, foreground double, left_touch double, border_touch double, box string")
    return _rounded(out, "laplacian", "gradient", "foreground", "left_touch", "border_touch", digits=4)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:1].islower() and n[1:2].isdigit()}

_SC, _FE = E.SCORES, E.FEATURES
_WORDS = "[" + ", ".join(f"'{w}'" for w in TRUTH_WORDS) + "]"
_MASKS = """smp AS (SELECT doc_id, concat_ws('::', lang, doc_id) AS sample_id, md5(text) AS md5, CASE WHEN doc_id % 17 = 0 THEN 99 ELSE 100 END AS width FROM documents), raw AS (
  SELECT coalesce(s.sample_id, 'lost::' || (l_orderkey % 250)) AS sample_id, l_orderkey || '-' || l_linenumber AS annotation_id, l_orderkey % 11 = 3 AS no_mask, l_quantity / 50 - 0.1::DOUBLE AS foreground_ratio, l_linenumber = 1 AS own, s.doc_id, s.md5, s.width
  FROM lineitem LEFT JOIN smp s ON s.doc_id = l_orderkey % 250 WHERE l_linenumber <= 2 AND l_orderkey < 270 AND l_orderkey % 2 = 0 AND l_orderkey % 250 % 13 <> 5
), counted AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, count(*) FILTER (own) OVER (PARTITION BY sample_id) AS n_own FROM raw
), manifest AS (
  SELECT sample_id, annotation_id, CASE WHEN doc_id = 42 OR doc_id IS NULL THEN NULL WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' WHEN doc_id % 10 = 8 THEN 'odd' ELSE 'test' END AS split, CASE WHEN doc_id % 3 = 0 THEN 'silver' ELSE 'unknown' END AS supervision_pool, foreground_ratio, md5,
         CASE WHEN n > 1 AND n_own <> 1 THEN 'several_masks' WHEN doc_id IS NULL THEN 'no_sample' WHEN doc_id = 42 THEN 'no_split' WHEN doc_id % 10 = 8 THEN 'unexpected_split' WHEN no_mask THEN 'missing_mask' WHEN width <> 100 THEN 'shape_mismatch' WHEN foreground_ratio <= 0 THEN 'empty_mask' END AS problem
  FROM counted WHERE n = 1 OR n_own <> 1 OR own
)"""
_LAB = "lab AS (SELECT concat_ws('::', lang, d.doc_id) AS sample_id, d.doc_id, md5(text) AS md5, source, quality AS label, CASE WHEN d.doc_id % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM documents d JOIN labels USING (doc_id) WHERE lang = 'en')"
ORACLE_SQL = {
    "c1_sample_id": "SELECT page_id, 'web::' || url AS sample_id FROM pages",
    "c2_null_tokens": "SELECT event_id, CASE event_id % 8 WHEN 6 THEN 'nan0' WHEN 7 THEN 'x' END AS value FROM events",
    "c9_sample_seed": "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT + 17 AS seed FROM customer",
    "c10_strict_flag": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS flag, CASE WHEN event_id % 10 < 5 THEN 1 ELSE 0 END AS truth FROM events",
    "c11_bands": f"WITH {_SC} SELECT sample_id, CASE WHEN score <= 0.3 THEN 'false' WHEN score >= 0.7 THEN 'true' ELSE 'uncertain' END AS finding, CASE WHEN score <= 0.3 THEN 'clear' WHEN score < 0.7 THEN 'uncertain' WHEN score < 0.9 THEN 'stain' END AS band FROM scores",
    "c14_yolo_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 + 100 AS w, l_suppkey % 40 + 60 AS h, l_discount * 10 AS xc, l_tax * 12 AS yc, l_quantity / 50 AS bw, l_tax * 5 + 0.1::DOUBLE AS bh FROM lineitem),
      c AS (SELECT *, greatest(0, (xc - bw / 2) * w) AS x_min, greatest(0, (yc - bh / 2) * h) AS y_min, least(w, (xc + bw / 2) * w) AS x_max, least(h, (yc + bh / 2) * h) AS y_max FROM b)
      SELECT l_orderkey, l_linenumber, round(x_min, 6) AS x_min, round(y_min, 6) AS y_min, round(x_max, 6) AS x_max, round(y_max, 6) AS y_max, round((x_max - x_min) / w, 6) AS bbox_width_ratio, round((y_max - y_min) / h, 6) AS bbox_height_ratio, round((x_max - x_min) * (y_max - y_min) / (w * h), 6) AS bbox_area_ratio, x_min <= 0 OR y_min <= 0 OR x_max >= w OR y_max >= h AS touches_border FROM c""",
    "c17_expanded_boxes": "SELECT l_orderkey, l_linenumber, greatest(0, floor(l_quantity - 1 - 21 * 0.15::DOUBLE))::BIGINT AS x_min, greatest(0, floor(3 - 37 * 0.15::DOUBLE))::BIGINT AS y_min, least(60, ceil(l_quantity + 20 + 21 * 0.15::DOUBLE))::BIGINT AS x_max, least(45, ceil(40 + 37 * 0.15::DOUBLE))::BIGINT AS y_max FROM lineitem",
    "c24_guidance": f"WITH {E._GATE} SELECT DISTINCT sample_id, CASE r WHEN 'BLUR' THEN 'hold still' WHEN 'CAST' THEN 'use daylight' ELSE 'try again' END AS guidance FROM c WHERE r IS NOT NULL",
    "c29_warmup": "SELECT p_partkey, round(least(p_partkey / 150.0::DOUBLE, 1), 9) AS linear, round(2 / (1 + exp(-10 * least(p_partkey / 150.0::DOUBLE, 1))) - 1, 9) AS smooth, round(1 / (1 + exp(-p_size / 10.0::DOUBLE)), 9) AS logistic FROM part",
    "d4_calibration_rows": f"WITH {_SC} SELECT CASE WHEN source < 'src2' THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM scores GROUP BY 1",
    "d9_finite": "SELECT event_id, value AS x FROM events WHERE event_id % 5 > 2 AND value IS NOT NULL",
    "e1_labels_on_canonical": f"WITH {C.DECISIONS}, f AS (SELECT concat_ws('::', lang, d.doc_id) AS sample_id, unnest(['quality', 'toxic']) AS canonical_task, unnest([quality, toxic]) AS value FROM labels JOIN documents d USING (doc_id)) SELECT f.sample_id AS origin_sample_id, canonical_sample_id, canonical_task, value, duplicate_group_id FROM f JOIN decisions USING (sample_id)",
    "f16_class_quantiles": f"WITH {_SC} SELECT label, count(score) AS count, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM scores GROUP BY label",
    "f21_class_balance": f"WITH {_SC}, x AS (SELECT CASE WHEN source < 'src3' THEN 'train' ELSE 'val' END AS split, label FROM scores UNION ALL SELECT 'overall', label FROM scores) SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, round(count(*) FILTER (label = 1) / count(*)::DOUBLE, 6) AS positive_rate FROM x GROUP BY split",
    "f23_top_collisions": "WITH g AS (SELECT md5(text) AS md5, string_agg(DISTINCT source, '|' ORDER BY source) AS datasets, count(DISTINCT source)::INTEGER AS n_datasets, count(*) AS n_samples FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1), t AS (SELECT count(*) AS n_groups FROM g) SELECT g.*, n_groups, n_groups > 10 AS truncated FROM g, t ORDER BY n_samples DESC, md5 LIMIT 10",
    "f25_supervision_counts": "WITH f AS (SELECT doc_id, unnest(['quality', 'toxic']) AS canonical_task, unnest([quality, toxic]) AS value FROM labels JOIN documents USING (doc_id)) SELECT canonical_task, 'is_' || canonical_task AS canonical_label, count(*) FILTER (value = 1) AS positive, count(*) FILTER (value = 0) AS negative, (SELECT count(DISTINCT doc_id) FROM f) - count(DISTINCT doc_id) AS unknown FROM f GROUP BY canonical_task",
    "f31_running_means": f"WITH {_FE} SELECT coalesce(dataset, 'overall') AS scope, count(*) AS n, round(avg(chars), 6) AS chars, round(avg(words), 6) AS words, round(avg(lines), 6) AS lines FROM features GROUP BY ROLLUP (dataset)",
    "g6_ranked_candidates": "WITH t AS (SELECT n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS a, n_nationkey % 3 AS b FROM nation) SELECT *, row_number() OVER (ORDER BY coalesce(a, -1) DESC, coalesce(b, 99), n_name)::INTEGER AS rank FROM t",
    "g9_round_robin": "WITH r AS (SELECT lang AS dataset, concat_ws('::', lang, doc_id) AS sample_id FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS rank FROM r) SELECT dataset, sample_id FROM k ORDER BY rank, dataset LIMIT 10",
    "g9_heads": "WITH r AS (SELECT lang AS dataset, concat_ws('::', lang, doc_id) AS sample_id FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS rank FROM r) SELECT dataset, sample_id FROM k WHERE (dataset = 'en' AND rank <= 3) OR (dataset = 'fr' AND rank <= 2)",
    "h2_largest_effects": f"WITH e AS ({E.ORACLE_SQL['p1_cohens_d']}) SELECT feature, d FROM e WHERE d IS NOT NULL ORDER BY abs(d) DESC, feature LIMIT 2",
    "h8_review_lists": f"WITH {_FE} SELECT * FROM (SELECT 'longest' AS list, sample_id, round(chars, 6) AS value FROM features ORDER BY chars DESC, sample_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'fewest_lines', sample_id, round(lines, 6) FROM features ORDER BY lines, sample_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'most_stops', sample_id, round(stops, 6) FROM features ORDER BY stops DESC, sample_id LIMIT 5)",
    "k11_segmentation_manifest": f"WITH {_MASKS} SELECT sample_id, annotation_id, split, supervision_pool, round(foreground_ratio, 6) AS foreground_ratio, problem FROM manifest",
    "k11_segmentation_audit": f"""WITH {_MASKS}, x AS (SELECT 'here' AS scope, * FROM manifest UNION ALL SELECT 'overall', * FROM manifest) SELECT scope, count(*) AS n, count(*) FILTER (problem IS NULL AND split = 'train') AS n_train, count(*) FILTER (problem IS NULL AND split = 'val') AS n_val, count(*) FILTER (problem IS NULL AND split = 'test') AS n_test, count(*) FILTER (problem IS NOT NULL) AS n_problems,
      count(*) FILTER (problem IS NULL AND foreground_ratio >= 1) AS n_full, count(*) FILTER (problem IS NULL AND (foreground_ratio < 0.01 OR foreground_ratio > 0.95)) AS n_extreme, round(count(*) FILTER (problem IS NULL) / count(*)::DOUBLE, 6) AS pairing_rate FROM x GROUP BY scope""",
    "l5_segmentation_violations": f"WITH {_MASKS}, g AS (SELECT * FROM manifest WHERE problem IS NULL) SELECT problem AS rule, sample_id AS key FROM manifest WHERE problem IS NOT NULL UNION ALL SELECT 'sample_id_unique', sample_id FROM g GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'sample_id_in_one_split', sample_id FROM g GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'md5_in_one_split', md5 FROM g GROUP BY 2 HAVING count(DISTINCT split) > 1",
    "k12_labelled_manifest": f"WITH {_LAB} SELECT sample_id, md5, label, split, false AS eligible, 'pending' AS exclusion_reason FROM lab",
    "k12_labelled_violations": f"WITH {_LAB} SELECT 'md5_in_one_split' AS rule, md5 AS key FROM lab GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'split_is_missing', 'test' UNION ALL SELECT 'barred_task', sample_id FROM lab",
    "k13_preflight": f"WITH {_LAB} SELECT count(*) AS n, round(count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) / count(*)::DOUBLE, 6) AS rate, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) / count(*)::DOUBLE >= 0.9 AS passed FROM lab",
    "k14_confounding_manifest": f"WITH {_LAB} SELECT sample_id, label, source AS folder_batch, 'jpg' AS file_extension FROM lab WHERE doc_id % 4 <> 0 AND split = 'train'",
    "i2_diagnosis_pool": f"WITH {_SC} SELECT CASE dataset WHEN 'en' THEN 'known' ELSE 'other' END AS domain_group, count(*) AS n, count(label) FILTER (dataset = 'en') AS n_labels FROM scores WHERE dataset IN ('en', 'fr') GROUP BY dataset",
    "l3_clean_violations": f"WITH {C.POOLS}, dec AS (SELECT * REPLACE (keep AND NOT ends_with(sample_id, '00') AS keep) FROM decisions) SELECT 'one_kept_of_each_group' AS rule, duplicate_group_id AS key FROM dec GROUP BY 2 HAVING count(*) FILTER (keep) <> 1 UNION ALL SELECT 'kept_is_canonical', sample_id FROM dec WHERE keep <> (sample_id = canonical_sample_id) UNION ALL SELECT 'holdout_trains_nothing', sample_id FROM eligible WHERE supervision_pool = 'external_holdout'",
    "l8_check_violations": f"WITH {E._GATE}, s AS (SELECT c.*, CASE check_id WHEN 'presence' THEN quantity WHEN 'scale' THEN quantity WHEN 'cast' THEN discount WHEN 'focus' THEN maybe ELSE tax END AS score FROM c JOIN f USING (sample_id)) SELECT 'not_evaluated_finds_nothing' AS rule, count(*) AS n FROM s WHERE check_id = 'later' UNION ALL SELECT 'retake_has_a_reason', count(*) FROM s WHERE e = 'retake' AND (score = 0.09 OR score IS NULL) HAVING count(*) > 0",
    "n2_frozen_thresholds": f"WITH {_SC} SELECT dataset, CASE WHEN score <= 0.25 THEN 'false' WHEN score >= 0.75 THEN 'true' ELSE 'uncertain' END AS finding, count(*) AS n FROM scores GROUP BY ALL",
    "n5_tail_proposals": f"WITH {_FE}, q AS (SELECT count(stops) AS n, quantile_cont(stops, 0.98) AS w, quantile_cont(stops, 0.995) AS r, quantile_cont(stops, 0.5) AS p50, quantile_cont(stops, 0.95) AS p95 FROM features) SELECT n, round(w, 6) AS warning, round(CASE WHEN r <= w THEN w * 1.2 + 0.01 ELSE r END, 6) AS retake, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM q",
    "n8_sweep_rates": "WITH x AS (SELECT l_returnflag AS direction, l_linestatus AS strength, l_tax > 0.01 AS ok, l_discount * 1.1::DOUBLE AS v FROM lineitem), n AS (SELECT direction, strength, count(*) AS n, count(*) FILTER (ok AND v >= 0.07) AS detected, count(*) FILTER (ok AND v >= 0.09) AS retaken, count(*) FILTER (NOT ok) AS unavailable FROM x GROUP BY ALL) SELECT *, round(detected / n::DOUBLE, 6) AS detection_rate, round(retaken / n::DOUBLE, 6) AS retake_rate FROM n",
    "o7_ranking_summary": f"""WITH {_SC}, one AS (SELECT 'all' AS dataset, * EXCLUDE (dataset) FROM scores), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM one), u AS (SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc, round(avg((score - label) * (score - label)), 6) AS brier FROM r),
      t AS (SELECT score, count(*) AS n, sum(label) AS p FROM scores GROUP BY score), k AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM t), ap AS (SELECT round(sum(p * cp / cn::DOUBLE) / sum(p)::DOUBLE, 6) AS average_precision FROM k),
      b AS (SELECT count(*) AS n, avg(score) AS c, avg(label) AS a FROM scores GROUP BY least(floor(score * 10), 9)), ec AS (SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b),
      m AS (SELECT (count(*) FILTER (score >= 0.5 AND label = 1))::DOUBLE AS tp, (count(*) FILTER (score >= 0.5 AND label = 0))::DOUBLE AS fp, (count(*) FILTER (score < 0.5 AND label = 0))::DOUBLE AS tn, (count(*) FILTER (score < 0.5 AND label = 1))::DOUBLE AS fn FROM scores)
      SELECT auroc, average_precision, brier, ece, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM u, ap, ec, m""",
    "o10_evaluation_report": f"WITH {_SC}, x AS (SELECT dataset AS scope, score FROM scores UNION ALL SELECT 'overall', score FROM scores), g AS (SELECT scope, count(*) AS n, avg(score) AS mean, min(score) AS min, count(*) FILTER (score < 0.05) AS n_empty, count(*) FILTER (score > 0.95) AS n_near_full, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95 FROM x GROUP BY scope) SELECT scope, n, round(mean, 6) AS mean, min, n_empty, n_near_full, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95, CASE WHEN scope <> 'overall' THEN round((SELECT max(mean) FROM g WHERE scope <> 'overall') - mean, 6) END AS gap FROM g",
    "o14_frozen_test": f"""WITH {_SC}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM scores), n AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (label = 1))::DOUBLE AS p, (count(*) FILTER (label = 0))::DOUBLE AS q, sum(rk) FILTER (label = 1) AS s, (count(*) FILTER (score <= 0.3))::DOUBLE AS c, (count(*) FILTER (score >= 0.7))::DOUBLE AS t, (count(*) FILTER (score <= 0.3 AND label = 0))::DOUBLE AS cr, (count(*) FILTER (score >= 0.7 AND label = 1))::DOUBLE AS tr,
      count(*) FILTER (label = 1 AND score < 0.7) AS false_negatives, count(*) FILTER (label = 0 AND score >= 0.7) AS false_positives FROM r), v AS (SELECT *, (s - p * (p + 1) / 2) / (p * q) AS auroc, CASE WHEN t > 0 THEN tr / t ELSE 0 END AS sp, CASE WHEN p > 0 THEN tr / p ELSE 0 END AS sr, CASE WHEN c > 0 THEN cr / c ELSE 0 END AS cp, (c + t) / n AS coverage FROM n)
      SELECT round(auroc, 6) AS auroc, round(sp, 6) AS stain_precision, round(sr, 6) AS stain_recall, round(cp, 6) AS clear_purity, round(coverage, 6) AS coverage, false_negatives, false_positives, CASE WHEN auroc >= 0.9 AND sp >= 0.85 AND sr >= 0.85 AND cp >= 0.85 THEN 'TARGET_PASS' WHEN auroc >= 0.2 AND sp >= 0.1 AND sr >= 0.1 AND cp >= 0.1 THEN 'MINIMUM_PASS' ELSE 'NEEDS_IMPROVEMENT' END AS status, coverage < 0.3 AS low_coverage FROM v""",
    "e7_ranking_by_stratum": f"WITH {_SC}, j AS (SELECT *, CASE WHEN source <> 'src1' THEN CASE n_chars % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' ELSE 'retake' END END AS stratum FROM scores), r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY score) + (count(*) OVER (PARTITION BY stratum, score) - 1) / 2.0::DOUBLE AS rk FROM j), g AS (SELECT stratum, count(*) AS n, count(*) FILTER (score > 0.3 AND score < 0.7) AS u, sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY stratum) SELECT stratum, n, round(u / n::DOUBLE, 6) AS uncertain_rate, CASE WHEN p > 0 AND q > 0 THEN round((s - p * (p + 1) / 2) / (p * q), 6) END AS auroc FROM g",
    "p14_domain_comparison": f"""WITH {_FE}, l AS ({" UNION ALL ".join(f"SELECT dataset, '{n}' AS feature, {n} AS v FROM features WHERE dataset IN ('en', 'fr')" for n in E.NAMES)}), g AS (SELECT feature, quantile_cont(v, 0.5) FILTER (dataset = 'en') AS a, quantile_cont(v, 0.5) FILTER (dataset = 'fr') AS b, avg(v) FILTER (dataset = 'en') AS ma, avg(v) FILTER (dataset = 'fr') AS mb, var_samp(v) FILTER (dataset = 'en') AS va, var_samp(v) FILTER (dataset = 'fr') AS vb, count(v) FILTER (dataset = 'en') AS na, count(v) FILTER (dataset = 'fr') AS nb FROM l GROUP BY feature),
      e AS (SELECT *, (mb - ma) / sqrt(((nb - 1) * vb + (na - 1) * va) / (na + nb - 2)) AS d FROM g) SELECT feature, round(a, 6) AS median_a, round(b, 6) AS median_b, round(b - a, 6) AS difference, round(d, 6) AS d, row_number() OVER (ORDER BY abs(d) DESC, feature)::INTEGER AS rank FROM e""",
    "p22_data_actions": """WITH x AS (SELECT n_name, CASE n_regionkey WHEN 0 THEN 'SEVERE' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE' ELSE 'LOW' END AS level, (n_nationkey % 10) / 10::DOUBLE AS rate, (n_nationkey % 7) / 7::DOUBLE AS support FROM nation)
      SELECT n_name, CASE WHEN level = 'SEVERE' THEN 'recollect' WHEN level = 'HIGH' AND rate < 0.5 THEN 'collect_matched' WHEN level IN ('HIGH', 'MODERATE') THEN CASE WHEN support < 0.8 THEN 'restrict_to_support' ELSE 'reweight' END ELSE 'keep' END AS action, CASE WHEN abs(rate - 0.5) >= 0.8 THEN 'strong' WHEN abs(rate - 0.5) >= 0.5 THEN 'moderate' WHEN abs(rate - 0.5) >= 0.2 THEN 'weak' ELSE 'none' END AS evidence,
      CASE WHEN rate / 20 > 0.01 THEN 'rejected_regression' WHEN support < 0.1 THEN 'rejected_no_gain' ELSE 'accepted' END AS verdict, CASE WHEN support > 1e-12 THEN round(1 - rate / support, 6) END AS reduction, CASE WHEN rate >= 0.8 THEN 'target_met' WHEN rate >= 0.3 THEN 'minimum_met' ELSE 'failed' END AS status FROM x""",
    "p24_shift_report": f"""WITH {_SC}, g AS (SELECT dataset, count(*) AS n, count(*) FILTER (score <= 0.3) AS n_clear, count(*) FILTER (score > 0.3 AND score < 0.7) AS n_uncertain, count(*) FILTER (score >= 0.7) AS n_stain, count(*) FILTER (score IS NULL) AS n_missing, count(*) FILTER (score >= 0.7) / count(score)::DOUBLE AS sr, count(*) FILTER (score > 0.3 AND score < 0.7) / count(score)::DOUBLE AS ur, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95 FROM scores GROUP BY dataset)
      SELECT dataset, n, n_clear, n_uncertain, n_stain, n_missing, round(sr, 6) AS stain_rate, round(ur, 6) AS uncertain_rate, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95, (SELECT max(sr) > 0.2 FROM g) AS possible_shift, (SELECT max(sr) - min(sr) >= 0.25 FROM g) AS identity_shift FROM g""",
    "p25_coarse_confounding": f"WITH {_FE}, g AS (SELECT count(*) AS n, quantile_cont(chars, 0.5) FILTER (label = 0) AS c0, quantile_cont(chars, 0.5) FILTER (label = 1) AS c1, quantile_cont(lines, 0.5) FILTER (label = 0) AS l0, quantile_cont(lines, 0.5) FILTER (label = 1) AS l1 FROM features) SELECT n, round(c0, 6) AS chars_0, round(c1, 6) AS chars_1, round(l0, 6) AS lines_0, round(l1, 6) AS lines_1, round(abs(c1 - c0), 6) AS chars_gap, round(abs(l1 - l0), 6) AS lines_gap, abs(c1 - c0) > 500 OR abs(l1 - l0) > 20 AS suspected FROM g",
    "p28_style_sensitivity": f"WITH {_SC}, r AS (SELECT dataset, sample_id, score, unnest([0.5::DOUBLE, 0.8, 1.2, 1.5]) AS gain FROM scores), p AS (SELECT dataset, sample_id, avg(abs(score * gain - score)) AS a, avg(abs(score * (gain + 1) / 2 - score)) AS b FROM r GROUP BY ALL), x AS (SELECT dataset AS scope, a, b FROM p UNION ALL SELECT 'overall', a, b FROM p) SELECT scope, count(*) AS n, round(avg(a), 6) AS delta_1, round(avg(b), 6) AS delta_2, CASE WHEN avg(a) > 1e-8 THEN round(1 - avg(b) / avg(a), 6) END AS improvement FROM x GROUP BY scope",
    "q2_picture_kernels": """WITH px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor(v::DOUBLE * 1000) AS g FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
      near AS (SELECT p.vec_id, p.y, p.x, p.g, dy, dx, q.g AS h FROM px p, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b, px q WHERE q.vec_id = p.vec_id AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7)),
      per AS (SELECT vec_id, y, x, any_value(g) AS g, sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN h ELSE 0 END) - 4 * any_value(g) AS lap, sum(dx * (2 - abs(dy)) * h) AS gx, sum(dy * (2 - abs(dx)) * h) AS gy FROM near GROUP BY vec_id, y, x)
      SELECT vec_id, round(var_pop(lap), 4) AS laplacian, round(avg(gx * gx + gy * gy), 4) AS gradient, round(avg((g > 0)::INT), 4) AS foreground, CASE WHEN bool_or(g > 0) THEN round(avg((g > 0)::INT) FILTER (x = 0), 4) END AS left_touch, CASE WHEN bool_or(g > 0) THEN round((count(*) FILTER (g > 0 AND x = 0) + count(*) FILTER (g > 0 AND x = 7) + count(*) FILTER (g > 0 AND y = 0) + count(*) FILTER (g > 0 AND y = 7)) / 32.0::DOUBLE, 4) END AS border_touch,
      CASE WHEN bool_or(g > 0) THEN concat_ws('-', min(x) FILTER (g > 0), min(y) FILTER (g > 0), max(x) FILTER (g > 0) + 1, max(y) FILTER (g > 0) + 1) END AS box FROM per GROUP BY vec_id""",
}
