"""Queries of curation and splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators import curate, split, validate
from tessella.plans import bindings as B

SAMPLES = """samples AS (
  SELECT lang || '::' || doc_id::VARCHAR AS sample_id, lang AS dataset, source, md5(text) AS md5, lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id, n_chars, text FROM documents
)"""
DECISIONS = SAMPLES + """, decisions AS (
  SELECT sample_id, dataset, md5, 'dup::' || dataset || '::' || md5 AS duplicate_group_id, count(*) OVER g > 1 AS is_duplicate,
         first_value(sample_id) OVER w AS canonical_sample_id, row_number() OVER w = 1 AS keep
  FROM samples WINDOW g AS (PARTITION BY dataset, md5), w AS (PARTITION BY dataset, md5 ORDER BY path, sample_id)
)"""
LABELS = """facts AS (
  SELECT d.lang || '::' || d.doc_id::VARCHAR AS sample_id, d.lang AS dataset, 'quality' AS canonical_task, 'is_quality' AS canonical_label, l.quality AS value, d.source AS label_source, 'silver' AS supervision_tier
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL
  SELECT d.lang || '::' || d.doc_id::VARCHAR, d.lang, 'toxic', 'is_toxic', l.toxic, d.source, 'silver' FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
LINES = """facts AS (
  SELECT l_orderkey::VARCHAR AS canonical_sample_id, l_linenumber::VARCHAR AS origin, l_returnflag AS task, l_linestatus AS label, (l_discount >= 0.05)::INTEGER AS value,
         CASE WHEN l_tax > 0.04 THEN 'gold' ELSE 'silver' END AS tier, l_suppkey::VARCHAR AS source_label FROM lineitem
), value_conflicts AS (
  SELECT canonical_sample_id, task, label, string_agg(DISTINCT value::VARCHAR, '|' ORDER BY value::VARCHAR) AS vals, string_agg(DISTINCT origin, '|' ORDER BY origin) AS origins
  FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1
)"""
CLEAN_LINES = LINES + """, kept AS (
  SELECT f.* FROM facts f ANTI JOIN value_conflicts c ON f.canonical_sample_id = c.canonical_sample_id AND f.task = c.task AND f.label = c.label
), clean AS (
  SELECT canonical_sample_id, task, label, value, tier, arg_min(source_label, lpad(source_label, 20, ' ') || origin) AS unused,
         first(source_label ORDER BY source_label, origin) AS source_label, string_agg(DISTINCT origin, '|' ORDER BY origin) AS origins, count(DISTINCT origin) AS n_origins, count(*) AS n_facts
  FROM kept GROUP BY canonical_sample_id, task, label, value, tier
)"""
POOLS = DECISIONS + ", " + LABELS + """, units AS (
  SELECT sample_id, dataset, 'label' AS unit_type, canonical_task, canonical_label, label_source FROM facts
  UNION ALL SELECT sample_id, dataset, 'sample', NULL, NULL, NULL FROM samples s WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.sample_id = s.sample_id)
), assigned AS (
  SELECT *, CASE WHEN label_source = 'src3' THEN 'auxiliary' WHEN dataset = 'en' THEN 'gold_candidate' WHEN dataset IN ('fr', 'de') THEN 'silver' WHEN dataset = 'es' THEN 'external_holdout' ELSE 'excluded' END AS supervision_pool,
         CASE WHEN label_source = 'src3' THEN 'label_source_override' WHEN dataset IN ('en', 'fr', 'de', 'es') THEN 'dataset_policy' ELSE 'default_policy' END AS reason
  FROM units
), eligible AS (
  SELECT sample_id, dataset, unit_type, canonical_task, canonical_label, supervision_pool, reason,
         dataset IN ('en', 'fr', 'de') AND supervision_pool <> 'external_holdout' AS eligible_for_train, dataset = 'en' AND supervision_pool <> 'external_holdout' AS eligible_for_val,
         dataset IN ('en', 'fr', 'es') AS eligible_for_test FROM assigned
)"""
GROUPS = DECISIONS.replace("WITH", "") + """, edges AS (
  SELECT DISTINCT sample_id AS a, 'm' || md5 AS b FROM decisions WHERE keep
  UNION SELECT DISTINCT d.canonical_sample_id, 'p' || d.dataset || md5(lower(s.text)) FROM decisions d JOIN samples s USING (sample_id)
), links AS (
  SELECT DISTINCT x.a, y.a AS b FROM edges x JOIN edges y USING (b)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a AS sample_id, 'grp::' || min(b) AS split_group_id FROM reach GROUP BY a
), grouped AS (
  SELECT r.sample_id, d.dataset, d.md5, r.split_group_id, CASE WHEN bool_or(d.dataset = 'es') OVER (PARTITION BY r.split_group_id) THEN 'external_holdout' END AS forced_split
  FROM roots r JOIN decisions d USING (sample_id)
)"""
HASHED = GROUPS + """, splits AS (
  SELECT sample_id, dataset, md5, split_group_id, coalesce(forced_split, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END) AS split
  FROM (SELECT *, ('0x' || substr(md5('20260813::' || split_group_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM grouped)
)"""


def _decided(s, d):
    own = B.samples(s, d)
    return own, curate.decisions(own, B.POLICY)


def _assigned(s, d):
    facts = B.labels(s, d).withColumn("origin_sample_id", F.col("sample_id"))
    none = facts.limit(0).withColumn("annotation_task", F.lit(""))
    return curate.assignments(facts, none, B.samples(s, d), B.POLICY)


def _splits(s, d):
    grouped = B.grouped(s, d)
    return grouped.join(split.hash_splits(split.split_groups(grouped), B.SPLIT), "split_group_id")


def k2_dedup_decisions(s, d):
    return _decided(s, d)[1].select("sample_id", "dataset", "md5", "duplicate_group_id", "is_duplicate", "canonical_sample_id", "keep")


def d1_samples_clean(s, d):
    own, decided = _decided(s, d)
    return curate.clean_samples(own, decided).select("sample_id", "dataset", "md5", "duplicate_group_id", "n_chars")


def f2_cross_dataset_collisions(s, d):
    return curate.collisions(B.samples(s, d).withColumn("dataset", F.col("source")))


def f6_dedup_statistics(s, d):
    return curate.dedup_statistics(*_decided(s, d))


def f3_value_conflicts(s, d):
    return curate.value_conflicts(B.line_facts(s, d)).drop("kind")


def f4_binary_conflicts(s, d):
    return curate.binary_conflicts(B.event_facts(s, d)).drop("kind")


def k3_labels_clean(s, d):
    return curate.reconciled(B.line_facts(s, d)).select("canonical_sample_id", "canonical_task", "label", "value", "supervision_tier", "source_label", "origins", "n_origins", "n_facts")


def k3_reconciliation_statistics(s, d):
    facts = B.line_facts(s, d)
    return curate.reconciliation_statistics(facts, curate.reconciled(facts))


def k4_spatial_clean(s, d):
    return curate.reconciled_spatial(B.boxes(s, d)).select("canonical_sample_id", "annotation_task", "canonical_label", F.col("g_x_min").alias("x_min"), F.col("g_x_max").alias("x_max"), F.col("g_y_max").alias("y_max"), "annotation_id", "origins", "n_annotations", "ordinal")


def k4_multi_instance(s, d):
    return curate.multi_instances(curate.reconciled_spatial(B.boxes(s, d)))


def g4_mask_resolution(s, d):
    lines = B.table(s, d, "lineitem")
    masks = lines.select(F.col("l_orderkey").cast("string").alias("canonical_sample_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("mask"), F.when(F.col("l_quantity") < 10, F.col("l_orderkey")).otherwise(F.col("l_suppkey") + 10_000_000).cast("string").alias("origin_sample_id"))
    return curate.resolved_masks(masks)


def k5_supervision_assignments(s, d):
    return _assigned(s, d).select("sample_id", "dataset", "unit_type", "canonical_task", "canonical_label", "supervision_pool", "reason", "eligible_for_train", "eligible_for_val", "eligible_for_test")


def f7_pool_counts(s, d):
    return curate.pool_counts(_assigned(s, d))


def j2_leakage_groups(s, d):
    return B.grouped(s, d)


def f8_split_groups(s, d):
    grouped = B.grouped(s, d)
    return split.with_pools(split.split_groups(grouped), grouped, _assigned(s, d))


def f10_group_sizes(s, d):
    return split.group_sizes(B.grouped(s, d))


def k7_group_task_vectors(s, d):
    return split.task_vectors(split.usable_facts(B.labels(s, d), _assigned(s, d), B.SPLIT), B.grouped(s, d))


def k8_assign_splits(s, d):
    grouped = B.grouped(s, d)
    facts = split.usable_facts(B.labels(s, d), _assigned(s, d), B.SPLIT)
    return split.assign_splits(split.split_groups(grouped), split.task_vectors(facts, grouped), B.SPLIT, split.group_datasets(grouped))


def k9_effective_supervision(s, d):
    return split.effective_supervision(_assigned(s, d), _splits(s, d)).select("sample_id", "unit_type", "canonical_task", "sample_split", "effective_for_train", "effective_for_val", "effective_for_test", "effective_reason")


def k10_supervision_summary(s, d):
    return split.supervision_summary(B.samples(s, d), _assigned(s, d))


def f11_split_report(s, d):
    return split.split_report(_splits(s, d)).withColumn("train_share", F.round("train_share", 9))


def f12_task_distribution(s, d):
    return split.task_distribution(B.labels(s, d), _splits(s, d)).withColumn("prevalence", F.round("prevalence", 9))


def f12_prevalence_deviation(s, d):
    return split.prevalence_deviation(split.task_distribution(B.labels(s, d), _splits(s, d))).withColumn("deviation", F.round("deviation", 9))


def f14_leakage_counts(s, d):
    return split.leakage(_splits(s, d))


def f14_leakage_by_document(s, d):
    own = B.samples(s, d).withColumn("split_group_id", F.col("sample_id")).withColumn("forced_split", F.lit(None).cast("string"))
    return split.leakage(own.join(split.hash_splits(own, B.SPLIT), "split_group_id"), ("sample_id", "md5"))


def l2_manifest_violations(s, d):
    own = B.samples(s, d).withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    doubled = own.unionByName(own.filter("doc_id % 100 = 7"))
    facts = B.labels(s, d).withColumn("label_available", F.col("value") == 1).withColumn("value", F.when(F.col("label_source") == "src2", 7).otherwise(F.col("value"))).withColumn("sample_id", F.when(F.col("label_source") == "src1", F.concat("sample_id", F.lit("?"))).otherwise(F.col("sample_id")))
    boxes = own.select("sample_id", F.lit("bbox").alias("annotation_type"), F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), (F.col("n_chars") / 100).alias("x_max"), F.lit(5.0).alias("y_max"))
    return validate.manifest(doubled, facts, boxes.join(own.select("sample_id"), "sample_id"))


def l4_split_violations(s, d):
    return validate.splits(_splits(s, d).withColumn("split", F.when(F.col("dataset") == "fr", "odd").otherwise(F.col("split"))))


def c8_stable_hash(s, d):
    return B.samples(s, d).select("sample_id", X.hash_hex(20260813, "sample_id").alias("hash_hex"), X.stable_hash(20260813, "sample_id").cast("string").alias("hash_number"), X.sample_seed("sample_id", 100).alias("seed"))


def j6_balanced_batches(s, d):
    return split.balanced_batches(B.samples(s, d), 8, 3)


def i4_source_overlap(s, d):
    docs = B.table(s, d, "documents")
    of = lambda x: docs.filter(F.col("source") == x).select(F.md5("text").alias("md5")).distinct()
    a, b = of("src0"), of("src1")
    return a.intersect(b).select("md5", F.lit("both").alias("side")).unionByName(a.subtract(b).select("md5", F.lit("first").alias("side"))).unionByName(b.subtract(a).select("md5", F.lit("second").alias("side")))


_RECURSIVE = "WITH RECURSIVE "
QUERIES = {f.__name__: f for f in (k2_dedup_decisions, d1_samples_clean, f2_cross_dataset_collisions, f6_dedup_statistics, f3_value_conflicts, f4_binary_conflicts, k3_labels_clean, k3_reconciliation_statistics, k4_spatial_clean, k4_multi_instance, g4_mask_resolution, k5_supervision_assignments, f7_pool_counts, j2_leakage_groups, f8_split_groups, f10_group_sizes, k7_group_task_vectors, k8_assign_splits, k9_effective_supervision, k10_supervision_summary, f11_split_report, f12_task_distribution, f12_prevalence_deviation, f14_leakage_counts, f14_leakage_by_document, l2_manifest_violations, l4_split_violations, c8_stable_hash, j6_balanced_batches, i4_source_overlap)}

_DIST = """, fact_splits AS (
  SELECT f.canonical_task || '::' || f.canonical_label AS fact, s.split, f.value FROM facts f JOIN splits s USING (sample_id)
), distribution AS (
  SELECT fact, CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS split, count(*) FILTER (value = 1) AS positive, count(*) FILTER (value = 0) AS explicit_negative,
         count(*) FILTER (value = 1) / (count(*) FILTER (value IN (0, 1)))::DOUBLE AS prevalence
  FROM fact_splits GROUP BY GROUPING SETS ((fact, split), (fact))
)"""
ORACLE_SQL = {
    "k2_dedup_decisions": f"WITH {DECISIONS} SELECT * FROM decisions",
    "d1_samples_clean": f"WITH {DECISIONS} SELECT sample_id, d.dataset, d.md5, duplicate_group_id, n_chars FROM decisions d JOIN samples USING (sample_id) WHERE keep",
    "f2_cross_dataset_collisions": f"WITH {SAMPLES} SELECT md5, string_agg(DISTINCT source, '|' ORDER BY source) AS datasets, count(DISTINCT source)::INTEGER AS n_datasets, count(*) AS n_samples FROM samples GROUP BY md5 HAVING count(DISTINCT source) > 1",
    "f6_dedup_statistics": f"WITH {DECISIONS} SELECT dataset, count(*) AS samples_before, count(*) FILTER (keep) AS samples_after, count(*) FILTER (NOT keep) AS removed, count(DISTINCT md5) AS distinct_digests, count(DISTINCT duplicate_group_id) FILTER (is_duplicate) AS groups_of_several FROM decisions GROUP BY dataset",
    "f3_value_conflicts": f'WITH {LINES} SELECT canonical_sample_id, task AS canonical_task, label, vals AS "values", origins FROM value_conflicts',
    "f4_binary_conflicts": """SELECT * FROM (SELECT user_id::VARCHAR AS canonical_sample_id, event_type AS canonical_task, string_agg(DISTINCT event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR) FILTER (value >= 50) AS origins_true,
      string_agg(DISTINCT event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR) FILTER (value < 50) AS origins_false FROM events GROUP BY ALL) WHERE origins_true IS NOT NULL AND origins_false IS NOT NULL""",
    "k3_labels_clean": f"WITH {CLEAN_LINES} SELECT canonical_sample_id, task AS canonical_task, label, value, tier AS supervision_tier, source_label, origins, n_origins, n_facts FROM clean",
    "k3_reconciliation_statistics": f"WITH {CLEAN_LINES} SELECT (SELECT count(*) FROM facts) AS facts_before, (SELECT count(*) FROM clean) AS facts_after, (SELECT count(*) FROM clean WHERE n_origins > 1) AS identical, (SELECT coalesce(sum(m), 0)::BIGINT FROM (SELECT count(DISTINCT (task, label, value)) - 1 AS m FROM clean GROUP BY canonical_sample_id)) AS complementary, (SELECT count(*) FROM value_conflicts) AS value_conflicts, 0::BIGINT AS binary_conflicts",
    "k4_spatial_clean": """WITH b AS (SELECT l_orderkey::VARCHAR AS canonical_sample_id, l_linenumber::VARCHAR AS origin, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS annotation_id, l_returnflag AS annotation_task, l_linestatus AS canonical_label,
      floor(l_quantity / 10)::DOUBLE AS x_min, l_quantity AS x_max, floor(l_discount * 20)::DOUBLE AS y_max FROM lineitem)
      SELECT canonical_sample_id, annotation_task, canonical_label, x_min, x_max, y_max, first(annotation_id ORDER BY origin, annotation_id) AS annotation_id, string_agg(DISTINCT origin, '|' ORDER BY origin) AS origins, count(*) AS n_annotations,
      (row_number() OVER (PARTITION BY canonical_sample_id ORDER BY annotation_task, canonical_label, x_min, x_max, y_max) - 1)::INTEGER AS ordinal FROM b GROUP BY canonical_sample_id, annotation_task, canonical_label, x_min, x_max, y_max""",
    "k4_multi_instance": """SELECT canonical_sample_id, annotation_task, canonical_label, count(*) AS n_instances FROM (SELECT DISTINCT l_orderkey::VARCHAR AS canonical_sample_id, l_returnflag AS annotation_task, l_linestatus AS canonical_label,
      floor(l_quantity / 10) AS a, l_quantity AS b, floor(l_discount * 20) AS c FROM lineitem) GROUP BY ALL HAVING count(*) > 1""",
    "g4_mask_resolution": """WITH m AS (SELECT l_orderkey::VARCHAR AS canonical_sample_id, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS mask, (CASE WHEN l_quantity < 10 THEN l_orderkey ELSE l_suppkey + 10000000 END)::VARCHAR AS origin_sample_id FROM lineitem),
      n AS (SELECT *, count(*) OVER (PARTITION BY canonical_sample_id) AS n, count(*) FILTER (origin_sample_id = canonical_sample_id) OVER (PARTITION BY canonical_sample_id) AS o FROM m)
      SELECT canonical_sample_id, mask, origin_sample_id, CASE WHEN n = 1 THEN 'single' WHEN o = 1 THEN CASE WHEN origin_sample_id = canonical_sample_id THEN 'own_origin' ELSE 'dropped' END ELSE 'unresolved' END AS resolution, n = 1 OR (o = 1 AND origin_sample_id = canonical_sample_id) AS kept FROM n""",
    "k5_supervision_assignments": f"WITH {POOLS} SELECT * FROM eligible",
    "f7_pool_counts": f"WITH {POOLS} SELECT supervision_pool, unit_type, count(*) AS n FROM eligible GROUP BY ALL",
    "j2_leakage_groups": f"{_RECURSIVE}{GROUPS} SELECT * FROM grouped",
    "f8_split_groups": f"""{_RECURSIVE}{GROUPS}, {POOLS[len(DECISIONS) + 2:]} SELECT g.*, contains_gold, contains_silver, contains_pseudo, contains_auxiliary FROM
      (SELECT split_group_id, count(*) AS n_samples, count(DISTINCT md5) AS n_digests, string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS datasets, max(forced_split) AS forced_split FROM grouped GROUP BY 1) g JOIN
      (SELECT split_group_id, bool_or(supervision_pool = 'gold_candidate') AS contains_gold, bool_or(supervision_pool = 'silver') AS contains_silver, bool_or(supervision_pool = 'pseudo') AS contains_pseudo, bool_or(supervision_pool = 'auxiliary') AS contains_auxiliary
       FROM grouped JOIN eligible USING (sample_id) GROUP BY 1) p USING (split_group_id)""",
    "f10_group_sizes": f"{_RECURSIVE}{GROUPS} SELECT dataset, count(*) AS n_groups, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi, max(n) AS largest, avg(n) AS mean_size FROM (SELECT dataset, split_group_id, count(*) AS n FROM grouped GROUP BY ALL) GROUP BY dataset",
    "k7_group_task_vectors": f"""{_RECURSIVE}{GROUPS}, {POOLS[len(DECISIONS) + 2:]} SELECT split_group_id, f.canonical_task || ':' || f.canonical_label || CASE WHEN value = 0 THEN ':neg' ELSE '' END AS fact, count(*) AS n
      FROM facts f JOIN grouped USING (sample_id) WHERE NOT EXISTS (SELECT 1 FROM eligible e WHERE e.sample_id = f.sample_id AND e.canonical_task = f.canonical_task AND e.supervision_pool IN ('excluded', 'external_holdout')) GROUP BY ALL""",
    "k9_effective_supervision": f"""{_RECURSIVE}{HASHED}, {POOLS[len(DECISIONS) + 2:]}, j AS (SELECT e.*, s.split AS sample_split, s.split IS NULL AS gone, coalesce(s.split = 'external_holdout', false) OR supervision_pool = 'external_holdout' AS held FROM eligible e LEFT JOIN splits s USING (sample_id))
      SELECT sample_id, unit_type, canonical_task, sample_split, NOT gone AND NOT held AND sample_split = 'train' AND eligible_for_train AS effective_for_train, NOT gone AND NOT held AND sample_split = 'val' AND eligible_for_val AS effective_for_val,
      NOT gone AND NOT held AND sample_split = 'test' AND eligible_for_test AS effective_for_test, CASE WHEN gone THEN 'no_split' WHEN held THEN 'external_holdout_only' WHEN sample_split = 'train' THEN 'split_aligned' ELSE sample_split || '_evaluation_supervision' END AS effective_reason
      FROM (SELECT * REPLACE (coalesce(sample_split, '') AS sample_split) FROM j) WHERE NOT gone UNION ALL SELECT sample_id, unit_type, canonical_task, NULL, false, false, false, 'no_split' FROM j WHERE gone""",
    "k10_supervision_summary": f"WITH {POOLS} SELECT sample_id, string_agg(DISTINCT supervision_pool, '|' ORDER BY supervision_pool) AS supervision_summary FROM eligible GROUP BY sample_id",
    "f11_split_report": f"""{_RECURSIVE}{HASHED} SELECT dataset, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'external_holdout') AS n_external_holdout,
      count(DISTINCT split_group_id) AS n_groups, CASE WHEN count(*) FILTER (split <> 'external_holdout') > 0 THEN round(count(*) FILTER (split = 'train') / (count(*) FILTER (split <> 'external_holdout'))::DOUBLE, 9) END AS train_share FROM splits GROUP BY dataset""",
    "f12_task_distribution": f"{_RECURSIVE}{HASHED}, {LABELS}{_DIST} SELECT * REPLACE (round(prevalence, 9) AS prevalence) FROM distribution",
    "f12_prevalence_deviation": f"{_RECURSIVE}{HASHED}, {LABELS}{_DIST} SELECT fact, round(max(prevalence) - min(prevalence), 9) AS deviation, max(prevalence) - min(prevalence) > 0.15 AS warning FROM distribution WHERE split <> 'overall' GROUP BY fact",
    "f14_leakage_counts": f"{_RECURSIVE}{HASHED} " + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) FILTER (n > 1) AS n_leaks FROM (SELECT count(DISTINCT split) AS n FROM splits GROUP BY {k})" for k in ("sample_id", "split_group_id", "md5")),
    "f14_leakage_by_document": f"WITH {SAMPLES}, splits AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(md5('20260813::' || sample_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM samples)) "
    + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) FILTER (n > 1) AS n_leaks FROM (SELECT count(DISTINCT split) AS n FROM splits GROUP BY {k})" for k in ("sample_id", "md5")),
    "l2_manifest_violations": f"""WITH {SAMPLES}, {LABELS}, doubled AS (SELECT * FROM samples UNION ALL SELECT * FROM samples WHERE doc_id % 100 = 7), bad AS (SELECT *, CASE WHEN label_source = 'src1' THEN sample_id || '?' ELSE sample_id END AS id FROM facts)
      SELECT 'sample_id_unique' AS rule, sample_id AS key FROM doubled GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'labels_have_samples', id FROM bad WHERE label_source = 'src1'
      UNION ALL SELECT 'value_is_0_or_1', id FROM bad WHERE label_source = 'src2' UNION ALL SELECT 'label_available', id FROM bad WHERE value <> 1
      UNION ALL SELECT 'box_in_image', s.sample_id FROM samples s JOIN doubled USING (sample_id) WHERE NOT (s.n_chars / 100 > 0 AND s.n_chars / 100 <= 100)""",
    "l4_split_violations": f"""{_RECURSIVE}{HASHED}, odd AS (SELECT * REPLACE (CASE WHEN dataset = 'fr' THEN 'odd' ELSE split END AS split) FROM splits) SELECT 'split_is_known' AS rule, sample_id AS key FROM odd WHERE split = 'odd'
      UNION ALL SELECT 'split_group_id_in_one_split', split_group_id FROM odd GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'md5_in_one_split', md5 FROM odd GROUP BY 2 HAVING count(DISTINCT split) > 1""",
    "c8_stable_hash": f"WITH {SAMPLES} SELECT sample_id, substr(md5('20260813::' || sample_id), 1, 16) AS hash_hex, ('0x' || substr(md5('20260813::' || sample_id), 1, 16))::UBIGINT::VARCHAR AS hash_number, ('0x' || substr(md5(sample_id), 1, 8))::BIGINT + 100 AS seed FROM samples",
    "j6_balanced_batches": f"""WITH {SAMPLES}, r AS (SELECT dataset, sample_id, ((row_number() OVER (PARTITION BY dataset ORDER BY substr(md5('3::' || sample_id), 1, 16), sample_id) - 1) // 8)::BIGINT AS batch FROM samples)
      SELECT batch, dataset, sample_id FROM r WHERE batch < (SELECT min(n) // 8 FROM (SELECT count(*) AS n FROM samples GROUP BY dataset))""",
    "i4_source_overlap": """WITH a AS (SELECT DISTINCT md5(text) AS md5 FROM documents WHERE source = 'src0'), b AS (SELECT DISTINCT md5(text) AS md5 FROM documents WHERE source = 'src1')
      SELECT md5, 'both' AS side FROM a SEMI JOIN b USING (md5) UNION ALL SELECT md5, 'first' FROM a ANTI JOIN b USING (md5) UNION ALL SELECT md5, 'second' FROM b ANTI JOIN a USING (md5)""",
}

_HEAD, _TAIL = ORACLE_SQL["k7_group_task_vectors"].split(" SELECT split_group_id, f.canonical_task", 1)


def _away(held: str, whole: str) -> str:
    """Of a choice s: how far the counts of the splits are from their shares, over the whole. held: with place t."""
    return f"list_sum(list_transform([1, 2, 3], lambda t: abs({held} - [0.8::DOUBLE, 0.1, 0.1][t] * {whole}))) / {whole}"


#: Groups one after another, in order of their rarest fact; each goes where the sum of all penalties is least.
ORACLE_SQL["k8_assign_splits"] = f"""{_HEAD}, vec AS (SELECT split_group_id, f.canonical_task{_TAIL}
), free AS (SELECT split_group_id AS g, count(*)::DOUBLE AS n FROM grouped WHERE forced_split IS NULL GROUP BY 1
), own AS (SELECT v.* FROM vec v JOIN free ON g = split_group_id
), of_fact AS (SELECT fact, sum(n)::DOUBLE AS total, count(*) AS holders FROM own GROUP BY fact
), in_data AS (SELECT split_group_id AS g, dataset, count(*)::DOUBLE AS n FROM grouped WHERE forced_split IS NULL GROUP BY ALL
), of_data AS (SELECT dataset, sum(n) AS total FROM in_data GROUP BY dataset
), dense AS (SELECT g, list(coalesce(own.n, 0)::DOUBLE ORDER BY of_fact.fact) AS v, min(CASE WHEN own.n > 0 THEN total END) AS rarity FROM free CROSS JOIN of_fact LEFT JOIN own ON own.split_group_id = g AND own.fact = of_fact.fact GROUP BY g
), sides AS (SELECT free.g AS g, list(coalesce(in_data.n, 0) ORDER BY of_data.dataset) AS x FROM free CROSS JOIN of_data LEFT JOIN in_data ON in_data.g = free.g AND in_data.dataset = of_data.dataset GROUP BY free.g
), ordered AS (SELECT *, row_number() OVER (ORDER BY coalesce(rarity, 1e9), n DESC, substr(md5('20260813::' || g), 1, 16), g) AS k FROM free JOIN dense USING (g) JOIN sides USING (g)
), one AS (SELECT (SELECT sum(n) FROM free) AS whole, (SELECT list(total ORDER BY fact) FROM of_fact) AS tf, (SELECT list(holders ORDER BY fact) FROM of_fact) AS hf, (SELECT list(total ORDER BY dataset) FROM of_data) AS td
), step AS (
  SELECT 0::BIGINT AS k, [0::DOUBLE, 0, 0] AS size, (SELECT list_transform([1, 2, 3], lambda t: list_transform(tf, lambda z: 0::DOUBLE)) FROM one) AS fs, (SELECT list_transform([1, 2, 3], lambda t: list_transform(td, lambda z: 0::DOUBLE)) FROM one) AS ds, 0 AS choice
  UNION ALL
  SELECT k, list_transform([1, 2, 3], lambda t: size[t] + CASE WHEN t = c THEN n ELSE 0 END), list_transform([1, 2, 3], lambda t: CASE WHEN t = c THEN list_transform(v, lambda a, j: fs[t][j] + a) ELSE fs[t] END), list_transform([1, 2, 3], lambda t: CASE WHEN t = c THEN list_transform(x, lambda a, j: ds[t][j] + a) ELSE ds[t] END), c
  FROM (
    SELECT o.k, o.n, o.v, o.x, s.size, s.fs, s.ds, list_sort(list_transform([1, 2, 3], lambda s_: {{
      'a': round(2 * {_away("(s.size[t] + CASE WHEN t = s_ THEN o.n ELSE 0 END)", "whole")}
        + list_sum(list_transform(o.v, lambda a, j: CASE WHEN a > 0 THEN {_away("(s.fs[t][j] + CASE WHEN t = s_ THEN a ELSE 0 END)", "tf[j]")} - CASE WHEN hf[j] = 1 AND s_ = 1 THEN 0.5 WHEN hf[j] = 2 AND s_ <= 2 THEN 0.2 ELSE 0 END ELSE 0 END))
        + 1.5 * list_sum(list_transform(o.x, lambda a, j: CASE WHEN a > 0 THEN {_away("(s.ds[t][j] + CASE WHEN t = s_ THEN a ELSE 0 END)", "td[j]")} ELSE 0 END)), 9),
      'b': substr(md5('20260813::' || o.g || '::' || ['train', 'val', 'test'][s_]), 1, 16), 'c': s_}}))[1].c AS c
    FROM step s JOIN ordered o ON o.k = s.k + 1 CROSS JOIN one
  )
)
SELECT g AS split_group_id, ['train', 'val', 'test'][choice] AS split, 'stratified' AS split_reason FROM step JOIN ordered USING (k)
UNION ALL SELECT split_group_id, max(forced_split), 'forced' FROM grouped GROUP BY 1 HAVING max(forced_split) IS NOT NULL"""
