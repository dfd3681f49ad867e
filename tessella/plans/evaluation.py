"""Queries of metrics, thresholds, audits and the gate, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators import audit, calibrate, gate, metrics, stats
from tessella.plans import bindings as B

SCORES = """scores AS (
  SELECT d.doc_id::VARCHAR AS sample_id, d.lang AS dataset, d.source, l.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS score, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
FEATURES = """features AS (
  SELECT d.doc_id::VARCHAR AS sample_id, d.doc_id, d.lang AS dataset, d.source, l.quality AS label, d.n_chars::DOUBLE AS chars, len(string_split(d.text, ' '))::DOUBLE AS words, len(string_split(d.text, chr(10)))::DOUBLE AS lines,
         length(regexp_replace(d.text, '[^.,]', '', 'g')) / d.n_chars::DOUBLE AS stops FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
NAMES = ("chars", "words", "lines", "stops")
LONG = FEATURES + ", long AS (" + " UNION ALL ".join(f"SELECT sample_id, label, '{n}' AS feature, {n} AS value FROM features" for n in NAMES) + ")"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(s, d):
    return stats.long_form(B.features(s, d), ["sample_id", "label"], NAMES)


def o1_confusion(s, d):
    return _rounded(metrics.confusion(B.scores(s, d), 0.5, ["dataset"]), "precision", "recall", "specificity", "accuracy", "f1", "balanced_accuracy")


def o2_auroc(s, d):
    return _rounded(metrics.auroc(B.scores(s, d), ["dataset"]), "auroc")


def o3_average_precision(s, d):
    return _rounded(metrics.average_precision(B.scores(s, d)), "average_precision")


def o4_brier(s, d):
    return _rounded(metrics.brier(B.scores(s, d), ["dataset"]), "brier")


def o5_ece(s, d):
    return _rounded(metrics.calibration_error(B.scores(s, d)), "ece")


def o6_three_state(s, d):
    return _rounded(metrics.three_state(B.scores(s, d), 0.3, 0.7, ["dataset"]), "clear_purity", "stain_precision", "stain_recall", "coverage")


def o8_mask_metrics(s, d):
    li = B.table(s, d, "lineitem").filter("l_quantity > 0")
    m = metrics.mask_metrics(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100)
    out = li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in m.items()])
    return _rounded(out, *m)


def n1_dual_threshold(s, d):
    return _rounded(calibrate.dual_thresholds(B.scores(s, d), 0.05, 0.85), "t_clear", "t_retake", "coverage")


def n3_tail_thresholds(s, d):
    return _rounded(calibrate.tail_thresholds(B.features(s, d).filter("label = 1"), {"chars": (0.05, 0.01), "stops": (0.95, 0.99)}, {"chars": 100.0}), "warning", "retake")


def n4_capped_threshold(s, d):
    return _rounded(calibrate.capped_threshold(B.features(s, d).filter("label = 1"), "lines"), "warning")


def n9_style_ranges(s, d):
    return _rounded(calibrate.style_ranges(B.features(s, d), ["chars", "stops"], "dataset", "en", 0.9, 1.1), "p05", "p95", "ratio")


def f15_quantile_summary(s, d):
    return _rounded(metrics.quantile_summary(B.features(s, d), "words", ["dataset"], (5, 50, 95)), "mean", "std", "p05", "p50", "p95")


def f18_scope_distribution(s, d):
    return _rounded(metrics.scoped_summary(B.features(s, d), ["chars", "lines"], "dataset"), "mean", "p05", "p50", "p95")


def f19_nearest_rank(s, d):
    return metrics.nearest_rank(B.table(s, d, "documents"), "n_chars", 0.25, ["lang"])


def g11_size_buckets(s, d):
    return metrics.size_buckets(B.features(s, d), "chars").groupBy("bucket").agg(F.count("*").alias("n"))


def h1_worst_k(s, d):
    return metrics.worst(B.scores(s, d), "score", 10).select("sample_id", "score")


def h3_review_candidates(s, d):
    return metrics.first_of_each(B.scores(s, d), ["dataset", "label"], [F.desc("score"), "sample_id"], 3).select("dataset", "label", "rank", "sample_id", "score")


def p1_cohens_d(s, d):
    return _rounded(stats.cohens_d(_long(s, d)), "d")


def p2_cohens_d_mean_variance(s, d):
    return _rounded(stats.cohens_d_mean_variance(_long(s, d)), "d")


def p3_robust_median_difference(s, d):
    return _rounded(stats.robust_difference(_long(s, d)), "difference", "robust_d")


def p4_ks_wasserstein(s, d):
    return _rounded(stats.distances(_long(s, d)), "ks", "wasserstein")


def p6_quantile_strata(s, d):
    return _rounded(stats.quantile_strata(B.features(s, d), "chars", "label"), "rate")


def p6_strata_verdict(s, d):
    return _rounded(stats.strata_verdict(stats.quantile_strata(B.features(s, d), "chars", "label")), "span")


def p7_metadata_confounding(s, d):
    return _rounded(stats.metadata_rates(B.features(s, d), ["dataset", "source"], "label", 10, 8), "rate")


def p8_near_duplicates(s, d):
    return stats.near_duplicates(B.table(s, d, "documents").join(B.table(s, d, "labels"), "doc_id").select(F.md5(F.lower("text")).alias("digest"), F.col("quality").alias("label")), "digest", "label")


def p9_common_support(s, d):
    return _rounded(stats.common_support(B.scores(s, d).withColumn("score", F.col("score") + F.col("label") * 0.25), "score", "label"), "low", "high", "rate0", "rate1", "rate")


def p10_caliper_candidates(s, d):
    return _rounded(stats.caliper_candidates(B.features(s, d), ["chars", "lines", "stops"], "label", 0.3), "distance")


def p10_caliper_matching(s, d):
    return _rounded(stats.caliper_matches(B.features(s, d), ["chars", "lines", "stops"], "label", 0.3), "distance")


def p13_centroid_distances(s, d):
    return _rounded(stats.centroid_distances(B.table(s, d, "embeddings"), "label", "embedding"), "distance")


def p15_probability_shift(s, d):
    return _rounded(stats.probability_shift(B.scores(s, d), "dataset"), "mean", "p05", "median", "p95", "high_rate")


def p16_mode_ablation(s, d):
    sc = B.scores(s, d)
    long = sc.select(F.col("dataset").alias("cohort"), F.expr("stack(3, 'full', score, 'half', score / 2, 'square', score * score) as (mode, score)"))
    return _rounded(stats.mode_ablation(long, "full"), "median", "delta")


def p17_spearman(s, d):
    return _rounded(stats.spearman(B.features(s, d), "chars", "lines"), "rho")


def p18_pearson(s, d):
    return _rounded(stats.pearson(B.features(s, d), "chars", "lines"), "r")


def p21_confounding_level(s, d):
    a = metrics.auroc(B.scores(s, d).withColumn("score", F.col("score") + F.col("label") * 0.4), ["dataset"])
    return a.select("dataset", F.round("auroc", 6).alias("auroc"), stats.confounding_level(F.col("auroc"), F.lit(0.5), F.lit(0.1)).alias("level"))


def checks():
    return (
        gate.Check("presence", (gate.Rule("quantity", "<=", 1.0, "retake", "NOTHING_THERE"),), score="quantity"),
        gate.Check("scale", (gate.Rule("quantity", "<", 4.0, "retake", "TOO_SMALL"), gate.Rule("price", "<", 2000.0, "retake", "TOO_SMALL"), gate.Rule("quantity", "<", 10.0, "warning", "SMALL")), at_least=2, score="quantity"),
        gate.Check("cast", (gate.Rule("discount", ">=", 0.09, "retake", "CAST"), gate.Rule("discount", ">=", 0.07, "warning", "CAST")), needs=F.col("tax") > 0.01, score="discount"),
        gate.Check("focus", (gate.Rule("maybe", "<", 0.02, "retake", "BLUR"), gate.Rule("maybe", "<", 0.04, "warning", "BLUR")), score="maybe"),
        gate.three_state("stain", "tax", 0.03, 0.07, "STAIN"),
        gate.three_state("later", "tax", 0.03, 0.07, "LATER", deferred=True),
    )


PRIORITY = ("CAST", "NOTHING_THERE", "TOO_SMALL", "BLUR", "STAIN", "SMALL")


def _gate_features(s, d):
    li = B.table(s, d, "lineitem")
    return li.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("sample_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("maybe"))


def _rows(s, d):
    return gate.evaluate(_gate_features(s, d), checks())


def _arrays(s, d):
    return gate.evaluated(_gate_features(s, d), checks())


def m1_gate_checks(s, d):
    return _rows(s, d).select("sample_id", "check_id", "evaluation_state", "finding", "severity", "decision_effect", "reason_code")


def m13_gate_decisions(s, d):
    return gate.decide_arrays(_arrays(s, d), PRIORITY)


def m22_decisions_from_rows(s, d):
    """The same from checks in long form."""
    return gate.decide(_rows(s, d), PRIORITY)


def m20_ablation(s, d):
    return gate.ablation_arrays(_arrays(s, d), {"a": ["presence"], "b": ["presence", "scale", "focus"], "c": ["presence", "scale", "focus", "cast"], "d": [c for c in ("presence", "scale", "focus", "cast", "stain")]})


def m21_attribution(s, d):
    return gate.attribution_arrays(_arrays(s, d), {"size": ["presence", "scale"], "focus": ["focus"], "cast": ["cast"], "stain": ["stain"]})


def f28_status_breakdown(s, d):
    return gate.status_breakdown(_rows(s, d))


def f29_incomplete_reasons(s, d):
    return gate.incomplete_reasons(_rows(s, d))


def c28_reason_counts(s, d):
    return gate.reason_counts(gate.decide_arrays(_arrays(s, d), PRIORITY))


def l9_integrity(s, d):
    rows = _rows(s, d)
    return gate.integrity(rows, gate.decide(rows, PRIORITY).withColumn("decision", F.when(F.col("primary_reason") == "SMALL", "pass").otherwise(F.col("decision"))))


def c3_infer_split(s, d):
    p = B.table(s, d, "pages").select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/Train/x.jpg").when(F.col("page_id") % 3 == 1, "/valid/x.jpg").otherwise("/x.jpg")).alias("path"))
    return p.select("page_id", X.infer_split("path").alias("split"), X.path_part("path", 2, "unknown").alias("folder"), X.stem("path").alias("stem"), X.is_image("path").alias("image"))


def c4_norm_label(s, d):
    return B.table(s, d, "events").select("event_id", X.norm_label(F.concat(F.lit(" "), F.when(F.col("value") > 50, "TRUE").otherwise(F.col("event_type")), F.lit(" "))).alias("label"), X.truth(F.round("value", 0).cast("string")).alias("truth"), X.band(F.col("value") / 100, 0.3, 0.6).alias("band"))


def c18_letterbox(s, d):
    p = B.table(s, d, "part")
    out = X.letterbox(F.col("p_size").cast("int") + 1, F.col("p_partkey").cast("int") % 97 + 1, 64, 64)
    return p.select("p_partkey", *[v.alias(k) for k, v in out.items() if k != "scale"])


def c20_keyword_hits(s, d):
    words = ("the", "license", "idiot", "copyright", "email")
    return B.table(s, d, "documents").select("doc_id", F.array_join(X.keyword_hits("text", words), "|").alias("hits"))


def c27_json_props(s, d):
    return B.table(s, d, "events").select("event_type", F.from_json("props", "map<string,int>").alias("m")).select("event_type", F.explode("m").alias("key", "value")).groupBy("event_type", "key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def e13_unique_fuzzy_match(s, d):
    from tessella.sources import ingest

    names = B.table(s, d, "nation").select(F.col("n_name").alias("stem"))
    keys = B.table(s, d, "region").select(F.lower("r_name").alias("rid")).unionByName(B.table(s, d, "nation").select(F.expr("substr(n_name, 2)").alias("rid")))
    return ingest.fuzzy_matches(keys.distinct(), "rid", names, "stem")


def f22_scan_counts(s, d):
    docs = B.table(s, d, "documents")
    files = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("md5"), (F.col("n_chars") % 7).cast("int").alias("width"), (F.col("n_chars") % 5).cast("int").alias("height"), F.col("source").alias("stem"), F.when(F.col("n_chars") < 100, "short").alias("error"))
    return audit.scan_report(files)["counts"]


def f22_top_sizes(s, d):
    docs = B.table(s, d, "documents")
    files = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("md5"), (F.col("n_chars") % 7).cast("int").alias("width"), (F.col("n_chars") % 5).cast("int").alias("height"), F.col("source").alias("stem"), F.lit(None).cast("string").alias("error"))
    return audit.scan_report(files, 3)["sizes"]


def e12_pairing(s, d):
    return _rounded(audit.pairing(B.table(s, d, "documents"), B.table(s, d, "labels"), "doc_id"), "rate")


def o12_regression(s, d):
    now = metrics.brier(B.scores(s, d), ["dataset"]).select(F.col("dataset").alias("domain"), (1 - F.col("brier")).alias("metric"))
    before = B.scores(s, d).filter("source <> 'src0'").groupBy("dataset").agg((1 - F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label")))).alias("metric")).withColumnRenamed("dataset", "domain")
    return _rounded(audit.regression(now, before, 0.001, 0.01), "now", "before", "delta")


def p11_diagnostic_classifier(s, d):
    scored = audit.diagnostic_classifier(B.features(s, d), ["chars", "words", "lines", "stops"], "label")
    return metrics.auroc(scored).crossJoin(F.broadcast(audit.identity_accuracy(scored)))  # one row each


def p12_dataset_identity(s, d):
    f = B.features(s, d).withColumn("label", F.when(F.col("dataset") == "en", 0).when(F.col("dataset") == "fr", 1).otherwise(2))
    return audit.identity_accuracy(audit.diagnostic_classifier(f, ["chars", "words", "lines", "stops"], "label", kind="forest", folds=3))


def i2_star_revenue(s, d):
    """A sanity query over the star schema: revenue by region and year, with subtotals."""
    li, o, c, n, r = (B.table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (o1_confusion, o2_auroc, o3_average_precision, o4_brier, o5_ece, o6_three_state, o8_mask_metrics, n1_dual_threshold, n3_tail_thresholds, n4_capped_threshold, n9_style_ranges, f15_quantile_summary, f18_scope_distribution, f19_nearest_rank, g11_size_buckets, h1_worst_k, h3_review_candidates, p1_cohens_d, p2_cohens_d_mean_variance, p3_robust_median_difference, p4_ks_wasserstein, p6_quantile_strata, p6_strata_verdict, p7_metadata_confounding, p8_near_duplicates, p9_common_support, p10_caliper_candidates, p10_caliper_matching, p13_centroid_distances, p15_probability_shift, p16_mode_ablation, p17_spearman, p18_pearson, p21_confounding_level, m1_gate_checks, m13_gate_decisions, m22_decisions_from_rows, m20_ablation, m21_attribution, f28_status_breakdown, f29_incomplete_reasons, c28_reason_counts, l9_integrity, c3_infer_split, c4_norm_label, c18_letterbox, c20_keyword_hits, c27_json_props, e13_unique_fuzzy_match, f22_scan_counts, f22_top_sizes, e12_pairing, o12_regression, p11_diagnostic_classifier, p12_dataset_identity, i2_star_revenue)}

_GATE = """f AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS maybe FROM lineitem
), c AS (
  SELECT sample_id, 0 AS seq, 'presence' AS check_id, 'evaluated' AS evaluation_state, CASE WHEN quantity <= 1 THEN 'retake' ELSE 'pass' END AS e, CASE WHEN quantity <= 1 THEN 'NOTHING_THERE' END AS r, NULL AS find FROM f
  UNION ALL SELECT sample_id, 1, 'scale', 'evaluated', CASE WHEN quantity < 4 AND price < 2000 THEN 'retake' WHEN quantity < 10 OR price < 2000 THEN 'warning' ELSE 'pass' END, CASE WHEN quantity < 4 OR price < 2000 THEN 'TOO_SMALL' WHEN quantity < 10 THEN 'SMALL' END, NULL FROM f
  UNION ALL SELECT sample_id, 2, 'cast', CASE WHEN tax > 0.01 THEN 'evaluated' ELSE 'unavailable' END, CASE WHEN tax > 0.01 THEN CASE WHEN discount >= 0.09 THEN 'retake' WHEN discount >= 0.07 THEN 'warning' ELSE 'pass' END END, CASE WHEN tax > 0.01 AND discount >= 0.07 THEN 'CAST' END, NULL FROM f
  UNION ALL SELECT sample_id, 3, 'focus', CASE WHEN maybe IS NOT NULL THEN 'evaluated' ELSE 'not_evaluated' END, CASE WHEN maybe < 0.02 THEN 'retake' WHEN maybe < 0.04 THEN 'warning' WHEN maybe IS NOT NULL THEN 'pass' END, CASE WHEN maybe < 0.04 THEN 'BLUR' END, NULL FROM f
  UNION ALL SELECT sample_id, 4, 'stain', 'evaluated', CASE WHEN tax <= 0.03 THEN 'pass' WHEN tax >= 0.07 THEN 'retake' ELSE 'warning' END, CASE WHEN tax > 0.03 THEN 'STAIN' END, CASE WHEN tax <= 0.03 THEN 'false' WHEN tax >= 0.07 THEN 'true' ELSE 'uncertain' END FROM f
  UNION ALL SELECT sample_id, 5, 'later', 'not_evaluated', NULL, NULL, NULL FROM f
), decided AS (
  SELECT sample_id, CASE WHEN bool_or(e = 'retake') THEN 'retake' WHEN bool_or(e = 'warning') THEN 'warning' ELSE 'pass' END AS decision,
         first(r ORDER BY CASE e WHEN 'retake' THEN 0 ELSE 1 END, list_position(['CAST', 'NOTHING_THERE', 'TOO_SMALL', 'BLUR', 'STAIN', 'SMALL'], r), seq) FILTER (r IS NOT NULL) AS primary_reason,
         coalesce(string_agg(r, '|' ORDER BY seq) FILTER (r IS NOT NULL), '') AS reasons, NOT bool_or(coalesce(e = 'retake', false)) AS usable, bool_and(evaluation_state = 'evaluated') FILTER (check_id <> 'later') AS evaluation_complete
  FROM c GROUP BY sample_id
)"""
_STATS = LONG + ", m AS (SELECT feature, count(value) FILTER (label = 0) AS n0, count(value) FILTER (label = 1) AS n1, avg(value) FILTER (label = 0) AS m0, avg(value) FILTER (label = 1) AS m1, var_samp(value) FILTER (label = 0) AS v0, var_samp(value) FILTER (label = 1) AS v1 FROM long GROUP BY feature)"
_BINS = FEATURES + ", e AS (SELECT list_sort(list_distinct(quantile_cont(chars, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM features), strata AS (SELECT greatest(len(list_filter(e, lambda x: x < chars)), 1) - 1 AS bin, count(*) AS n, avg(label) AS rate, min(chars) AS low, max(chars) AS high FROM features, e GROUP BY 1)"
ORACLE_SQL = {
    "o1_confusion": f"""WITH {SCORES}, n AS (SELECT dataset, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scores GROUP BY dataset),
      q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM n)
      SELECT dataset, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round((recall + specificity) / 2, 6) AS balanced_accuracy FROM q""",
    "o2_auroc": f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rk FROM scores), s AS (SELECT dataset, sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY dataset)
      SELECT dataset, CASE WHEN p > 0 AND q > 0 THEN round((s - p * (p + 1) / 2) / (p * q), 6) END AS auroc FROM s""",
    "o3_average_precision": f"""WITH {SCORES}, t AS (SELECT score, count(*) AS n, sum(label) AS p FROM scores GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM t) SELECT round(sum(p * cp / cn::DOUBLE) / sum(p)::DOUBLE, 6) AS average_precision FROM c""",
    "o4_brier": f"WITH {SCORES} SELECT dataset, round(avg((score - label) * (score - label)), 6) AS brier FROM scores GROUP BY dataset",
    "o5_ece": f"WITH {SCORES}, b AS (SELECT count(*) AS n, avg(score) AS c, avg(label) AS a FROM scores GROUP BY least(floor(score * 10), 9)) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b",
    "o6_three_state": f"""WITH {SCORES}, n AS (SELECT dataset, count(*) AS n, count(*) FILTER (score <= 0.3) AS n_clear, count(*) FILTER (score > 0.3 AND score < 0.7) AS n_uncertain, count(*) FILTER (score >= 0.7) AS n_stain, count(*) FILTER (score <= 0.3 AND label = 0) AS c, count(*) FILTER (score >= 0.7 AND label = 1) AS s, count(*) FILTER (label = 1) AS p FROM scores GROUP BY dataset)
      SELECT dataset, n, n_clear, n_uncertain, n_stain, round(CASE WHEN n_clear > 0 THEN c / n_clear::DOUBLE ELSE 0 END, 6) AS clear_purity, round(CASE WHEN n_stain > 0 THEN s / n_stain::DOUBLE ELSE 0 END, 6) AS stain_precision, round(CASE WHEN p > 0 THEN s / p::DOUBLE ELSE 0 END, 6) AS stain_recall, round((n_clear + n_stain) / n::DOUBLE, 6) AS coverage FROM n""",
    "o8_mask_metrics": """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS tp, l_tax * 100 AS fp, l_discount * 100 AS fn FROM lineitem WHERE l_quantity > 0)
      SELECT l_orderkey, l_linenumber, round((2 * tp + 1e-7) / (2 * tp + fp + fn + 1e-7), 6) AS dice, round((tp + 1e-7) / (tp + fp + fn + 1e-7), 6) AS iou, round((tp + 1e-7) / (tp + fp + 1e-7), 6) AS precision, round((tp + 1e-7) / (tp + fn + 1e-7), 6) AS recall FROM t""",
    "n1_dual_threshold": f"""WITH {SCORES}, g AS (SELECT i, i / 100.0::DOUBLE AS t FROM range(1, 100) r(i)), lo AS (SELECT i, t, count(*) AS n FROM g JOIN scores ON score <= t GROUP BY i, t HAVING avg(1 - label) >= 0.05 - 1e-12), hi AS (SELECT i, t, count(*) AS n FROM g JOIN scores ON score >= t GROUP BY i, t HAVING avg(label) >= 0.85 - 1e-12),
      p AS (SELECT lo.t AS a, hi.t AS b, lo.n + hi.n AS n FROM lo JOIN hi ON lo.i < hi.i), best AS (SELECT * FROM p ORDER BY n DESC, a DESC, b LIMIT 1), side AS (SELECT (SELECT max(t) FROM lo) AS l, (SELECT min(t) FROM hi) AS h)
      SELECT round(coalesce(a, CASE WHEN l IS NOT NULL AND h IS NULL THEN least(l, 0.79) WHEN l IS NOT NULL THEN 0.49 ELSE 0.2 END), 6) AS t_clear, round(coalesce(b, CASE WHEN h IS NOT NULL AND l IS NULL THEN greatest(h, 0.21) WHEN h IS NOT NULL THEN 0.5 ELSE 0.8 END), 6) AS t_retake,
      round(n / (SELECT count(*) FROM scores)::DOUBLE, 6) AS coverage, CASE WHEN a IS NOT NULL THEN 'targets_met' ELSE 'fallback' END AS status FROM side LEFT JOIN best ON true""",
    "n3_tail_thresholds": f"WITH {FEATURES}, g AS (SELECT * FROM features WHERE label = 1) SELECT 'chars' AS feature, round(greatest(quantile_cont(chars, 0.05), 100.0), 6) AS warning, round(quantile_cont(chars, 0.01), 6) AS retake FROM g UNION ALL SELECT 'stops', round(quantile_cont(stops, 0.95), 6), round(quantile_cont(stops, 0.99), 6) FROM g",
    "n4_capped_threshold": f"""WITH {FEATURES}, g AS (SELECT lines AS v, row_number() OVER (ORDER BY lines DESC) AS k, count(*) OVER () AS total FROM features WHERE label = 1)
      SELECT min(v) AS largest_allowed, (SELECT round(quantile_cont(v, 0.95), 6) FROM g) AS warning, any_value(total) AS total, any_value(floor(total * 0.02))::BIGINT AS allowed FROM g WHERE k = floor(total * 0.02) + 1""",
    "n9_style_ranges": f"""WITH {FEATURES}, l AS (SELECT dataset AS domain, 'chars' AS feature, chars AS value FROM features UNION ALL SELECT dataset, 'stops', stops FROM features), m AS (SELECT domain, feature, avg(value) AS mean, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM l GROUP BY ALL)
      SELECT m.domain, m.feature, round(m.p05, 6) AS p05, round(m.p95, 6) AS p95, round(greatest(0.9, least(1.1, m.mean / b.mean)), 6) AS ratio FROM m JOIN m b ON b.feature = m.feature AND b.domain = 'en'""",
    "f15_quantile_summary": f"WITH {FEATURES} SELECT dataset, count(words) AS count, count(*) FILTER (words IS NULL) AS missing, round(avg(words), 6) AS mean, round(stddev_pop(words), 6) AS std, min(words) AS min, max(words) AS max, round(quantile_cont(words, 0.05), 6) AS p05, round(quantile_cont(words, 0.5), 6) AS p50, round(quantile_cont(words, 0.95), 6) AS p95 FROM features GROUP BY dataset",
    "f18_scope_distribution": f"""WITH {FEATURES}, l AS (SELECT dataset, 'chars' AS feature, chars AS value FROM features UNION ALL SELECT dataset, 'lines', lines FROM features), s AS (SELECT feature, dataset AS scope, value FROM l UNION ALL SELECT feature, 'overall', value FROM l)
      SELECT feature, scope, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM s GROUP BY ALL""",
    "f19_nearest_rank": "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, n_chars AS value, n FROM r WHERE k = round_even((n - 1) * 0.25, 0)",
    "g11_size_buckets": f"WITH {FEATURES}, e AS (SELECT quantile_cont(chars, 0.33) AS a, quantile_cont(chars, 0.66) AS b FROM features) SELECT CASE WHEN chars < a THEN 'small' WHEN chars <= b THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM features, e GROUP BY 1",
    "h1_worst_k": f"WITH {SCORES} SELECT sample_id, score FROM scores ORDER BY score, sample_id LIMIT 10",
    "h3_review_candidates": f"WITH {SCORES} SELECT dataset, label, rank, sample_id, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY score DESC, sample_id)::INTEGER AS rank FROM scores) WHERE rank <= 3",
    "p1_cohens_d": f"WITH {_STATS}, s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS sd FROM m) SELECT feature, n0, n1, round(CASE WHEN n0 < 2 OR n1 < 2 THEN NULL WHEN sd < 1e-12 THEN 0 ELSE (m1 - m0) / sd END, 6) AS d FROM s",
    "p2_cohens_d_mean_variance": f"WITH {_STATS}, s AS (SELECT *, sqrt((v1 + v0) / 2) AS sd FROM m) SELECT feature, n0, n1, round(CASE WHEN n0 < 2 OR n1 < 2 THEN NULL WHEN sd < 1e-12 THEN 0 ELSE (m1 - m0) / sd END, 6) AS d FROM s",
    "p3_robust_median_difference": f"""WITH {LONG}, m AS (SELECT feature, quantile_cont(value, 0.5) FILTER (label = 0) AS m0, quantile_cont(value, 0.5) FILTER (label = 1) AS m1, quantile_cont(value, 0.5) AS m FROM long GROUP BY feature), d AS (SELECT feature, quantile_cont(abs(value - m.m), 0.5) AS mad FROM long JOIN m USING (feature) GROUP BY feature)
      SELECT feature, round(m1 - m0, 6) AS difference, round(CASE WHEN 1.4826 * mad < 1e-12 THEN 0 ELSE (m1 - m0) / (1.4826 * mad) END, 6) AS robust_d FROM m JOIN d USING (feature)""",
    "p4_ks_wasserstein": f"""WITH {LONG}, v AS (SELECT feature, value, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM long GROUP BY ALL),
      c AS (SELECT feature, value, lead(value) OVER w AS nx, abs(sum(a) OVER w / (sum(a) OVER (PARTITION BY feature))::DOUBLE - sum(b) OVER w / (sum(b) OVER (PARTITION BY feature))::DOUBLE) AS gap FROM v WINDOW w AS (PARTITION BY feature ORDER BY value))
      SELECT feature, round(max(gap), 6) AS ks, round(sum(gap * (nx - value)), 6) AS wasserstein FROM c GROUP BY feature""",
    "p6_quantile_strata": f"WITH {_BINS} SELECT bin::INTEGER AS bin, n, round(rate, 6) AS rate, low, high FROM strata",
    "p6_strata_verdict": f"WITH {_BINS}, s AS (SELECT rate, rate - lag(rate) OVER (ORDER BY bin) AS step FROM strata), v AS (SELECT max(rate) - min(rate) AS span, coalesce(bool_and(step >= 0), true) OR coalesce(bool_and(step <= 0), true) AS monotone FROM s) SELECT round(span, 6) AS span, monotone, span >= 0.25 OR (monotone AND span >= 0.15) AS confounded FROM v",
    "p7_metadata_confounding": f"""WITH {FEATURES}, k AS (SELECT 'dataset' AS key, dataset AS "group", label FROM features UNION ALL SELECT 'source', source, label FROM features), n AS (SELECT key, "group", count(*) AS n, avg(label) AS rate FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, "group") AS rk FROM n)
      SELECT key, "group", n, round(rate, 6) AS rate, n >= 10 AND (rate >= 0.95 OR rate <= 0.05) AS extreme FROM r WHERE rk <= 8""",
    "p8_near_duplicates": """WITH g AS (SELECT count(*) AS n, count(DISTINCT quality) AS l FROM documents JOIN labels USING (doc_id) GROUP BY md5(lower(text)) HAVING count(*) > 1) SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_samples, count(*) FILTER (l > 1) AS cross_label, count(*) FILTER (l <= 1) AS same_label, count(*) FILTER (l > 1) > 0 AS concern FROM g""",
    "p9_common_support": f"""WITH {SCORES}, s AS (SELECT label, score + label * 0.25::DOUBLE AS x FROM scores), r AS (SELECT greatest(min(x) FILTER (label = 0), min(x) FILTER (label = 1)) AS low, least(max(x) FILTER (label = 0), max(x) FILTER (label = 1)) AS high FROM s)
      SELECT round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(avg((x BETWEEN low AND high)::INTEGER) FILTER (label = 0), 6) AS rate0, round(avg((x BETWEEN low AND high)::INTEGER) FILTER (label = 1), 6) AS rate1, round(avg((x BETWEEN low AND high)::INTEGER), 6) AS rate FROM s, r""",
    "p10_caliper_candidates": f"""WITH {FEATURES}, m AS (SELECT avg(chars) AS a, stddev_pop(chars) AS b, avg(lines) AS c, stddev_pop(lines) AS d, avg(stops) AS e, stddev_pop(stops) AS f FROM features), z AS (SELECT sample_id, label, (chars - a) / b AS x, (lines - c) / d AS y, (stops - e) / f AS w FROM features, m),
      p AS (SELECT p.sample_id AS positive, n.sample_id AS negative, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.w - n.w) * (p.w - n.w)) AS distance FROM z p JOIN z n ON p.label = 1 AND n.label = 0) SELECT positive, negative, round(distance, 6) AS distance FROM p WHERE distance <= 0.3""",
    "p13_centroid_distances": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL""",
    "p15_probability_shift": f"WITH {SCORES} SELECT dataset, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(avg((score >= 0.5)::INTEGER), 6) AS high_rate FROM scores GROUP BY dataset",
    "p16_mode_ablation": f"""WITH {SCORES}, l AS (SELECT dataset AS cohort, 'full' AS mode, score FROM scores UNION ALL SELECT dataset, 'half', score / 2 FROM scores UNION ALL SELECT dataset, 'square', score * score FROM scores), m AS (SELECT cohort, mode, quantile_cont(score, 0.5) AS median FROM l GROUP BY ALL), d AS (SELECT m.*, m.median - b.median AS delta FROM m JOIN m b ON b.cohort = m.cohort AND b.mode = 'full')
      SELECT cohort, mode, round(median, 6) AS median, round(delta, 6) AS delta, first(mode) OVER (PARTITION BY cohort ORDER BY abs(delta) DESC, mode DESC) AS most_sensitive FROM d""",
    "p17_spearman": f"WITH {FEATURES}, r AS (SELECT rank() OVER (ORDER BY chars) + (count(*) OVER (PARTITION BY chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0::DOUBLE AS b FROM features) SELECT 'chars' AS a, 'lines' AS b, count(*) AS n, round(corr(r.a, r.b), 6) AS rho FROM r",
    "p18_pearson": f"WITH {FEATURES} SELECT round(corr(chars, lines), 6) AS r FROM features",
    "p21_confounding_level": f"""WITH {SCORES}, t AS (SELECT dataset, label, score + label * 0.4::DOUBLE AS x FROM scores), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY x) + (count(*) OVER (PARTITION BY dataset, x) - 1) / 2.0::DOUBLE AS rk FROM t), s AS (SELECT dataset, sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY dataset),
      a AS (SELECT dataset, CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END AS auroc FROM s) SELECT dataset, round(auroc, 6) AS auroc, CASE WHEN auroc IS NULL THEN 'UNKNOWN' WHEN auroc >= 0.9 THEN 'SEVERE' WHEN auroc >= 0.8 THEN 'MODERATE' WHEN auroc >= 0.65 THEN 'LOW' ELSE 'NONE' END AS level FROM a""",
    "m1_gate_checks": f"""WITH {_GATE} SELECT sample_id, check_id, evaluation_state, CASE WHEN evaluation_state = 'evaluated' THEN coalesce(find, CASE WHEN e = 'pass' THEN 'false' ELSE 'true' END) END AS finding, CASE e WHEN 'retake' THEN 'severe' WHEN 'warning' THEN 'moderate' WHEN 'pass' THEN 'none' END AS severity, e AS decision_effect, r AS reason_code FROM c""",
    "m13_gate_decisions": f"WITH {_GATE} SELECT * FROM decided",
    "m22_decisions_from_rows": f"WITH {_GATE} SELECT * FROM decided",
    "m20_ablation": f"""WITH {_GATE}, l AS (SELECT * FROM (VALUES ('a', 0), ('b', 0), ('b', 1), ('b', 3), ('c', 0), ('c', 1), ('c', 2), ('c', 3), ('d', 0), ('d', 1), ('d', 2), ('d', 3), ('d', 4)) t(layer, seq)),
      w AS (SELECT layer, sample_id, CASE WHEN bool_or(e = 'retake') THEN 'retake' WHEN bool_or(e = 'warning') THEN 'warning' ELSE 'pass' END AS decision FROM c JOIN l USING (seq) GROUP BY ALL) SELECT layer, decision, count(*) AS n FROM w GROUP BY ALL""",
    "m21_attribution": f"""WITH {_GATE}, g AS (SELECT sample_id, concat_ws('+', CASE WHEN bool_or(seq < 2 AND e = 'retake') THEN 'size' END, CASE WHEN bool_or(seq = 3 AND e = 'retake') THEN 'focus' END, CASE WHEN bool_or(seq = 2 AND e = 'retake') THEN 'cast' END, CASE WHEN bool_or(seq = 4 AND e = 'retake') THEN 'stain' END) AS b FROM c GROUP BY 1)
      SELECT CASE WHEN contains(b, '+') THEN b ELSE b || '_only' END AS bucket, count(*) AS n FROM g WHERE b <> '' GROUP BY 1""",
    "f28_status_breakdown": f"WITH {_GATE}, s AS (SELECT check_id, coalesce(e, 'null') AS status FROM c) SELECT check_id, status, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'overall', status, count(*) FROM s GROUP BY status",
    "f29_incomplete_reasons": f"WITH {_GATE}, s AS (SELECT sample_id, bool_or(evaluation_state = 'unavailable') AS u, bool_or(evaluation_state = 'not_evaluated') AS n FROM c WHERE check_id <> 'later' GROUP BY 1) SELECT CASE WHEN u THEN 'unavailable' WHEN n THEN 'not_evaluated' ELSE 'complete' END AS why, count(*) AS n FROM s GROUP BY 1",
    "c28_reason_counts": f"WITH {_GATE} SELECT r AS reason, count(*) AS n FROM c WHERE r IS NOT NULL GROUP BY r",
    "l9_integrity": f"WITH {_GATE} SELECT sample_id, 'pass' AS decision FROM decided WHERE primary_reason = 'SMALL'",
    "c3_infer_split": """WITH p AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/Train/x.jpg' WHEN 1 THEN '/valid/x.jpg' ELSE '/x.jpg' END AS path FROM pages), s AS (SELECT page_id, string_split(lower(path), '/') AS parts, string_split(path, '/') AS own FROM p)
      SELECT page_id, CASE WHEN list_contains(parts, 'train') THEN 'train' WHEN list_contains(parts, 'val') OR list_contains(parts, 'valid') OR list_contains(parts, 'validation') THEN 'val' WHEN list_contains(parts, 'test') THEN 'test' END AS split, coalesce(nullif(own[-2], ''), 'unknown') AS folder, 'x' AS stem, true AS image FROM s""",
    "c4_norm_label": "SELECT event_id, CASE WHEN value > 50 THEN 'true' ELSE ' ' || event_type || ' ' END AS label, (trunc(round(value, 0)) = 1)::INTEGER AS truth, CASE WHEN value / 100 <= 0.3 THEN 'false' WHEN value / 100 >= 0.6 THEN 'true' ELSE 'uncertain' END AS band FROM events",
    "c18_letterbox": """WITH p AS (SELECT p_partkey, p_size + 1 AS w, p_partkey % 97 + 1 AS h FROM part), s AS (SELECT *, least(64 / w::DOUBLE, 64 / h::DOUBLE) AS k FROM p), r AS (SELECT p_partkey, greatest(1, round_even(w * k, 0))::INTEGER AS a, greatest(1, round_even(h * k, 0))::INTEGER AS b FROM s)
      SELECT p_partkey, a AS resized_width, b AS resized_height, (64 - a) // 2 AS pad_left, (64 - b) // 2 AS pad_top, 64 - a - (64 - a) // 2 AS pad_right, 64 - b - (64 - b) // 2 AS pad_bottom FROM r""",
    "c20_keyword_hits": "SELECT doc_id, array_to_string(list_filter(['the', 'license', 'idiot', 'copyright', 'email'], lambda k: contains(lower(substr(text, 1, 20000)), k)), '|') AS hits FROM documents",
    "c27_json_props": "SELECT event_type, 'k' AS key, sum((props->>'$.k')::INTEGER)::BIGINT AS total, count(*) AS n FROM events WHERE (props->>'$.k') IS NOT NULL GROUP BY event_type",
    "e13_unique_fuzzy_match": """WITH k AS (SELECT lower(r_name) AS rid FROM region UNION SELECT substr(n_name, 2) FROM nation), e AS (SELECT rid, n_name AS stem, 'exact' AS how FROM k JOIN nation ON rid = n_name), r AS (SELECT rid FROM k WHERE rid NOT IN (SELECT rid FROM e)),
      m AS (SELECT rid, n_name AS stem, count(*) OVER (PARTITION BY rid) AS n FROM r JOIN nation ON contains(n_name, rid) OR contains(rid, n_name)) SELECT * FROM e UNION ALL SELECT rid, stem, 'contained' FROM m WHERE n = 1""",
    "f22_scan_counts": """WITH n AS (SELECT lang AS dataset, count(*) AS n_files, count(*) FILTER (n_chars >= 100) AS readable, count(*) FILTER (n_chars < 100) AS corrupt, count(DISTINCT md5(text)) AS unique_digests FROM documents GROUP BY lang),
      c AS (SELECT lang AS dataset, count(*) AS n FROM documents GROUP BY lang, md5(text) HAVING count(*) > 1), e AS (SELECT dataset, count(*) AS g, sum(n - 1)::BIGINT AS x FROM c GROUP BY dataset)
      SELECT n.*, coalesce(g, 0) AS duplicate_groups, coalesce(x, 0) AS extra_files FROM n LEFT JOIN e USING (dataset)""",
    "f22_top_sizes": """WITH z AS (SELECT lang AS dataset, (n_chars % 7)::VARCHAR || 'x' || (n_chars % 5)::VARCHAR AS size, count(*) AS n FROM documents GROUP BY ALL) SELECT dataset, size, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, size)::INTEGER AS rank FROM z) WHERE rank <= 3""",
    "e12_pairing": """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, count(*) FILTER (b IS NULL) AS only_first, count(*) FILTER (a IS NULL) AS only_second, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / (count(*) FILTER (a IS NOT NULL))::DOUBLE, 6) AS rate
      FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b""",
    "o12_regression": f"""WITH {SCORES}, x AS (SELECT dataset AS domain, 1 - avg((score - label) * (score - label)) AS now, 1 - avg((score - label) * (score - label)) FILTER (source <> 'src0') AS before FROM scores GROUP BY dataset)
      SELECT domain, round(now, 6) AS now, round(before, 6) AS before, round(now - before, 6) AS delta, CASE WHEN now - before IS NULL THEN 'missing' WHEN now - before < -0.01 THEN 'failed' WHEN now - before < -0.001 THEN 'warning' ELSE 'ok' END AS status FROM x""",
    "i2_star_revenue": """SELECT r_name, year(o_orderdate)::INTEGER AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, 2)""",
}
#: Positives one after another, each with its nearest negative that is not used yet.
ORACLE_SQL["p10_caliper_matching"] = f"""WITH RECURSIVE c AS ({ORACLE_SQL["p10_caliper_candidates"].replace("round(distance, 6) AS distance", "distance")}),
  pos AS (SELECT positive, row_number() OVER (ORDER BY positive) AS k FROM (SELECT DISTINCT positive FROM c)), own AS (SELECT k, list({{'n': negative, 'd': distance}} ORDER BY distance, negative) AS options FROM c JOIN pos USING (positive) GROUP BY k),
  step AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS negative, NULL::DOUBLE AS distance
    UNION ALL SELECT o.k, CASE WHEN len(o.free) > 0 THEN list_append(used, o.free[1].n) ELSE used END, o.free[1].n, o.free[1].d FROM (SELECT s.used, own.k, list_filter(own.options, lambda x: NOT list_contains(s.used, x.n)) AS free FROM step s JOIN own ON own.k = s.k + 1) o)
  SELECT positive, negative, round(distance, 6) AS distance FROM step JOIN pos USING (k) WHERE negative IS NOT NULL"""
