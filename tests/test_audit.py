import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import audit, gate, metrics
from tessella.sources import sinks
from tessella.streaming import gate as stream


def test_scan_report(spark):
    rows = [("d", "1", "m", 5, 5, "a", None), ("d", "2", "m", 5, 5, "b", None), ("d", "3", "n", None, None, "a", "broken"), ("e", "4", "m", 7, 5, "c", None)]
    r = audit.scan_report(spark.createDataFrame(rows, "dataset string, path string, md5 string, width int, height int, stem string, error string"))
    got = {x.dataset: x for x in r["counts"].collect()}
    assert (got["d"].n_files, got["d"].corrupt, got["d"].extra_files, got["e"].extra_files) == (3, 1, 1, 0)
    assert [(x.size, x.n) for x in r["sizes"].filter("dataset = 'd'").collect()] == [("5x5", 2)]
    assert r["stems"].filter("dataset = 'd'").orderBy("rank").first().stem == "a"


def test_pairing_and_drift(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abc", "bcd"))
    assert tuple(audit.pairing(a, b, "k").first()) == (2, 1, 1, 2 / 3)
    assert audit.name_drift(["a", "b"], ["a", "c", "d"]) == [(1, "b", "c"), (2, None, "d")]


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_a_classifier_sees_what_separates(spark, kind):
    r = random.Random(1)
    rows = [(str(i), int(i % 3 == 0), r.gauss(2.0 * (i % 3 == 0), 1), r.gauss(0, 1) if i % 7 else None) for i in range(400)]
    scored = audit.diagnostic_classifier(spark.createDataFrame(rows, "sample_id string, label int, a double, b double"), ["a", "b"], "label", kind=kind, folds=3).cache()
    assert scored.count() == 400
    assert metrics.auroc(scored).first().auroc > 0.85
    acc = audit.identity_accuracy(scored).first()
    assert 0.7 < acc.accuracy <= 1 and acc.std < 0.2


def test_decisions(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    assert f(audit.gate_status(F.lit(0.95), 0.9, 0.8)) == "target_met" and f(audit.gate_status(F.lit(0.7), 0.9, 0.8)) == "failed"
    assert math.isclose(f(audit.gap_reduction(F.lit(0.4), F.lit(0.1))), 0.75)
    assert f(audit.candidate_verdict(F.lit(0.02), F.lit(0.5))) == "rejected_regression"
    assert f(audit.evidence(F.lit(-0.9))) == "strong" and f(audit.data_action(F.lit("SEVERE"), F.lit(0.1), F.lit(0.5))) == "recollect"
    assert f(audit.verdict(F.lit(0), F.lit(1))) == "proceed_with_care"


def test_regression(spark):
    now = spark.createDataFrame([("a", 0.9), ("b", 0.95), ("c", 0.5)], "domain string, metric double")
    before = spark.createDataFrame([("a", 0.93), ("b", 0.95), ("d", 0.5)], "domain string, metric double")
    assert {r.domain: r.status for r in audit.regression(now, before).collect()} == {"a": "failed", "b": "ok", "c": "missing", "d": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    none = spark.createDataFrame([], "rule string, key string")
    assert sinks.published(str(tmp_path / "a"), none, t=df) == {"t": 3}
    with pytest.raises(ValueError, match="broken"):
        sinks.published(str(tmp_path / "b"), spark.createDataFrame([("r", "k")], "rule string, key string"), t=df)
    assert not (tmp_path / "b" / "t").exists() and (tmp_path / "b" / "violations").exists()
    assert sinks.statistics(str(tmp_path), "s", df.agg(F.count("*").alias("n"))) == {"n": 3}
    sinks.freeze_thresholds(spark, str(tmp_path / "f"), 0.2, 0.8, "1")
    assert sinks.load_thresholds(spark, str(tmp_path / "f")) == ("1", 0.2, 0.8)
    with pytest.raises(ValueError):
        sinks.freeze_thresholds(spark, str(tmp_path / "g"), 0.8, 0.8, "1")
    assert sinks.markdown(df.limit(1)).startswith("| id |")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", f"m{i % 3}", "d", float(i), f"2024-01-01 0{i % 4}:00:00") for i in range(8)], "sample_id string, md5 string, dataset string, x double, t string").selectExpr("sample_id", "md5", "dataset", "x", "to_timestamp(t) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    rules = (gate.Check("c", (gate.Rule("x", "<", 2.0, "retake", "LOW"), gate.Rule("x", "<", 4.0, "warning", "LOW"))),)
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.sql(f"select * from {name}").collect()

    decided = run(stream.decisions(source(), rules), "decided", "append")
    assert sorted(r.decision for r in decided) == ["pass"] * 4 + ["retake"] * 2 + ["warning"] * 2
    counts = run(stream.decision_counts(stream.decisions(source(), rules)), "counted", "complete")
    assert sum(r.n for r in counts) == 8
    assert len(run(stream.first_copies(source()), "copies", "append")) == 3
    assert len(run(stream.checks(source(), rules), "checked", "append")) == 8
