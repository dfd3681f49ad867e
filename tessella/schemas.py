"""The tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAMPLES = "sample_id string, dataset string, source_sample_id string, source_image_path string, md5 string, width int, height int, patient_id string, patient_id_available boolean, source_split string, duplicate_group_id string, dataset_version string, ingest_version string"
LABELS = "sample_id string, canonical_task string, canonical_label string, value int, label_available boolean, source_dataset string, source_field string, source_label string, annotation_type string, label_source string, supervision_tier string, mapping_status string, mapping_version string, confidence double, note string"
SPATIAL = "sample_id string, annotation_id string, annotation_task string, canonical_label string, annotation_type string, x_min double, y_min double, x_max double, y_max double, mask_path string, source_dataset string, source_label string, label_source string, supervision_tier string, mapping_status string, mapping_version string, note string"
ASSIGNMENTS = "sample_id string, origin_sample_id string, dataset string, unit_type string, canonical_task string, canonical_label string, label_source string, supervision_tier string, supervision_pool string, eligible_for_train boolean, eligible_for_val boolean, eligible_for_test boolean, reason string, policy_version string"
SCORES = "sample_id string, dataset string, split string, label int, p_stain double, logit double"
CHECKS = "sample_id string, check_id string, evaluation_state string, finding string, severity string, decision_effect string, score double, reason_code string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def missing_columns(df: DataFrame, ddl: str) -> list[str]:
    """What a table lacks of a schema, by name and type."""
    have = dict(df.dtypes)
    return [f"{f.name} {f.dataType.simpleString()}" for f in struct(ddl) if have.get(f.name) != f.dataType.simpleString()]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, cast; what is missing is null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])
