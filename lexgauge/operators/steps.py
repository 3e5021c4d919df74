"""Which pipeline steps a payload asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Step names per stage, content type and use case.
INGEST_BASE = ["validate_source", "calculate_checksums"]
INGEST = {
    "images": ["load_images", "extract_image_metadata", "generate_thumbnails"],
    "documents": ["load_documents", "extract_text_from_pdf", "index_document_metadata"],
    "text": ["load_text_records", "tokenise_text", "detect_language"],
    "mixed": [
        "load_images",
        "load_documents",
        "load_text_records",
        "extract_image_metadata",
        "extract_text_from_pdf",
        "tokenise_text",
        "detect_language",
    ],
}
TRANSFORM_BASE = ["compute_record_metrics", "compute_time_series"]
TRANSFORM = {
    "images": ["run_image_classification", "compute_visual_embeddings"],
    "documents": ["run_document_classification", "compute_text_embeddings", "extract_named_entities"],
    "text": ["run_sentiment_analysis", "compute_text_embeddings", "extract_named_entities"],
    "mixed": [
        "run_image_classification",
        "run_document_classification",
        "compute_visual_embeddings",
        "compute_text_embeddings",
        "extract_named_entities",
    ],
}
EXPORT = [
    "clear_destination",
    "transfer_records",
    "transfer_metrics",
    "transfer_embeddings",
    "transfer_time_series",
    "log_etl_run",
]
USE_CASE = {
    "vr": ["generate_3d_scene_manifest", "export_spatial_metadata"],
    "ai-training": ["split_train_val_test", "export_dataset_manifest", "validate_dataset_schema"],
    "research": ["export_structured_csv", "generate_data_dictionary", "attach_provenance_metadata"],
    "education": ["generate_lesson_plan_metadata", "export_accessible_formats"],
    "preservation": [
        "write_archival_manifest",
        "verify_long_term_checksums",
        "replicate_to_cold_storage",
    ],
    "accessibility": ["generate_alt_text", "generate_captions", "export_screen_reader_metadata"],
    "public-engagement": ["publish_to_public_api", "generate_dashboard_summary"],
    "policy": ["generate_policy_brief_metadata", "export_structured_summary"],
    "economic-development": ["compute_economic_indicators", "export_trend_report"],
    "national-security": ["apply_classification_labels", "route_to_secure_enclave"],
    "environmental": ["compute_environmental_metrics", "export_conservation_report"],
    "cultural": ["link_cross_agency_records", "export_cultural_heritage_manifest"],
    "historical": ["build_timeline_index", "export_historical_record_manifest"],
    "scientific": ["validate_scientific_schema", "export_peer_review_package"],
}
DEFAULTS = {"content_type": "mixed", "stage": "full", "use_case": "general"}


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lookup(key: Column, table: dict[str, list[str]]) -> Column:
    result = F.when(F.lit(False), _texts([]))
    for name, steps in table.items():
        result = result.when(key == name, _texts(steps))
    return result.otherwise(_texts([]))


def steps_for(stage: Column, content_type: Column, use_case: Column) -> Column:
    """The ordered steps as an array: stage by content type, then use case."""

    def in_stage(name: str, steps: Column) -> Column:
        return F.when(stage.isin(name, "full"), steps).otherwise(_texts([]))

    return F.concat(
        in_stage("ingest", F.concat(_texts(INGEST_BASE), _lookup(content_type, INGEST))),
        in_stage("transform", F.concat(_texts(TRANSFORM_BASE), _lookup(content_type, TRANSFORM))),
        in_stage("export", _texts(EXPORT)),
        _lookup(use_case, USE_CASE),
    )
