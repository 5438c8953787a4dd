"""The ledger tables as Spark schemas. Lists and maps are arrays and maps, never JSON text."""

from __future__ import annotations

LEDGER = {
    "unit_vectors": "unit_id string, source_id string, text_hash string, vec array<double>",
    "sources": "source_id string, title string, document_type string, raw_sha256 string, security_label string, created_at timestamp, year int, geography string",
    "evidence_spans": "span_id string, source_id string, artifact_id string, span_type string, visible_text string, locator struct<stable_locator: string, extra: map<string, string>>, page int, validation_status string, evidence_confidence double, security_label string",
    "property_measurements": "measurement_id string, source_id string, experiment_id string, property_id string, property_name string, value double, unit string, original_value string, method string, supporting_span_ids array<string>, validation_status string",
    "effect_claims": "effect_id string, source_id string, experiment_id string, material_id string, material_name string, regime_id string, regime_summary string, property_id string, direction string, delta_value double, delta_unit string, qualitative_only boolean, baseline_id string, treated_id string, supporting_span_ids array<string>",
    "answer_claims": "answer_id string, claim_id string, claim_text string, supporting_span_ids array<string>, supporting_fact_ids array<string>, graph_path_ids array<string>, status string, created_at timestamp",
    "ingestion_runs": "run_id string, source_id string, status string, stage string, error string, counters map<string, bigint>, created_at timestamp",
    "artifacts": "artifact_id string, source_id string, artifact_type string, parser_profile string, locator string, meta map<string, string>",
    "entities": "entity_id string, entity_type string, canonical_key string, canonical_name string, description string, metadata map<string, string>, evidence_span_ids array<string>, confidence double, validation_status string, created_at timestamp, updated_at timestamp",
    "entity_aliases": "alias_norm string, entity_id string, alias string, source string",
    "relations": "relation_id string, src_entity_id string, relation_type string, dst_entity_id string, evidence_span_ids array<string>, confidence double, validation_status string, created_at timestamp",
    "extraction_claims": "claim_id string, source_id string, span_id string, payload string, model_id string, status string, created_at timestamp",
    "answer_runs": "run_id string, question string, filters map<string, string>, packet_stats map<string, bigint>, model_id string, latency_ms int, verification map<string, double>, created_at timestamp",
    "eval_results": "run_id string, question_id string, metrics map<string, double>, created_at timestamp",
    "numeric_facts": "fact_id string, source_id string, span_id string, subject string, subject_label string, prop string, value double, unit string, qualifier string, confidence double, status string, created_at timestamp",
}

#: The column whose hash names the bucket of a row; tables of one source's rows go by the source.
BUCKET_KEYS = {name: "source_id" if "source_id string" in schema else schema.split()[0] for name, schema in LEDGER.items()}

# The enumerations of the ledger.
SPAN_TYPES = ("text", "table_row", "table_cell", "figure", "page_image")
VALIDATION = ("raw", "extracted", "normalized", "validated_rule", "validated_manual", "rejected", "conflict", "needs_review")
DIRECTIONS = ("increase", "decrease", "no_change", "mixed", "unknown")
EXPERIMENT_COLUMNS = ("experiment_id", "material", "regime", "temperature_c", "duration_h", "atmosphere", "property", "method", "baseline_value", "treated_value", "unit", "effect")
