"""Explicit schemas as DDL: ids stay strings (leading zeros), nothing is inferred."""

from __future__ import annotations

SPLIT_TABLE = (
    "sample_id string, label string, text string, image_path string, attack_family string, "
    "severity string, runtime_ocr string")
LABELS = "sample_id string, label string, attack_family string"
CORRECTED_SPLITS = "sample_id string, corrected_split string"
CHECK_REPORT = "check_name string, value string"
OCR_CACHE = "image_path string, ocr_text_cached string, ocr_confidence double"
OCR_LOG = (
    "image_path string, sample_id string, ocr_text_cached string, ocr_confidence double, "
    "char_count int, processing_time_sec double, error string")
BOX = "struct<text: string, confidence: double, x0: double, y0: double, x1: double, y1: double>"
OCR_RESULT = (
    f"sample_id string, text string, confidence double, boxes array<{BOX}>, duration_ms double, "
    "engine string, error string")
VISION = (
    "sample_id string, image_path string, ocr_confidence double, tiny_text_count int, "
    "footer_text_density double, watermark_score double, hidden_text_score double, "
    "keyword_density double, total_boxes int, total_words int, vision_score double, error string")
PREDICTIONS = (
    "sample_id string, true_label int, predicted_label int, malicious_probability double, attack_family string")
RISK_SCORES = "sample_id string, risk_score double, split string, risk_level string"
DECISIONS = (
    "sample_id string, decision string, rule_id string, rule_name string, severity string, "
    "policy_ref string, reason string")
AUDIT = (
    "audit_log_id string, sample_id string, timestamp string, decision string, risk_score double, "
    "risk_level string, prompt_score double, vision_score double, confidence double, "
    "governance_rule_triggered string, reason string, sanitization_action string, policy_ref string, "
    "attack_family_predicted string, vision_ms double, prompt_ms double, risk_ms double, "
    "governance_ms double, total_ms double, vision_error string, prompt_error string, agent_version string")

# Columns of a split table that a dataset may lack.
OPTIONAL_SPLIT_COLUMNS = ["image_path", "attack_family", "severity", "runtime_ocr"]
