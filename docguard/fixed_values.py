"""Word lists, weights, thresholds and the default rule table.

Results only come out right with exactly these values, so they are stated here as
plain text and nowhere else.  Everything that uses them takes them as a parameter.
"""

# --- word lists -----------------------------------------------------------------

# Phrases matched at word boundaries (keyword_hits, keyword_density).
INJECTION_PHRASES = [
    "ignore", "disregard", "forget", "override", "bypass", "pretend",
    "you are now", "act as", "roleplay", "system prompt", "system message",
    "previous instructions", "instruction override", "jailbreak",
    "ignore previous", "disregard previous", "new instructions",
    "ignore all", "ignore the above", "from now on",
    "reveal", "extract", "exfiltrate", "print your", "show me your",
    "what is your", "tell me your", "confidential", "internal",
    "claim manipulation", "approve claim", "deny claim",
    "inject", "payload", "malicious", "hack", "exploit",
    "translate", "summarize", "evaluate", "secret", "prompt",
    "developer mode", "do not refuse", "unrestricted", "assistant",
]

# Phrases matched as substrings (heuristic_score).
HEURISTIC_PHRASES = [
    "ignore", "disregard", "forget", "override", "bypass", "pretend",
    "you are now", "act as", "system prompt", "previous instructions",
    "instruction override", "jailbreak", "ignore previous", "ignore all",
    "reveal", "extract", "exfiltrate", "confidential", "internal",
    "claim manipulation", "approve claim", "deny claim",
]

# Verbs counted among the first twenty words (heuristic_score).
IMPERATIVE_VERBS = [
    "ignore", "forget", "disregard", "pretend", "act", "reveal", "show",
    "print", "tell", "override", "bypass",
]

# --- weights, thresholds, layouts -------------------------------------------------

VISION_WEIGHTS = {
    "keyword_density": 0.60,
    "hidden_text_score": 0.10,
    "watermark_score": 0.05,
    "footer_density": 0.05,
    "tiny_text_count": 0.05,
    "ocr_confidence": 0.15,
}

# Lower bound of each risk level; anything else is CRITICAL.
RISK_LEVELS = [("LOW", 0.0, 0.35), ("MEDIUM", 0.35, 0.65), ("HIGH", 0.65, 0.80)]

SEVERITY_CODES = {"low": 0, "medium": 1, "high": 2, "critical": 3}

LABEL_CODES = {"benign": 0, "malicious": 1}

SPLITS = ["train", "val", "test"]

DECISIONS = ["ALLOW", "SANITIZE", "BLOCK"]

DECISION_BADGES = {"ALLOW": "✅", "SANITIZE": "⚠️", "BLOCK": "🚫"}

FOURTEEN_FEATURES = [
    "malicious_probability",
    "keyword_density", "total_words",
    "ocr_confidence", "tiny_text_count", "footer_text_density",
    "watermark_score", "hidden_text_score", "total_boxes",
    "vision_score",
    "prompt_vision_agreement", "max_signal", "signal_product", "signal_diff",
]

NINE_FEATURES = [
    "malicious_probability",
    "ocr_confidence", "tiny_text_count", "footer_text_density",
    "watermark_score", "hidden_text_score", "keyword_density", "vision_score",
    "severity_enc",
]

# Image columns that default to 0.0 for documents without an image.
IMAGE_COLUMNS = [
    "ocr_confidence", "tiny_text_count", "tiny_text_ratio",
    "footer_text_density", "footer_keyword_count",
    "hidden_text_detected", "hidden_text_count",
    "watermark_detected", "text_region_count", "spatial_spread",
]

ALLOWED_CONTENT_TYPES = [
    "image/png", "image/jpeg", "image/jpg", "application/pdf", "image/webp", "image/tiff",
]
MAX_FILE_BYTES = 10 * 1024 * 1024

REGULARISATION_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]

AGENT_VERSION = "1.0.0"

# --- decisions ----------------------------------------------------------------------

DEFAULT_ALLOW = {
    "decision": "ALLOW",
    "rule_id": None,
    "rule_name": "Default Allow",
    "severity": "LOW",
    "policy_ref": None,
    "reason": "No governance rules triggered. Risk score and visual signals "
              "are within acceptable thresholds. Document cleared for processing.",
    "sanitization_action": None,
}

FAIL_SAFE_BLOCK = {
    "decision": "BLOCK",
    "rule_id": "G_FAILSAFE",
    "rule_name": "Governance Failure Failsafe",
    "severity": "CRITICAL",
    "policy_ref": "NIST AI RMF: GOVERN 1.7",
    "sanitization_action": None,
}

DEFAULT_RULES = [
    {
        "id": "G1",
        "priority": 1,
        "name": "Critical Risk Unconditional Block",
        "condition": {"risk_score": {"gte": 0.80}},
        "action": "BLOCK",
        "severity": "CRITICAL",
        "policy_ref": "OWASP LLM01:2025 — Prompt Injection",
        "reason_template": "BLOCKED by rule G1 (Critical Risk Unconditional Block). Risk score {risk_score:.3f} exceeds critical threshold (≥0.80). Per OWASP LLM01:2025, high-confidence prompt injection attempts must be rejected before reaching the LLM. No further processing permitted.",
        "sanitization_action": None,
    },
    {
        "id": "G2",
        "priority": 2,
        "name": "Hidden Text Detection Block",
        "condition": {"hidden_text_detected": True},
        "action": "BLOCK",
        "severity": "CRITICAL",
        "policy_ref": "OWASP LLM01:2025 — Indirect Prompt Injection; ISO 27001:2022 A.8.22",
        "reason_template": "BLOCKED by rule G2 (Hidden Text Detection). Near-white text detected in document image — a steganographic injection technique invisible to human reviewers. This attack pattern falls under OWASP LLM01:2025 Indirect Prompt Injection. Risk score: {risk_score:.3f}. Vision score: {vision_score:.3f}.",
        "sanitization_action": None,
    },
    {
        "id": "G3",
        "priority": 3,
        "name": "High Keyword Density Block",
        "condition": {"keyword_density": {"gte": 0.40}, "prompt_score": {"gte": 0.85}},
        "action": "BLOCK",
        "severity": "HIGH",
        "policy_ref": "OWASP LLM01:2025 — Direct Prompt Injection",
        "reason_template": "BLOCKED by rule G3 (High Keyword Density). Injection keyword density {keyword_density:.3f} exceeds threshold (≥0.40) combined with high RoBERTa malicious probability {prompt_score:.3f} (≥0.85). Pattern consistent with direct instruction-override attack per OWASP LLM01:2025.",
        "sanitization_action": None,
    },
    {
        "id": "G4",
        "priority": 4,
        "name": "Watermark Attack Block",
        "condition": {"watermark_score": {"gte": 0.50}, "risk_score": {"gte": 0.65}},
        "action": "BLOCK",
        "severity": "HIGH",
        "policy_ref": "OWASP LLM01:2025 — Indirect Prompt Injection",
        "reason_template": "BLOCKED by rule G4 (Watermark Attack Detection). {watermark_score:.1%} of text only visible at high contrast — consistent with low-opacity watermark injection. Risk score: {risk_score:.3f}. This technique evades standard OCR and targets indirect injection per OWASP LLM01:2025.",
        "sanitization_action": None,
    },
    {
        "id": "G5",
        "priority": 5,
        "name": "Sensitive Data Exfiltration Attack Block",
        "condition": {
            "risk_score": {"gte": 0.65},
            "vision_score": {"gte": 0.40},
            "attack_family": {"in": ["data exfiltration", "exfiltration", "pii extraction", "sensitive data"]},
        },
        "action": "BLOCK",
        "severity": "CRITICAL",
        "policy_ref": "OWASP LLM06:2025 — Sensitive Information Disclosure; NIST AI RMF: GOVERN 1.7",
        "reason_template": "BLOCKED by rule G5 (Data Exfiltration Attack). Predicted attack family '{attack_family}' combined with risk score {risk_score:.3f} and vision score {vision_score:.3f} indicates a sensitive information disclosure attempt. Per OWASP LLM06:2025 and NIST AI RMF GOVERN 1.7, exfiltration attempts must be blocked to protect policyholder PII.",
        "sanitization_action": None,
    },
    {
        "id": "G6",
        "priority": 6,
        "name": "Excessive Agency / Claim Manipulation Block",
        "condition": {
            "risk_score": {"gte": 0.70},
            "attack_family": {"in": ["claim manipulation", "fraud", "policy manipulation", "claim fraud"]},
        },
        "action": "BLOCK",
        "severity": "CRITICAL",
        "policy_ref": "OWASP LLM08:2025 — Excessive Agency; IRDAI AML Guidelines",
        "reason_template": "BLOCKED by rule G6 (Claim Manipulation). Predicted attack family '{attack_family}' with risk score {risk_score:.3f} indicates an attempt to manipulate insurance claim outcomes. This falls under OWASP LLM08:2025 (Excessive Agency) and IRDAI anti-fraud guidelines. Financial integrity risk classified as CRITICAL.",
        "sanitization_action": None,
    },
    {
        "id": "G7",
        "priority": 7,
        "name": "High Risk + Footer Injection Sanitize",
        "condition": {"risk_score": {"gte": 0.55}, "footer_density": {"gte": 0.30}},
        "action": "SANITIZE",
        "severity": "HIGH",
        "policy_ref": "OWASP LLM01:2025 — Indirect Prompt Injection",
        "reason_template": "SANITIZE by rule G7 (Footer Injection). {footer_density:.1%} of text boxes located in footer region (≥30%) with risk score {risk_score:.3f}. Footer region will be redacted before LLM processing. Document body retained for claim processing. Per OWASP LLM01:2025 indirect injection mitigation.",
        "sanitization_action": "redact_footer_region",
    },
    {
        "id": "G8",
        "priority": 8,
        "name": "Medium Risk Multimodal Sanitize",
        "condition": {"risk_score": {"gte": 0.50}, "vision_score": {"gte": 0.35}},
        "action": "SANITIZE",
        "severity": "MEDIUM",
        "policy_ref": "OWASP LLM01:2025; NIST AI RMF: MAP 5.1",
        "reason_template": "SANITIZE by rule G8 (Medium Multimodal Risk). Fusion risk score {risk_score:.3f} and vision score {vision_score:.3f} exceed dual thresholds. Detected injection spans will be redacted ([REDACTED]) before LLM processing. Human review recommended. Per NIST AI RMF MAP 5.1.",
        "sanitization_action": "redact_injection_spans",
    },
    {
        "id": "G9",
        "priority": 9,
        "name": "Elevated Prompt Score Sanitize",
        "condition": {"prompt_score": {"gte": 0.55}, "risk_score": {"lt": 0.80}},
        "action": "SANITIZE",
        "severity": "MEDIUM",
        "policy_ref": "OWASP LLM01:2025",
        "reason_template": "SANITIZE by rule G9 (Elevated Prompt Score). RoBERTa malicious probability {prompt_score:.3f} is elevated (≥0.55) but below block threshold. Conservative sanitization applied — injection-like text spans redacted before LLM processing.",
        "sanitization_action": "redact_injection_spans",
    },
    {
        "id": "G10",
        "priority": 10,
        "name": "Critical Severity Metadata Flag",
        "condition": {"severity": {"in": ["critical", "high"]}, "vision_score": {"gte": 0.20}},
        "action": "SANITIZE",
        "severity": "MEDIUM",
        "policy_ref": "NIST AI RMF: GOVERN 6.1",
        "reason_template": "SANITIZE by rule G10 (Critical Severity Metadata). Document severity is '{severity}' with non-trivial visual signals (vision_score={vision_score:.3f}). Precautionary sanitization applied per NIST AI RMF GOVERN 6.1 (high-stakes automated decision review).",
        "sanitization_action": "redact_injection_spans",
    },
]

# --- columns and configurations ---------------------------------------------------

AUDIT_COLUMNS = [
    "audit_log_id", "sample_id", "timestamp", "decision", "risk_score", "risk_level", "prompt_score",
    "vision_score", "confidence", "governance_rule_triggered", "reason", "sanitization_action", "policy_ref",
    "attack_family_predicted", "vision_ms", "prompt_ms", "risk_ms", "governance_ms", "total_ms",
    "vision_error", "prompt_error", "agent_version",
]
LATENCIES = ["vision_ms", "prompt_ms", "risk_ms", "governance_ms", "total_ms"]

VISION_REQUIRED = [
    "sample_id", "ocr_confidence", "tiny_text_count", "footer_text_density",
    "watermark_score", "hidden_text_score", "keyword_density", "vision_score",
]
VISION_DOUBLES = ["ocr_confidence", "footer_text_density", "watermark_score", "hidden_text_score",
                  "keyword_density", "vision_score"]

# Configuration of the ablation: the signal that ranks rows and the least value that flags one (None: the decision does).
ABLATION = {
    "C1: Prompt Agent Only": ("prompt", 0.5),
    "C2: Vision Agent Only": ("vision", 0.35),
    "C3: Prompt + Vision (max)": ("max", 0.5),
    "C4: Risk Model Fusion": ("risk", 0.5),
    "C5: Full Framework": ("risk", None),
}
