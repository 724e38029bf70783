"""From signals to audited decisions: defaults, fail-safe, responses, intake checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import AGENT_VERSION, ALLOWED_CONTENT_TYPES, AUDIT_COLUMNS, DECISION_BADGES, LATENCIES, MAX_FILE_BYTES
from docguard.functions.numbers import listed, nan_to_null, quote, rounded
from docguard.functions.signals import audit_id, confidence
from docguard.functions.text import is_blank
from docguard.operators.features import replaced
from docguard.operators.rules import evaluate_rules


def iso_utc(at: str) -> str:
    """ISO-8601 text of a timestamp with six decimals and the UTC offset."""
    return f"concat(date_format({at}, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS'), '+00:00')"


def audit_fields(df: DataFrame, at: str = "current_timestamp()", deterministic: bool = True,
                 id_digits: int = 8, id_with_time: bool = False) -> DataFrame:
    """Audit id, sample id (the audit id where missing), UTC timestamp, agent version."""
    sample = "string(sample_id)" if "sample_id" in df.columns else "string(null)"
    random = "upper(substring(uuid(), 1, 8))"
    identity = f"coalesce({audit_id(sample, id_digits, at if id_with_time else None)}, {random})" if deterministic else random
    staged = replaced(df, {"sample_id": sample, "audit_log_id": identity, "timestamp": iso_utc(at),
                           "agent_version": quote(AGENT_VERSION)})
    return replaced(staged, {"sample_id": "coalesce(sample_id, audit_log_id)"})


def decide_batch(df: DataFrame, rules: Sequence[dict] | None = None, at: str = "current_timestamp()",
                 failed: str = "cast(null as string)", deterministic: bool = True,
                 id_digits: int = 8, id_with_time: bool = False) -> DataFrame:
    """Rows of signals to the 22-column audit record; ids as in audit_fields.

    Latencies of single rows do not exist in a batch; they are 0.0 unless df brings them.
    """
    columns = df.columns

    def known(name: str, default: str, kind: str) -> str:
        """The column where present and neither NULL nor NaN, else the default."""
        value = nan_to_null(f"double({name})") if kind == "double" else f"{kind}({name})"
        return f"coalesce({value}, {default})" if name in columns else f"{kind}({default})"

    prompt = known("prompt_score", known("malicious_probability", "0.5D", "double"), "double")
    staged = replaced(audit_fields(df, at, deterministic, id_digits, id_with_time), {
        "prompt_score": prompt,
        "vision_score": known("vision_score", "0.0D", "double"),
        "attack_family_predicted": known("attack_family", "'unknown'", "string"),
        "severity": known("severity", "'medium'", "string"),
        "risk_level": known("risk_level", "'MEDIUM'", "string"),
        "vision_error": known("vision_error", "null", "string"),
        "prompt_error": known("prompt_error", "null", "string"),
        **{name: known(name, "0.0D", "double") for name in LATENCIES},
    })
    staged = replaced(staged, {
        "risk_score": known("risk_score", "greatest(prompt_score, vision_score)", "double"),
        "confidence": known("confidence", confidence("prompt_score"), "double"),
    })
    decided = evaluate_rules(staged, rules, failed=failed)
    return decided.withColumnRenamed("rule_id", "governance_rule_triggered").select(*AUDIT_COLUMNS)


def fail_safe(df: DataFrame) -> DataFrame:
    """Raise suspicion where an input failed, instead of failing.

    Reads vision_error, prompt_error and risk_error; a failed vision or text score is 0.5, a
    missing risk is the larger of the two, HIGH from 0.65 on and MEDIUM below.
    """
    staged = replaced(df, {
        "vision_score": "if(vision_error IS NOT NULL, 0.5D, vision_score)",
        "prompt_score": "if(prompt_error IS NOT NULL, 0.5D, prompt_score)",
    })
    unknown, larger = "(risk_error IS NOT NULL OR risk_score IS NULL)", "greatest(prompt_score, vision_score)"
    return replaced(staged, {
        "risk_level": f"if({unknown}, if({larger} >= 0.65D, 'HIGH', 'MEDIUM'), risk_level)",
        "risk_score": f"if({unknown}, {larger}, risk_score)",
    })


def decision_response(df: DataFrame) -> DataFrame:
    """The slim projection of an audit record."""
    return df.selectExpr(
        "audit_log_id", "decision",
        *[f"{rounded(c, 4)} AS {c}" for c in ("risk_score", "confidence", "prompt_score", "vision_score")],
        "governance_rule_triggered", "reason", "sanitization_action", "policy_ref",
        f"{rounded('total_ms', 2)} AS processing_time_ms",
        "decision = 'BLOCK' AS is_blocked", "decision = 'SANITIZE' AS is_sanitized")


def demo_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Short display rows: badge, 80 characters of text, 120 characters of reason."""
    cases = " ".join(f"WHEN {quote(decision)} THEN {quote(sign)}" for decision, sign in DECISION_BADGES.items())
    return df.selectExpr(
        "sample_id", f"concat(substring({text}, 1, 80), '...') AS text_preview",
        f"concat_ws(' ', CASE decision {cases} ELSE '❓' END, decision) AS decision",
        "concat(substring(reason, 1, 120), '...') AS reason_short")


def reject_code(text: str = "text", content_type: str = "content_type", n_bytes: str = "n_bytes") -> str:
    """HTTP-like code of the first intake check that fails, NULL if none does."""
    return (f"CASE WHEN {content_type} IS NULL THEN if({is_blank(text)}, 422, null)"
            f" WHEN {content_type} NOT IN ({listed(ALLOWED_CONTENT_TYPES)}) THEN 415"
            f" WHEN {n_bytes} > {MAX_FILE_BYTES} THEN 413 WHEN coalesce({n_bytes}, 0) = 0 THEN 422 END")


def validate_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_code) from text, content_type and n_bytes."""
    checked = df.withColumn("reject_code", F.expr(reject_code()))
    return checked.filter("reject_code IS NULL").drop("reject_code"), checked.filter("reject_code IS NOT NULL")


def recent_decisions(audit: DataFrame, n: int = 5) -> DataFrame:
    """The newest audit rows."""
    return audit.orderBy(F.desc("timestamp"), "audit_log_id").limit(n).select(
        "timestamp", "sample_id", "decision", "risk_score", "prompt_score", "vision_score",
        "governance_rule_triggered", "reason")


def audit_lookup(audit: DataFrame, audit_log_id: str) -> DataFrame:
    return audit.filter(F.col("audit_log_id") == audit_log_id)
