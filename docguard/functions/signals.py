"""Small per-row mappings: labels, splits, keys, levels, cross signals."""

from __future__ import annotations

from docguard.fixed_values import LABEL_CODES, RISK_LEVELS, SEVERITY_CODES
from docguard.functions.numbers import nan_to_null, num, quote
from docguard.functions.text import strip


def label_code(label: str, strict: bool) -> str:
    """benign 0, malicious 1.  Strict fails on any other label, lenient calls it 0."""
    if not strict:
        return f"if(coalesce({label} = 'malicious', false), 1, 0)"
    unknown = f"raise_error(concat('unknown label: ', coalesce({label}, 'NULL')))"
    cases = " ".join(f"WHEN {quote(name)} THEN {code}" for name, code in LABEL_CODES.items())
    return f"CASE {label} {cases} ELSE int({unknown}) END"


def split_name(split: str) -> str:
    plain = f"lower({strip(split)})"
    return f"if({plain} = 'validation', 'val', {plain})"


def group_key(sample_id: str) -> str:
    """What follows the first underscore; the whole id if there is none."""
    return f"if(instr({sample_id}, '_') > 0, substring({sample_id}, instr({sample_id}, '_') + 1), {sample_id})"


def risk_level(score: str) -> str:
    cases = " ".join(f"WHEN {score} >= {num(low)} AND {score} < {num(high)} THEN {quote(name)}"
                     for name, low, high in RISK_LEVELS)
    return f"CASE {cases} ELSE 'CRITICAL' END"


def is_high_risk(score: str) -> str:
    """NULL and NaN are no high risk and no low one: NULL."""
    return f"({nan_to_null(score)} >= 0.65D)"


def severity_code(severity: str) -> str:
    cases = " ".join(f"WHEN {quote(name)} THEN {code}" for name, code in SEVERITY_CODES.items())
    return f"CASE lower({severity}) {cases} ELSE {SEVERITY_CODES['medium']} END"


def agreement(prompt: str, vision: str) -> str:
    """1 where both signals are up or both are down."""
    return f"int(({prompt} > 0.5D) = ({vision} > 0.1D))"


def confidence(probability: str) -> str:
    return f"greatest({probability}, 1.0D - {probability})"


def is_flagged(decision: str) -> str:
    return f"({decision} IN ('BLOCK', 'SANITIZE'))"


def audit_id(sample_id: str, width: int = 8, at: str | None = None) -> str:
    """Hex digits that depend on the id only, so a retried task writes the same id.

    Eight digits are what other tools expect; they collide from some ten thousand rows on.  More digits and the
    time of the decision make ids unique, also where a document is decided twice.
    """
    named = sample_id if at is None else f"concat_ws('@', {sample_id}, string({at}))"
    return f"upper(substring(sha2({named}, 256), 1, {width}))" if width > 32 or at is not None else \
        f"upper(substring(md5({sample_id}), 1, {width}))"


def file_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def has_path(path: str) -> str:
    return f"({strip(f"coalesce({path}, '')")} <> '')"
