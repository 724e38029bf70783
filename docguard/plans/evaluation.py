"""Fit, score, tune, decide and evaluate a feature matrix; each stage is a written table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docguard.fixed_values import NINE_FEATURES
from docguard.operators.decisions import decide_batch
from docguard.operators.features import join_risk
from docguard.operators.metrics import ablation, threshold_sweep, tuned_threshold
from docguard.operators.model import RiskModel, fit_risk, score_risk
from docguard.operators.rules import evaluate_rules, load_rules, with_threshold
from docguard.session import written
from docguard.sources.tables import append_audit


def tune_rules(validation: DataFrame, rules: Sequence[dict], truth: str = "label") -> list[dict]:
    """The rules with the bound of the unconditional block set on the validation rows."""
    return with_threshold(rules, "G1", "risk_score", tuned_threshold(threshold_sweep(validation, rules, truth)))


def evaluate_matrix(features: DataFrame, columns: Sequence[str] = tuple(NINE_FEATURES), label: str = "label",
                    rules: Sequence[dict] | None = None, audit_path: str | None = None,
                    at: str = "current_timestamp()", model: RiskModel | None = None) -> tuple[RiskModel, DataFrame, DataFrame]:
    """Returns the model, the decisions on the test rows and the ablation table; a given model is not fitted again."""
    rules = load_rules() if rules is None else rules
    if model is None:
        model, _ = fit_risk(features.filter("split = 'train'"), columns, label)
    risk = written(score_risk(features, model).select("sample_id", "risk_score", "risk_level"), "risk_scores")
    joined = written(join_risk(features, risk), "scored_features")
    tuned = tune_rules(joined.filter("split = 'val'"), rules, label)
    test = joined.filter("split = 'test'")
    decided = written(evaluate_rules(test, tuned), "decisions")
    if audit_path is not None:
        append_audit(decide_batch(test, tuned, at), audit_path, fresh=True)
    return model, decided, ablation(decided, label)
