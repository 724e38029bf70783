"""Raw documents to audited decisions, as one chain of projections.

There is no shuffle in this plan: boxes, layers and windows are arrays of the document's
own row.  The same function therefore serves batches and streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from docguard.fixed_values import HEURISTIC_PHRASES, INJECTION_PHRASES
from docguard.functions.layout import boxes_text, hidden_text_detected
from docguard.functions.registry import WindowScorer
from docguard.functions.signals import confidence, has_path, risk_level, severity_code
from docguard.functions.text import text_windows, tokens
from docguard.operators.decisions import decide_batch, fail_safe
from docguard.operators.features import engineer_features, replaced
from docguard.operators.layouts import vision_features
from docguard.operators.linear import LinearTextModel, compiled, windowed_probability, with_window_scores
from docguard.operators.model import RiskModel, risk_probability
from docguard.operators.rules import evaluate_rules
from docguard.operators.texts import TextScorer, heuristic_scores, windowed_score
from docguard.session import small_batches

# What a document without an image has instead of vision signals.
NO_IMAGE = {
    "ocr_confidence": "0.0D", "tiny_text_count": "0", "footer_text_density": "0.0D", "watermark_score": "0.0D",
    "hidden_text_score": "0.0D", "keyword_density": "0.0D", "total_boxes": "0", "total_words": "0",
    "vision_score": "0.0D", "error": "null",
}


AnyScorer = TextScorer | WindowScorer | LinearTextModel | PipelineModel


def decide_documents(docs: DataFrame, scorer: AnyScorer, rules: Sequence[dict] | None = None,
                     model: RiskModel | None = None, phrases: Sequence[str] = tuple(INJECTION_PHRASES),
                     at: str = "current_timestamp()", keep_family: bool = True,
                     id_digits: int = 8, id_with_time: bool = False) -> DataFrame:
    """docs: sample_id, text, image_path, severity, and the box and layer columns of vision_features.

    A document without an image has no vision signal.  Without text the text of its boxes is
    scored, and without any text the score is 0.5.  Without a model the risk is the larger
    of both scores.  A backend that fails on a text leaves its error in prompt_error, and 0.5 as the score.
    attack_family is carried where docs have it, so that the rules on families fire; keep_family=False leaves it out.
    id_digits and id_with_time widen the audit ids (see audit_fields).
    """
    family = ["attack_family"] if keep_family and "attack_family" in docs.columns else []
    seen = vision_features(docs, phrases, keep=["text", "severity", "boxes", *family])
    seen = replaced(seen, {name: f"if({has_path('image_path')}, {name}, {value})" for name, value in NO_IMAGE.items()})
    read = f"{has_path('image_path')} AND ocr_confidence > 0"
    seen = replaced(seen, {"text": f"coalesce(text, if({read}, {boxes_text('boxes')}, null), '')"}).drop("boxes")
    seen = prompt_scores(seen, scorer)
    scored = replaced(seen, {
        "prompt_score": "if(text = '', 0.5D, prompt_score)",
        "prompt_error": "if(text = '', null, prompt_error)",
        "vision_error": "error",
        "hidden_text_detected": hidden_text_detected("hidden_text_score"),
    }).drop("error", "text")
    return decide_batch(fail_safe(_with_risk(scored, model)), rules, at, id_digits=id_digits, id_with_time=id_with_time)


def prompt_scores(df: DataFrame, scorer: AnyScorer) -> DataFrame:
    """Add prompt_score and prompt_error, inside each row, by expressions, a registered backend or a fitted text model.

    Long texts are scored window by window, whatever the scorer."""
    if isinstance(scorer, TextScorer):
        return replaced(windowed_score(df, scorer), {"prompt_error": "cast(null as string)"})
    if isinstance(scorer, PipelineModel):
        scorer = compiled(scorer)
    if isinstance(scorer, LinearTextModel):
        return replaced(with_window_scores(df, scorer), {
            "prompt_score": windowed_probability(), "prompt_error": "cast(null as string)"}).drop("_scores")
    small_batches(df.sparkSession)
    windows = f"transform({text_windows('text', '_words', 510, 256)}, w -> w.text)"
    cut = df.selectExpr("*", f"{tokens('text')} AS _words").selectExpr("*", f"{windows} AS _windows")
    scored = cut.withColumn("_scored", scorer.score("_windows"))
    return replaced(scored, {"prompt_score": "_scored.score", "prompt_error": "_scored.error"}).drop("_words", "_windows", "_scored")


def analyze_texts(docs: DataFrame, phrases: Sequence[str] = tuple(HEURISTIC_PHRASES),
                  rules: Sequence[dict] | None = None) -> DataFrame:
    """Texts to decisions without any model: heuristic scores, then the rules."""
    scored = heuristic_scores(docs, phrases=phrases)
    return evaluate_rules(replaced(scored, {"confidence": confidence("prompt_score")}), rules)


def _with_risk(scored: DataFrame, model: RiskModel | None) -> DataFrame:
    if model is None:
        return replaced(scored, {"risk_score": "double(null)", "risk_level": "string(null)",
                                 "risk_error": "'no risk model'"})
    features = engineer_features(replaced(scored, {
        "malicious_probability": "prompt_score",
        "ocr_confidence": f"if({has_path('image_path')}, ocr_confidence, 0.5D)",
        "severity_enc": severity_code("severity"),
    }))
    risk = replaced(features, {"risk_score": risk_probability(model), "risk_error": "cast(null as string)"})
    return replaced(risk, {"risk_level": risk_level("risk_score")})
