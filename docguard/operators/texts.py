"""Text operators: choice of the text column, heuristic and windowed scoring, redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import HEURISTIC_PHRASES, IMPERATIVE_VERBS, INJECTION_PHRASES
from docguard.functions import text as T
from docguard.functions.layout import boxes_text, drop_footer
from docguard.functions.numbers import nan_to_null, rounded
from docguard.functions.phrases import PhraseIndex
from docguard.functions.signals import confidence, label_code
from docguard.operators.features import replaced
from docguard.operators.linear import LinearTextModel, windowed_probability, with_window_scores
from docguard.session import small_batches

INFERENCE_ORDER = ("ocr_text", "text", "prompt")
TRAINING_ORDER = ("text", "ocr_text", "prompt")



@dataclass(frozen=True)
class TextScorer:
    """A scorer made of SQL expressions.

    prepare is applied to a whole text once, before it is cut into windows; score then runs
    on every window.
    """
    score: Callable[[str], str]
    prepare: Callable[[str], str] = staticmethod(lambda text: text)

    def __call__(self, text: str) -> str:
        return self.score(self.prepare(text))


# A UDF backend maps a column name to a Column.
Scorer = TextScorer | LinearTextModel | Callable[[str], Column]


def pick_text(df: DataFrame, order: Sequence[str] = INFERENCE_ORDER, out: str = "picked_text") -> DataFrame:
    """The first of the columns that exists, with NULL as ''."""
    columns = df.columns
    present = next((c for c in order if c in columns), None)
    if present is None:
        raise ValueError(f"no text column: need one of {', '.join(order)}")
    return df.withColumn(out, F.expr(f"coalesce({present}, '')"))


def token_length(df: DataFrame, text: str = "text") -> DataFrame:
    counted = df.withColumn("word_count", F.expr(T.word_count(text)))
    return counted.withColumn("approx_tokens", F.expr(T.approx_tokens("word_count")))


def prepare_text_label(df: DataFrame, truncate: bool = True,
                       order: Sequence[str] = INFERENCE_ORDER) -> DataFrame:
    """(text, label) pairs for training."""
    picked = pick_text(df, order)
    if truncate:
        picked = truncate_texts(picked, "picked_text")
    return picked.selectExpr("sample_id", "picked_text AS text", f"{label_code('label', True)} AS label")


def truncate_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Long texts cut to head, middle and tail."""
    worded = df.selectExpr("*", f"{T.tokens(text)} AS _words")
    return replaced(worded, {text: T.smart_truncate(text, "_words")}).drop("_words")


def with_keyword_density(df: DataFrame, text: str = "text",
                         phrases: Sequence[str] = tuple(INJECTION_PHRASES)) -> DataFrame:
    return replaced(df, {"keyword_density": T.keyword_density(text, phrases), "total_words": T.word_count(text)})


def heuristic_scores(df: DataFrame, text: str = "text", phrases: Sequence[str] = tuple(HEURISTIC_PHRASES),
                     verbs: Sequence[str] = tuple(IMPERATIVE_VERBS)) -> DataFrame:
    """Model-free prompt score from phrase density and leading imperatives, 4 decimals."""
    lowered = f"lower(coalesce({text}, ''))"
    columns = df.columns
    staged = df.selectExpr("*", f"{T.tokens(lowered)} AS _words", f"{T.substring_hits(text, phrases)} AS _hits")
    staged = staged.selectExpr(*columns, "_hits", "size(_words) AS _n",
                               f"{T.imperative_count('_words', verbs)} AS _imperatives")
    staged = staged.withColumn("_density", F.expr(T.heuristic_density("_hits", "_n")))
    staged = staged.withColumn("_prompt", F.expr(T.heuristic_prompt("_density", "_imperatives")))
    prompt, density = (f"if(_n = 0, 0.0D, {rounded(c, 4)})" for c in ("_prompt", "_density"))
    return replaced(staged, {"prompt_score": prompt, "keyword_density": density, "vision_score": "0.0D",
                             "risk_score": prompt}).drop("_n", "_hits", "_imperatives", "_density", "_prompt")


def phrase_scorer(phrases: Sequence[str]) -> TextScorer:
    """A scorer without a model: the keyword density of a text."""
    return TextScorer(lambda text: T.density_of_lowered(text, phrases), lambda text: f"lower({text})")


def indexed_phrase_scorer(phrases: Sequence[str]) -> TextScorer:
    """The same score as phrase_scorer's, from an index: for thousands of phrases."""
    index = PhraseIndex(phrases)
    return TextScorer(index.density)


def heuristic_scorer(phrases: Sequence[str] = tuple(HEURISTIC_PHRASES),
                     verbs: Sequence[str] = tuple(IMPERATIVE_VERBS)) -> TextScorer:
    """The heuristic prompt score as a scorer of single texts or windows."""
    def score(text: str) -> str:
        density = T.heuristic_density(T.substring_hits(text, phrases), f"size({T.tokens(text)})")
        return T.heuristic_prompt(density, T.imperative_count(T.tokens(text), verbs))

    return TextScorer(score, lambda text: f"lower({text})")


def sliding_window_score(df: DataFrame, scorer: Scorer, id_column: str = "sample_id", text: str = "text",
                         size: int = 510, stride: int = 256, stop_above: float = 0.99) -> DataFrame:
    """Score long texts window by window: the first score above the stop value, else the maximum.

    One row per row of df; rows that share an id stay rows of their own.

    All windows of a text start in one task, so the shuffle carries one partial row per text.  A linear model needs none.
    """
    if isinstance(scorer, LinearTextModel):
        scored = with_window_scores(df.selectExpr(id_column, f"{text} AS _text"), scorer, "_text", size, stride)
        return scored.selectExpr(id_column, f"{windowed_probability(stop_above)} AS malicious_probability", "bigint(size(_scores)) AS n_windows")
    known = f"coalesce({text}, '')"
    plain = isinstance(scorer, TextScorer)
    if not plain:
        small_batches(df.sparkSession)
    prepared = df.selectExpr(id_column, f"{scorer.prepare(known) if plain else known} AS _text", "monotonically_increasing_id() AS _row")
    worded = prepared.selectExpr("*", f"{T.tokens('_text')} AS _words")
    windows = worded.selectExpr(id_column, "_row", f"inline({T.text_windows('_text', '_words', size, stride)}) AS (start, window_text)")
    score = F.expr(scorer.score("window_text")) if plain else scorer("window_text")
    scored = windows.select(id_column, "_row", "start", score.alias("score"))
    early = f"min(if(score > {stop_above}D, named_struct('start', start, 'score', score), null)).score"
    return scored.groupBy("_row", id_column).agg(
        F.expr(f"coalesce({early}, max(score)) AS malicious_probability"), F.expr("count(1) AS n_windows")).drop("_row")


def windowed_score(df: DataFrame, scorer: TextScorer, text: str = "text", out: str = "prompt_score",
                   size: int = 510, stride: int = 256, stop_above: float = 0.99) -> DataFrame:
    """The windowed score inside each row: no explode, no shuffle, fit for streams.

    UDF scorers cannot run inside a row; they go through sliding_window_score.
    """
    columns = df.columns
    prepared = df.selectExpr("*", f"{scorer.prepare(text)} AS _text")
    worded = prepared.selectExpr("*", f"{T.tokens('_text')} AS _words")
    piece = f"array_join(slice(_words, s + 1, {size}), ' ')"
    starts = f"sequence(0, size(_words) - 1, {stride})"
    # a text that fits is scored by generated code, only the pieces of long ones one by one
    cut = worded.selectExpr(*columns, f"if(size(_words) > {size}, transform({starts}, s -> {piece}), null) AS _pieces",
                            f"if(size(_words) > {size}, '', _text) AS _text")
    scored = cut.selectExpr(*columns, f"{scorer.score('_text')} AS _whole",
                            f"transform(_pieces, piece -> {scorer.score('piece')}) AS _scores")
    early = f"try_element_at(filter(_scores, score -> score > {stop_above}D), 1)"
    return replaced(scored, {
        out: f"if(_scores IS NULL, _whole, coalesce({early}, array_max(_scores)))"}).drop("_scores", "_whole")


def score_text(df: DataFrame, scorer: Scorer, id_column: str = "sample_id", text: str = "text") -> DataFrame:
    """Direct scoring of texts that fit, windowed scoring of the others, and the strategy used."""
    scores = sliding_window_score(df, scorer, id_column, text)
    return scores.selectExpr("*", "if(n_windows > 1, 'sliding_window', 'direct') AS inference_strategy")


def prediction_record(df: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The full record of one prediction per row; needs malicious_probability.  NaN is NULL, and without a
    probability there is neither a label nor a confidence."""
    known = nan_to_null("double(malicious_probability)")
    return df.selectExpr(
        "sample_id", f"{T.preview(text)} AS text_preview", f"{known} AS malicious_probability",
        f"int({known} >= {threshold}D) AS predicted_label",
        f"if({known} IS NULL, null, {confidence(known)}) AS confidence", "'unknown' AS predicted_attack_family",
        f"{T.inference_strategy(text)} AS inference_strategy")


#: From so many phrases on they are looked up in an index.
INDEXED_PHRASES = 200


def sanitize(df: DataFrame, phrases: Sequence[str] = tuple(INJECTION_PHRASES), text: str = "text",
             boxes: str | None = None, height: str | None = None) -> DataFrame:
    """Add sanitized_text for SANITIZE rows as their sanitization_action says; others keep the text."""
    redacted = PhraseIndex(phrases).redacted(text) if len(phrases) > INDEXED_PHRASES else T.redact_phrases(text, phrases)
    cases = f"WHEN 'redact_injection_spans' THEN {redacted}"
    if boxes is not None:
        cases += f" WHEN 'redact_footer_region' THEN {boxes_text(drop_footer(boxes, height))}"
    return df.selectExpr("*", f"CASE sanitization_action {cases} ELSE {text} END AS sanitized_text")
