"""Evaluation: confusion, metrics, ROC, calibration, ablation, threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import ABLATION, DECISIONS
from docguard.functions.numbers import nan_to_null, num, quote, ratio, share
from docguard.functions.signals import is_flagged
from docguard.operators.ranked import exact_quantiles, running_totals
from docguard.operators.rules import rules_flag
from docguard.operators.splits import aggregates

FNR_LIMIT = 0.05

_PROMPT, _VISION, _RISK = (nan_to_null(f"double({c})") for c in ("malicious_probability", "vision_score", "risk_score"))
# NaN is unknown, and so is the larger of two scores of which one is
SIGNALS = {
    "prompt": _PROMPT,
    "vision": _VISION,
    "max": f"if({_PROMPT} IS NULL OR {_VISION} IS NULL, null, greatest({_PROMPT}, {_VISION}))",
    "risk": _RISK,
}
# configuration -> (signal that ranks it, test that flags a row)
CONFIGURATIONS = {name: (signal, is_flagged("decision") if least is None else f"{SIGNALS[signal]} >= {num(least)}")
                  for name, (signal, least) in ABLATION.items()}


def _counts(truth: str, flagged: str, suffix: str = "") -> list[str]:
    return [f"count_if({truth} = 0 AND NOT {flagged}) AS tn{suffix}", f"count_if({truth} = 0 AND {flagged}) AS fp{suffix}",
            f"count_if({truth} = 1 AND NOT {flagged}) AS fn{suffix}", f"count_if({truth} = 1 AND {flagged}) AS tp{suffix}"]


def _unscored(truth: str, flagged: str, suffix: str = "") -> str:
    return f"count_if({truth} IS NOT NULL AND {flagged} IS NULL) AS n_unscored{suffix}"


def _settled(counted: DataFrame, unscored: str, lost: str = "n_unscored") -> DataFrame:
    """Counts with the number of rows without a prediction; unless these are counted, any such row is an error."""
    if unscored == "count":
        return counted
    if unscored != "error":
        raise ValueError(f"unscored is 'error' or 'count', not {unscored!r}")
    failed = f"raise_error(concat(string({lost}), ' rows have no prediction'))"
    # every column carries the check, so no choice of columns drops it
    return counted.selectExpr(*[f"if({lost} = 0, `{c}`, {failed}) AS `{c}`" for c in counted.columns if c != lost])


def confusion_matrix(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (),
                     unscored: str = "error") -> DataFrame:
    """Counts of both classes.  A row with a truth but no prediction fails the job; with
    unscored="count" such rows are counted as n_unscored instead."""
    flagged = f"({predicted} = 1)"
    return _settled(df.groupBy(*by).agg(*aggregates(*_counts(truth, flagged), _unscored(truth, flagged))), unscored)


def metric_expressions() -> dict[str, str]:
    """The metrics as functions of tn, fp, fn, tp; zero division gives 0."""
    up = ratio("2 * tp", "2 * tp + fp + fn")
    down = ratio("2 * tn", "2 * tn + fp + fn")
    classes = "int(tp + fp + fn > 0) + int(tn + fp + fn > 0)"
    return {
        "accuracy": ratio("tp + tn", "tp + tn + fp + fn"),
        "precision": ratio("tp", "tp + fp"),
        "recall": ratio("tp", "tp + fn"),
        "f1_macro": ratio(f"{up} + {down}", classes),
        "f1_weighted": ratio(f"{up} * (tp + fn) + {down} * (tn + fp)", "tp + tn + fp + fn"),
        "fnr": ratio("fn", "greatest(1, tp + fn)"),
        "fpr": ratio("fp", "greatest(1, tn + fp)"),
    }


def with_metrics(counts: DataFrame, names: Sequence[str] = tuple(metric_expressions())) -> DataFrame:
    return counts.selectExpr("*", *[f"{metric_expressions()[n]} AS {n}" for n in names])


def classification_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(confusion_matrix(df, truth, predicted, by))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    def row(name: str, hit: str, false_alarm: str, miss: str) -> str:
        return ", ".join([quote(name), ratio(hit, f"{hit} + {false_alarm}"), ratio(hit, f"{hit} + {miss}"),
                          ratio(f"2 * {hit}", f"2 * {hit} + {false_alarm} + {miss}"), f"{hit} + {miss}"])

    rows = f"{row('benign', 'tn', 'fn', 'fp')}, {row('malicious', 'tp', 'fp', 'fn')}"
    return confusion_matrix(df, truth, predicted).selectExpr(
        f"stack(2, {rows}) AS (class, precision, recall, f1, support)")


def _score_counts(df: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score, or with NaN, count as neither."""
    known = df.selectExpr(*by, f"{nan_to_null(f'double({score})')} AS score", f"{truth} AS truth")
    return known.groupBy(*by, "score").agg(*aggregates(
        "count_if(truth = 1 AND score IS NOT NULL) AS pos", "count_if(truth = 0 AND score IS NOT NULL) AS neg"))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve; NULL where only one class occurs."""
    ranked = running_totals(_score_counts(df, truth, score, by), "score", ["pos", "neg"], by)
    won = "sum(pos * (neg_before + neg / 2.0D))"
    pairs = "double(max(pos_total)) * max(neg_total)"
    return ranked.groupBy(*by).agg(F.expr(f"try_divide({won}, {pairs}) AS roc_auc"))


def roc_curve(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; the point (0, 0) is implied."""
    ranked = running_totals(_score_counts(df, truth, score, by), "score", ["pos", "neg"], by)
    return ranked.selectExpr(*by, "score AS threshold", f"{ratio('neg_total - neg_before', 'neg_total')} AS fpr",
                             f"{ratio('pos_total - pos_before', 'pos_total')} AS tpr").filter("threshold IS NOT NULL")


def _brier(truth: str, score: str) -> str:
    known = nan_to_null(f"double({score})")
    return f"avg(({known} - {truth}) * ({known} - {truth})) AS brier"


def brier(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), unscored: str = "error") -> DataFrame:
    """Mean squared distance of score and truth; NULL and NaN are no scores (see confusion_matrix)."""
    lost = _unscored(truth, nan_to_null(f"double({score})"))
    return _settled(df.groupBy(*by).agg(*aggregates(_brier(truth, score), lost)), unscored)


def calibration_curve(df: DataFrame, truth: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins on [0, 1]; a score on an inner edge belongs to the lower bin, no score and NaN to none."""
    df = df.withColumn("_known", F.expr(nan_to_null(f"double({score})"))).filter("_known IS NOT NULL")
    score = "_known"
    place = f"greatest(0, least({bins - 1}, int(ceil({score} * {bins})) - 1)) AS bin"
    placed = df.selectExpr(*by, place, f"{score} AS _score", f"{truth} AS _truth")
    return placed.groupBy(*by, "bin").agg(*aggregates(
        "avg(_score) AS mean_score", f"{share('_truth = 1')} AS positive_share", "count(1) AS n"))


def evaluate_risk(df: DataFrame, truth: str = "label", score: str = "risk_score", by: str = "split",
                  unscored: str = "error") -> DataFrame:
    """Metrics at 0.5, AUC and Brier score per split; NULL and NaN are no scores (see confusion_matrix)."""
    flagged = f"({nan_to_null(f'double({score})')} >= 0.5D)"
    counts = df.groupBy(by).agg(*aggregates(*_counts(truth, flagged), _brier(truth, score), _unscored(truth, flagged)))
    return with_metrics(_settled(counts, unscored)).join(roc_auc(df, truth, score, [by]), by)


def ablation(df: DataFrame, truth: str = "label", unscored: str = "error") -> DataFrame:
    """The five configurations, one row each: metrics, AUC and whether FNR is above its limit.

    One pass counts all five confusion matrices; only the AUC needs the scores in order.  A row that a configuration
    cannot judge fails the job, or is counted as that configuration's n_unscored (see confusion_matrix).
    """
    counts = [c for i, (_, test) in enumerate(CONFIGURATIONS.values())
              for c in [*_counts(truth, f"({test})", str(i)), _unscored(truth, f"({test})", str(i))]]
    rows = ", ".join(f"{quote(name)}, {quote(signal)}, tn{i}, fp{i}, fn{i}, tp{i}, n_unscored{i}"
                     for i, (name, (signal, _)) in enumerate(CONFIGURATIONS.items()))
    table = _settled(df.agg(*aggregates(*counts)).selectExpr(
        f"stack({len(CONFIGURATIONS)}, {rows}) AS (config, signal, tn, fp, fn, tp, n_unscored)"), unscored)
    scores = ", ".join(f"{quote(name)}, {score}" for name, score in SIGNALS.items())
    long = df.selectExpr(f"{truth} AS truth", f"stack({len(SIGNALS)}, {scores}) AS (signal, score)")
    joined = with_metrics(table).join(roc_auc(long, "truth", "score", ["signal"]), "signal")
    return joined.withColumn("fnr_above_limit", F.col("fnr") > FNR_LIMIT).drop("signal")


def family_detection(df: DataFrame, truth: str = "label", unscored: str = "error") -> DataFrame:
    """Malicious rows: share flagged per family under each configuration.

    With unscored="count" shares are of the rows that a configuration judges, and n_unscored counts the rows that at
    least one of them cannot.
    """
    tests = [test for _, test in CONFIGURATIONS.values()]
    flags = [f"{share(test)} AS c{i + 1}" for i, test in enumerate(tests)]
    lost = f"count_if({' OR '.join(f'({test}) IS NULL' for test in tests)}) AS n_unscored"
    malicious = df.filter(f"{truth} = 1")
    counted = malicious.groupBy("attack_family").agg(*aggregates(*flags, "count(1) AS n", lost))
    return _settled(counted, unscored).orderBy(F.desc("c5"))


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision").agg(F.expr("count(1) AS n"))


def rule_counts(df: DataFrame, rule: str = "rule_id") -> DataFrame:
    """Counts per rule; rows no rule decided are a group of their own."""
    return df.groupBy(F.col(rule).alias("rule_id")).agg(F.expr("count(1) AS n"))


_PER_DECISION = [f"count_if(decision = '{d}') AS {d.lower()}" for d in DECISIONS]


def family_decisions(df: DataFrame, truth: str = "label") -> DataFrame:
    """Malicious rows: decisions per family and the share not let through."""
    counts = df.filter(f"{truth} = 1").groupBy("attack_family").agg(*aggregates(*_PER_DECISION, "count(1) AS total"))
    rate = ratio("block + sanitize", "total")
    return counts.selectExpr("*", f"{rate} AS detection_rate").orderBy(F.desc("detection_rate"))


def decision_by_label(df: DataFrame, truth: str = "label") -> DataFrame:
    return df.groupBy(F.col(truth).alias("label")).agg(*aggregates(*_PER_DECISION))


def governance_eval(df: DataFrame, truth: str = "label", unscored: str = "error") -> DataFrame:
    """Decisions as predictions: confusion, FNR and FPR; a row without a decision has no prediction."""
    flagged = is_flagged("decision")
    counted = df.agg(*aggregates(*_counts(truth, flagged), _unscored(truth, flagged)))
    return with_metrics(_settled(counted, unscored), ["fnr", "fpr"])


def latency_stats(df: DataFrame, column: str = "total_ms") -> DataFrame:
    """Mean, maximum, 95th and 99th percentile, exact at any size."""
    tails = exact_quantiles(df, [column], {"p95": 0.95, "p99": 0.99})
    plain = df.agg(*aggregates(f"avg({column}) AS mean", f"max({column}) AS max", f"{quote(column)} AS feature"))
    return plain.join(tails, "feature").select("mean", "max", "p95", "p99")


def sweep_thresholds(low: float = 0.50, high: float = 0.90, steps: int = 41) -> list[float]:
    step = (high - low) / (steps - 1)
    return [low + i * step for i in range(steps - 1)] + [high]


def threshold_sweep(df: DataFrame, rules: Sequence[dict] | None = None, truth: str = "label",
                    thresholds: Sequence[float] | None = None, fallback: float = 0.80) -> DataFrame:
    """Metrics of "risk at or above the threshold, or flagged by the rules" per threshold.

    The rules are evaluated once.  Rows are counted by how many thresholds their risk
    reaches, and everything per threshold is computed from those few counts.
    """
    values = [num(t) for t in sorted(thresholds or sweep_thresholds())]
    grid = f"array({', '.join(values)})"
    risk = nan_to_null("double(risk_score)")
    # a generated chain of comparisons; an unknown risk reaches no threshold
    reached = " + ".join(f"int(_risk >= {t})" for t in values)
    marked = rules_flag(df, rules).selectExpr(f"{risk} AS _risk", "rules_flag", f"{truth} AS truth").selectExpr(
        f"coalesce({reached}, 0) AS reached", "rules_flag", "truth")
    cells = marked.groupBy("reached", "rules_flag", "truth").agg(F.expr("count(1) AS n"))
    spread = cells.selectExpr("truth", "n", "rules_flag", "reached", f"posexplode({grid}) AS (place, threshold)") \
                  .selectExpr("threshold", "truth", "n", "rules_flag OR reached > place AS flag")
    table = with_metrics(spread.groupBy("threshold").agg(*aggregates(*[
        f"coalesce(sum(if(truth = {y} AND {'' if up else 'NOT '}flag, n, null)), 0) AS {name}"
        for name, y, up in [("tn", 0, False), ("fp", 0, True), ("fn", 1, False), ("tp", 1, True)]
    ])), ["f1_macro", "fnr"])
    feasible = f"fnr <= {FNR_LIMIT}D AND f1_macro > 0"
    # the window runs over the few threshold rows; of equal scores the lowest threshold wins
    best = f"max(if({feasible}, named_struct('f1', f1_macro, 'negated', -threshold), null)) OVER (PARTITION BY 1)"
    return table.selectExpr("threshold", "f1_macro", "fnr", f"{best} AS _best") \
                .selectExpr("threshold", "f1_macro", "fnr", f"coalesce(-_best.negated, {num(fallback)}) AS chosen_threshold")


def tuned_threshold(sweep: DataFrame) -> float:
    """The chosen threshold of a sweep (one number)."""
    return sweep.select("chosen_threshold").first()[0]
