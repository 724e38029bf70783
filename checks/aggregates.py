"""Aggregations, metrics and rule decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    TEST_PHRASES, boxes, documents, labelled, pages, signals, sql_density, sql_tokens, table, u, with_,
)
from checks.registry import check
from docguard.functions import text as T
from docguard.functions.layout import boxes_text
from docguard.operators import decisions as D
from docguard.operators import layouts as LO
from docguard.operators import metrics as M
from docguard.operators import profile as P
from docguard.operators import texts as X
from docguard.operators.rules import evaluate_rules, load_rules, rule_context, with_threshold

COLUMNS = ["risk_score", "vision_score", "hidden_text_score", "keyword_density", "footer_text_density",
           "watermark_score", "malicious_probability"]


def decided(spark, d):
    return evaluate_rules(signals(spark, d))


# --- profiles ----------------------------------------------------------------------------

_STATS = " UNION ALL ".join(f"""SELECT '{c}' AS feature, printf('%.6f', avg({c}))::double AS mean,
    printf('%.6f', stddev_samp({c}))::double AS std, printf('%.6f', min({c}))::double AS min, printf('%.6f', max({c}))::double AS max,
    count(*) FILTER ({c} = 0) AS zeros, printf('%.2f', count(*) FILTER ({c} <> 0)*100.0::double/count(*))::double AS nonzero_pct FROM sig"""
                            for c in COLUMNS)


@check("feature_stats", with_("sig") + _STATS)
def feature_stats(spark, d):
    return P.feature_stats(signals(spark, d), COLUMNS)


_DESCRIBE = " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
    min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max
    FROM sig""" for c in COLUMNS)


@check("describe", with_("sig") + _DESCRIBE, rounded=["mean", "std", "min", "q25", "q50", "q75", "max"], digits=4)
def describe(spark, d):
    return P.describe(signals(spark, d), COLUMNS)


@check("signal_summary", with_("sig", "vision_rows") + """
    SELECT count(*) AS n, count(v.sample_id) AS with_image, count(*) - count(v.sample_id) AS text_only, avg(s.vision_score) AS mean,
        stddev_samp(s.vision_score) AS std, min(s.vision_score) AS min, max(s.vision_score) AS max,
        count(*) FILTER (s.vision_score > 0) AS n_positive, count(*) FILTER (s.hidden_text_score*s.keyword_density > 0) AS n_keywords,
        avg(s.hidden_text_score*s.keyword_density) FILTER (s.hidden_text_score*s.keyword_density > 0) AS mean_keywords,
        quantile_cont(s.vision_score, 0.5) AS median
    FROM sig s LEFT JOIN vision_rows v USING (sample_id)""", rounded=["mean", "std", "min", "max", "mean_keywords", "median"])
def signal_summary(spark, d):
    df = signals(spark, d).selectExpr("vision_score", f"int({u('img')} < 0.25D) AS has_image",
                                      "hidden_text_score * keyword_density AS keyword_density")
    return P.signal_summary(df)


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM sig" for a, b in _PAIRS)


@check("correlation_matrix", with_("sig") + _CORR, rounded=["r"])
def correlation_matrix(spark, d):
    return P.correlation_matrix(signals(spark, d), COLUMNS)


@check("top_families", """SELECT source AS attack_family, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
    GROUP BY source ORDER BY n DESC, source LIMIT 15""")
def top_families(spark, d):
    return P.top_families(documents(spark, d).selectExpr("label", "source AS attack_family"))


@check("class_weights", "SELECT toxic AS label, count(*) AS n, (SELECT count(*) FROM labels)::double/(2*count(*)) AS weight FROM labels GROUP BY toxic",
       rounded=["weight"])
def class_weights(spark, d):
    return P.class_weights(table(spark, d, "labels"), "toxic")


@check("label_balance_ratio", """SELECT min(n)::double/max(n) AS balance_ratio, min(n)::double/max(n) < 0.3 AS imbalanced
    FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)""", rounded=["balance_ratio"])
def label_balance_ratio(spark, d):
    return P.label_balance_ratio(table(spark, d, "labels"), "toxic")


_TOKENS = f"floor(len({sql_tokens('text')})*1.3::double)::int"


@check("over_limit_share", with_("docs") + f"""SELECT label, avg(({_TOKENS} > 512)::int::double) AS over_limit FROM docs GROUP BY label""",
       rounded=["over_limit"])
def over_limit_share(spark, d):
    return P.over_limit_share(X.token_length(documents(spark, d)))


def _histogram_sql(source, column, bins):
    return f"""SELECT least(coalesce(floor((x-low)*{bins}/nullif(high-low, 0)), 0), {bins - 1})::int AS bin, count(*) AS n,
        min(x) AS low, max(x) AS high
        FROM (SELECT {column}::double AS x, (SELECT min({column})::double FROM {source}) AS low, (SELECT max({column})::double FROM {source}) AS high
              FROM {source}) GROUP BY 1"""


@check("histogram", _histogram_sql("events", "value", 30))
def histogram(spark, d):
    return P.histogram(table(spark, d, "events"), "value", 30)


@check("token_histogram", "WITH t AS (SELECT " + _TOKENS + " AS approx_tokens FROM documents) " + _histogram_sql("t", "approx_tokens", 50))
def token_histogram(spark, d):
    return P.histogram(X.token_length(table(spark, d, "documents")).select("approx_tokens"), "approx_tokens", 50)


_FLAGS = "SELECT CASE role WHEN 'user' THEN 'True' WHEN 'assistant' THEN 'false' ELSE '1' END AS flag FROM conversations"


@check("flag_share", f"""WITH r AS ({_FLAGS}), o AS (SELECT avg((lower(flag) IN ('true', '1'))::int::double) AS true_share FROM r)
    SELECT flag AS value, count(*) AS n, any_value(o.true_share) AS true_share, any_value(o.true_share) > 0.5 AS mostly_true
    FROM r, o GROUP BY flag""", rounded=["true_share"])
def flag_share(spark, d):
    raw = "CASE role WHEN 'user' THEN 'True' WHEN 'assistant' THEN 'false' ELSE '1' END AS runtime_ocr"
    return P.flag_share(table(spark, d, "conversations").selectExpr(raw), "runtime_ocr")


@check("feature_matrix_summary", with_("sig") + """SELECT count(*) AS total_samples, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) FILTER (label = 0) AS benign,
    count(*) FILTER (label = 1) AS malicious, count(*) FILTER (footer_text_density > 0.5::double) AS samples_with_images,
    7 AS n_features, printf('%.6f', avg(footer_text_density))::double AS first_mean FROM sig""")
def feature_matrix_summary(spark, d):
    df = signals(spark, d).selectExpr("*", "int(footer_text_density > 0.5D) AS total_boxes")
    one = P.feature_matrix_summary(df, COLUMNS)
    return one.selectExpr("total_samples", "split_counts.*", "label_counts.*", "samples_with_images",
                          "size(feature_columns) AS n_features", "feature_stats[0].mean AS first_mean")


# --- boxes, pages, windows ---------------------------------------------------------------


@check("ocr_aggregate", with_("per_page") + "SELECT sample_id, md5(normal) AS digest, conf AS ocr_confidence, n AS total_boxes FROM per_page",
       rounded=["ocr_confidence"])
def ocr_aggregate(spark, d):
    return LO.ocr_aggregate(boxes(spark, d)).selectExpr("sample_id", "md5(text) AS digest", "ocr_confidence", "total_boxes")


@check("tiny_text_count", with_("per_page") + "SELECT sample_id, tiny AS tiny_text_count FROM per_page")
def tiny_text_count(spark, d):
    return LO.layout_features(boxes(spark, d)).select("sample_id", "tiny_text_count")


@check("footer_density", with_("per_page") + "SELECT sample_id, footer AS footer_text_density, n AS total_boxes FROM per_page",
       rounded=["footer_text_density"])
def footer_density(spark, d):
    return LO.layout_features(boxes(spark, d)).select("sample_id", "footer_text_density", "total_boxes")


@check("nested_boxes", with_("per_page") + "SELECT sample_id, n::int AS n_boxes, md5(normal) AS digest FROM per_page")
def nested_boxes_query(spark, d):
    nested = LO.nest_boxes(boxes(spark, d))
    return nested.selectExpr("sample_id", "size(boxes) AS n_boxes", f"md5({boxes_text('boxes')}) AS digest")


@check("vision_features", with_("vision_out") + f"SELECT {', '.join(LO.VISION_COLUMNS)} FROM vision_out",
       rounded=["ocr_confidence", "footer_text_density", "watermark_score", "vision_score"])
def vision_features(spark, d):
    return LO.vision_features(pages(spark, d), TEST_PHRASES)


@check("extraction_report", with_("docs") + f"""SELECT count(*) AS total, count(*) FILTER (NOT failed) AS successful, count(*) FILTER (failed) AS errors
    FROM (SELECT image_path IS NOT NULL AND ('0x'||substr(md5(doc_id||':err'),1,8))::bigint/4294967296.0::double < 0.1::double AS failed FROM docs)""")
def extraction_report(spark, d):
    return LO.extraction_report(LO.vision_features(pages(spark, d), TEST_PHRASES))


@check("extraction_errors", with_("docs") + """SELECT sample_id, 'cannot read image' AS error FROM docs
    WHERE image_path IS NOT NULL AND ('0x'||substr(md5(doc_id||':err'),1,8))::bigint/4294967296.0::double < 0.1::double""")
def extraction_errors(spark, d):
    return LO.extraction_errors(LO.vision_features(pages(spark, d), TEST_PHRASES))


@check("ocr_run_summary", with_("docs", c="""SELECT CASE WHEN n_chars < 300 THEN '' ELSE text END AS t, n_chars,
        CASE WHEN n_chars < 300 THEN 0.0 ELSE ('0x'||substr(md5(doc_id||':s11'),1,8))::bigint/4294967296.0::double END AS conf,
        image_path = '' AS failed FROM docs""") + """
    SELECT count(*) AS n, count(*) FILTER (t <> '') AS non_empty, count(*) FILTER (failed) AS errors,
        avg(n_chars) FILTER (t <> '') AS mean_chars, avg(conf) FILTER (conf > 0) AS mean_confidence,
        count(*) FILTER (t <> '')*100.0::double/count(*) AS non_empty_pct, count(*) FILTER (t <> '') >= floor(count(*)*0.99::double) AS passed
    FROM c""", rounded=["mean_chars", "mean_confidence", "non_empty_pct"])
def ocr_run_summary(spark, d):
    return P.ocr_run_summary(documents(spark, d).selectExpr(
        "if(n_chars < 300, '', text) AS ocr_text_cached", "n_chars AS char_count",
        f"if(n_chars < 300, 0.0D, {u('s11')}) AS ocr_confidence", "if(image_path = '', 'no file', null) AS error"))


def windowed_sql(score: str) -> str:
    """Windowed score per document, from the score of a chunk in SQL."""
    return f"""SELECT doc_id::varchar AS sample_id, coalesce(arg_min(score, start) FILTER (score > 0.99), max(score)) AS malicious_probability,
    count(*) AS n_windows FROM (SELECT doc_id, start, {score} AS score FROM (
    SELECT doc_id, start, CASE WHEN n <= 510 THEN text ELSE array_to_string(w[start+1:start+510], ' ') END AS chunk
    FROM (SELECT doc_id, text, w, n, unnest(CASE WHEN n <= 510 THEN [0] ELSE range(0, n, 256) END) AS start
          FROM (SELECT doc_id, text, w, len(w) AS n FROM (SELECT doc_id, text, {sql_tokens('text')} AS w FROM documents))))) GROUP BY doc_id"""


WINDOWED = windowed_sql(sql_density("chunk"))


@check("sliding_window_score", WINDOWED)
def sliding_window_score(spark, d):
    return X.sliding_window_score(documents(spark, d), X.phrase_scorer(TEST_PHRASES))


@check("score_text", f"SELECT *, CASE WHEN n_windows > 1 THEN 'sliding_window' ELSE 'direct' END AS inference_strategy FROM ({WINDOWED})")
def score_text(spark, d):
    return X.score_text(documents(spark, d), X.phrase_scorer(TEST_PHRASES))


_MARK = r"(^|[^\p{L}\p{N}_])(" + "|".join(sorted(TEST_PHRASES, key=len, reverse=True)) + r")([^\p{L}\p{N}_]|$)"


def _redacted(text: str) -> str:
    return f"regexp_replace({text}, '{_MARK}', '\\1[REDACTED]\\3', 'gi')"


_TWICE = _redacted(_redacted("d.text"))  # neighbours share a separator


@check("sanitize_text", with_("decided", "boxes", kept="""SELECT sample_id, string_agg(text, ' ' ORDER BY pos) AS body FROM boxes
        WHERE (y0+y1)/2 < height*0.85::double GROUP BY sample_id""") + f"""
    SELECT c.sample_id, c.sanitization_action, md5(CASE c.sanitization_action WHEN 'redact_injection_spans' THEN {_TWICE}
        WHEN 'redact_footer_region' THEN coalesce(k.body, '') ELSE d.text END) AS digest
    FROM decided c JOIN documents d USING (doc_id) LEFT JOIN kept k ON k.sample_id = c.sample_id""")
def sanitize_text(spark, d):
    texts = pages(spark, d).select("doc_id", "text", "boxes", "height")
    rows = decided(spark, d).join(texts, "doc_id")
    return X.sanitize(rows, TEST_PHRASES, boxes="boxes", height="height").select(
        "sample_id", "sanitization_action", F.expr("md5(sanitized_text) AS digest"))


# --- rules and decisions -----------------------------------------------------------------


@check("normalise_context", with_("ctx") + """SELECT sample_id, risk_score, vision_score, hidden_text_detected, keyword_density, footer_density,
    watermark_score, prompt_score, attack_family, severity FROM ctx""")
def normalise_context(spark, d):
    padded = signals(spark, d).selectExpr("* EXCEPT (severity)", "concat('  ', upper(severity), ' ') AS severity")
    return rule_context(padded).selectExpr("sample_id", *[f"ctx_{c} AS {c}" for c in (
        "risk_score", "vision_score", "hidden_text_detected", "keyword_density", "footer_density", "watermark_score",
        "prompt_score", "attack_family", "severity")])


@check("evaluate_rules", with_("decided") + """SELECT sample_id, decision, rule_id, rule_name, rule_severity, policy_ref, reason,
    sanitization_action FROM decided""")
def evaluate_rules_query(spark, d):
    return decided(spark, d).select("sample_id", "decision", "rule_id", "rule_name", "rule_severity", "policy_ref", "reason",
                                    "sanitization_action")


@check("render_reason", with_("decided") + "SELECT rule_id, reason, count(*) AS n FROM decided GROUP BY ALL")
def render_reason(spark, d):
    return decided(spark, d).groupBy("rule_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@check("compile_condition", with_("ctx") + """SELECT sample_id, risk_score >= 0.5 AND risk_score < 0.6::double AS strict, risk_score >= 0.5 AS compat,
    hidden_text_detected = false AS not_hidden, severity IN ('low', 'high') AS listed, false AS absent FROM ctx""")
def compile_condition(spark, d):
    from docguard.operators.rules import compile_condition as compiled
    span = {"risk_score": {"gte": 0.5, "lt": 0.6}}
    return rule_context(signals(spark, d)).selectExpr(
        "sample_id", f"{compiled(span)} AS strict", f"{compiled(span, compat=True)} AS compat",
        f"{compiled({'hidden_text_detected': False})} AS not_hidden",
        f"{compiled({'severity': {'in': ['low', 'high']}})} AS listed", f"{compiled({'no_such_field': True})} AS absent")


@check("override_threshold", with_("ctx") + """SELECT sample_id, CASE WHEN risk_score >= 0.62::double THEN 'G1'
    WHEN hidden_text_detected THEN 'G2' ELSE 'other' END AS first FROM ctx""")
def override_threshold(spark, d):
    changed = evaluate_rules(signals(spark, d), with_threshold(load_rules(), "G1", "risk_score", 0.62))
    return changed.selectExpr("sample_id", "if(rule_id IN ('G1', 'G2'), rule_id, 'other') AS first")


@check("decide_batch", with_("decided") + """SELECT sample_id, upper(substr(md5(sample_id),1,8)) AS audit_log_id,
    '2026-01-01T00:00:00.000000+00:00' AS timestamp, decision, risk_score, 'MEDIUM' AS risk_level, prompt_score, vision_score,
    greatest(prompt_score, 1-prompt_score) AS confidence, rule_id AS governance_rule_triggered, reason, sanitization_action, policy_ref,
    raw_family AS attack_family_predicted, 0.0::double AS vision_ms, 0.0::double AS prompt_ms, 0.0::double AS risk_ms, 0.0::double AS governance_ms,
    0.0::double AS total_ms, NULL::varchar AS vision_error, NULL::varchar AS prompt_error, '1.0.0' AS agent_version FROM decided""")
def decide_batch(spark, d):
    return D.decide_batch(signals(spark, d), at="timestamp_ntz'2026-01-01 00:00:00'")


@check("fail_safe", with_("sig") + """SELECT sample_id, CASE WHEN severity = 'low' THEN 0.5 ELSE vision_score END AS vision_score,
    CASE WHEN severity = 'medium' THEN 0.5 ELSE malicious_probability END AS prompt_score,
    CASE WHEN severity = 'high' THEN greatest(vision_score, malicious_probability) ELSE risk_score END AS risk_score,
    CASE WHEN severity = 'high' THEN CASE WHEN greatest(vision_score, malicious_probability) >= 0.65::double THEN 'HIGH' ELSE 'MEDIUM' END
         ELSE 'LOW' END AS risk_level FROM sig""")
def fail_safe(spark, d):
    return D.fail_safe(signals(spark, d).selectExpr(
        "sample_id", "vision_score", "malicious_probability AS prompt_score", "risk_score", "'LOW' AS risk_level",
        "if(severity = 'low', 'x', null) AS vision_error", "if(severity = 'medium', 'x', null) AS prompt_error",
        "if(severity = 'high', 'x', null) AS risk_error",
    )).select("sample_id", "vision_score", "prompt_score", "risk_score", "risk_level")


@check("rule_failure", with_("decided") + """SELECT sample_id, CASE WHEN severity = 'low' THEN 'BLOCK' ELSE decision END AS decision,
    CASE WHEN severity = 'low' THEN 'G_FAILSAFE' ELSE rule_id END AS rule_id,
    CASE WHEN severity = 'low' THEN 'Governance agent failed (broken). Blocking as failsafe.' ELSE reason END AS reason FROM decided""")
def rule_failure(spark, d):
    return evaluate_rules(signals(spark, d), failed="if(severity = 'low', 'broken', null)").select("sample_id", "decision", "rule_id", "reason")


@check("decision_counts", with_("decided") + "SELECT decision, count(*) AS n FROM decided GROUP BY 1")
def decision_counts(spark, d):
    return M.decision_counts(decided(spark, d))


@check("rule_counts", with_("decided") + "SELECT rule_id, count(*) AS n FROM decided GROUP BY 1")
def rule_counts(spark, d):
    return M.rule_counts(decided(spark, d))


_PER = ", ".join(f"count(*) FILTER (decision = '{x}') AS {x.lower()}" for x in ("ALLOW", "SANITIZE", "BLOCK"))


@check("family_decisions", with_("decided") + f"""SELECT raw_family AS attack_family, {_PER}, count(*) AS total,
    count(*) FILTER (decision <> 'ALLOW')::double/count(*) AS detection_rate FROM decided WHERE label = 1 GROUP BY 1""", rounded=["detection_rate"])
def family_decisions(spark, d):
    return M.family_decisions(decided(spark, d))


@check("decision_by_label", with_("decided") + f"SELECT label, {_PER} FROM decided GROUP BY 1")
def decision_by_label(spark, d):
    return M.decision_by_label(decided(spark, d))


# --- metrics -----------------------------------------------------------------------------


def confusion_sql(p: str, source: str, y: str = "label") -> str:
    return f"""SELECT count(*) FILTER ({y} = 0 AND NOT ({p})) AS tn, count(*) FILTER ({y} = 0 AND ({p})) AS fp,
        count(*) FILTER ({y} = 1 AND NOT ({p})) AS fn, count(*) FILTER ({y} = 1 AND ({p})) AS tp FROM {source}"""


METRICS_SQL = """(tp+tn)::double/(tp+tn+fp+fn) AS accuracy, coalesce(tp::double/nullif(tp+fp, 0), 0.0) AS "precision",
    coalesce(tp::double/nullif(tp+fn, 0), 0.0) AS recall,
    (coalesce(2.0::double*tp/nullif(2*tp+fp+fn, 0), 0.0)+coalesce(2.0::double*tn/nullif(2*tn+fp+fn, 0), 0.0))/2 AS f1_macro,
    (coalesce(2.0::double*tp/nullif(2*tp+fp+fn, 0), 0.0)*(tp+fn)+coalesce(2.0::double*tn/nullif(2*tn+fp+fn, 0), 0.0)*(tn+fp))/(tp+tn+fp+fn) AS f1_weighted,
    fn::double/greatest(1, tp+fn) AS fnr, fp::double/greatest(1, tn+fp) AS fpr"""
METRICS = ["accuracy", "precision", "recall", "f1_macro", "f1_weighted", "fnr", "fpr"]


def auc_sql(score: str, source: str, y: str = "label") -> str:
    """Mann-Whitney statistic from average ranks."""
    return f"""(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1)*(count(*) FILTER (y = 1)+1)/2.0::double)
        /(count(*) FILTER (y = 1)::double*count(*) FILTER (y = 0))
        FROM (SELECT {y} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score})-1)/2.0::double AS r FROM {source}))"""


def _with_prediction(spark, d):
    return signals(spark, d).selectExpr("label", "int(risk_score >= 0.5D) AS predicted")


@check("confusion_matrix", with_("sig") + confusion_sql("risk_score >= 0.5", "sig"))
def confusion_matrix(spark, d):
    return M.confusion_matrix(_with_prediction(spark, d), "label", "predicted")


_TOXIC = f"SELECT toxic AS label, {sql_density('text')} AS p FROM documents JOIN labels USING (doc_id)"


@check("classification_metrics", f"WITH t AS ({_TOXIC}), c AS ({confusion_sql('p >= 0.5', 't')}) SELECT *, {METRICS_SQL} FROM c", rounded=["accuracy", "precision", "recall", "f1_macro", "f1_weighted", "fnr", "fpr"])
def classification_metrics(spark, d):
    scored = labelled(spark, d).selectExpr("label", f"int({T.keyword_density('text', TEST_PHRASES)} >= 0.5D) AS predicted")
    return M.classification_metrics(scored, "label", "predicted")


@check("classification_report", with_("sig", c=confusion_sql("risk_score >= 0.5", "sig")) + """
    SELECT 'benign' AS class, tn::double/(tn+fn) AS prec, tn::double/(tn+fp) AS recall, 2.0::double*tn/(2*tn+fp+fn) AS f1, tn+fp AS support FROM c
    UNION ALL SELECT 'malicious', tp::double/(tp+fp), tp::double/(tp+fn), 2.0::double*tp/(2*tp+fp+fn), tp+fn FROM c""", rounded=["prec", "recall", "f1"])
def classification_report(spark, d):
    return M.classification_report(_with_prediction(spark, d), "label", "predicted").withColumnRenamed("precision", "prec")


@check("roc_auc", with_("sig") + "SELECT 'risk_score' AS signal, " + auc_sql("risk_score", "sig") + " AS roc_auc UNION ALL SELECT 'toxic_density', "
       + auc_sql("p", f"({_TOXIC})"), rounded=["roc_auc"])
def roc_auc(spark, d):
    toxic = labelled(spark, d).selectExpr("label", f"{T.keyword_density('text', TEST_PHRASES)} AS p")
    return M.roc_auc(signals(spark, d), "label", "risk_score").selectExpr("'risk_score' AS signal", "roc_auc") \
        .unionByName(M.roc_auc(toxic, "label", "p").selectExpr("'toxic_density' AS signal", "roc_auc"))


@check("roc_curve", with_("sig") + """SELECT risk_score AS threshold,
    (count(*) FILTER (label = 0) OVER w)::double/(count(*) FILTER (label = 0) OVER ()) AS fpr,
    (count(*) FILTER (label = 1) OVER w)::double/(count(*) FILTER (label = 1) OVER ()) AS tpr
    FROM sig WINDOW w AS (ORDER BY risk_score DESC)""", rounded=["fpr", "tpr"])
def roc_curve(spark, d):
    return M.roc_curve(signals(spark, d), "label", "risk_score")


@check("brier", with_("sig") + "SELECT avg(power(risk_score-label, 2)) AS brier FROM sig", rounded=["brier"])
def brier(spark, d):
    return M.brier(signals(spark, d), "label", "risk_score")


@check("calibration_curve", with_("sig") + """SELECT greatest(0, least(9, ceil(risk_score*10)::int-1)) AS bin, avg(risk_score) AS mean_score,
    avg(label::double) AS positive_share, count(*) AS n FROM sig GROUP BY 1""", rounded=["mean_score", "positive_share"])
def calibration_curve(spark, d):
    return M.calibration_curve(signals(spark, d), "label", "risk_score")


@check("evaluate_risk", with_("sig") + " UNION ALL ".join(
    f"""SELECT '{s}' AS split, c.*, {METRICS_SQL}, {auc_sql('risk_score', f"(SELECT * FROM sig WHERE split = '{s}')")} AS roc_auc,
    (SELECT avg(power(risk_score-label, 2)) FROM sig WHERE split = '{s}') AS brier
    FROM ({confusion_sql('risk_score >= 0.5', f"sig WHERE split = '{s}'")}) c""" for s in ("train", "val", "test")),
       rounded=["accuracy", "precision", "recall", "f1_macro", "f1_weighted", "fnr", "fpr", "roc_auc", "brier"])
def evaluate_risk(spark, d):
    return M.evaluate_risk(signals(spark, d))


_CONFIGS = [("C1: Prompt Agent Only", "prompt_score >= 0.5", "prompt_score"), ("C2: Vision Agent Only", "vision_score >= 0.35::double", "vision_score"),
            ("C3: Prompt + Vision (max)", "greatest(prompt_score, vision_score) >= 0.5", "greatest(prompt_score, vision_score)"),
            ("C4: Risk Model Fusion", "risk_score >= 0.5", "risk_score"), ("C5: Full Framework", "decision IN ('BLOCK', 'SANITIZE')", "risk_score")]


@check("ablation", with_("decided") + " UNION ALL ".join(
    f"""SELECT '{name}' AS config, c.*, {METRICS_SQL}, {auc_sql(score, 'decided')} AS roc_auc, fn::double/greatest(1, tp+fn) > 0.05 AS fnr_above_limit
    FROM ({confusion_sql(test, 'decided')}) c""" for name, test, score in _CONFIGS),
       rounded=["accuracy", "precision", "recall", "f1_macro", "f1_weighted", "fnr", "fpr", "roc_auc"])
def ablation(spark, d):
    return M.ablation(decided(spark, d))


@check("family_detection", with_("decided") + "SELECT raw_family AS attack_family, " + ", ".join(
    f"avg(({test})::int::double) AS c{i + 1}" for i, (_, test, _) in enumerate(_CONFIGS))
       + ", count(*) AS n FROM decided WHERE label = 1 GROUP BY 1", rounded=["c1", "c2", "c3", "c4", "c5"])
def family_detection(spark, d):
    return M.family_detection(decided(spark, d))


@check("governance_eval", with_("decided") + f"""SELECT *, fn::double/greatest(1, tp+fn) AS fnr, fp::double/greatest(1, tn+fp) AS fpr
    FROM ({confusion_sql("decision IN ('BLOCK', 'SANITIZE')", "decided WHERE split = 'test'")})""", rounded=["fnr", "fpr"])
def governance_eval(spark, d):
    return M.governance_eval(decided(spark, d).filter("split = 'test'"))


_SWEEP = """t AS (SELECT CASE WHEN i = 40 THEN 0.9::double ELSE 0.5::double + i*0.01::double END AS threshold FROM range(41) r(i)),
    m AS (SELECT threshold, count(*) FILTER (label = 0 AND NOT f) AS tn, count(*) FILTER (label = 0 AND f) AS fp,
        count(*) FILTER (label = 1 AND NOT f) AS fn, count(*) FILTER (label = 1 AND f) AS tp
        FROM (SELECT threshold, label, risk_score >= threshold OR decision <> 'ALLOW' AS f FROM scored, t) GROUP BY threshold),
    e AS (SELECT threshold, (coalesce(2.0::double*tp/nullif(2*tp+fp+fn, 0), 0.0)+coalesce(2.0::double*tn/nullif(2*tn+fp+fn, 0), 0.0))/2 AS f1_macro,
        fn::double/greatest(1, tp+fn) AS fnr FROM m)
    SELECT threshold, f1_macro, fnr, coalesce((SELECT threshold FROM e WHERE fnr <= 0.05 AND f1_macro > 0 ORDER BY f1_macro DESC, threshold LIMIT 1),
        0.8::double) AS chosen_threshold FROM e"""


@check("threshold_sweep", with_("decided", scored="SELECT * FROM decided WHERE split = 'val'") + ", " + _SWEEP, rounded=["threshold", "f1_macro", "fnr", "chosen_threshold"])
def threshold_sweep(spark, d):
    return M.threshold_sweep(signals(spark, d).filter("split = 'val'"))


# labels that follow the scores, so that thresholds differ and one is feasible
_LEARNABLE = """SELECT sample_id, (risk_score >= 0.56::double)::int AS label, risk_score, CASE WHEN risk_score >= 0.80::double THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM sig"""


@check("threshold_sweep_feasible", with_("sig", scored=_LEARNABLE) + ", " + _SWEEP, rounded=["threshold", "f1_macro", "fnr", "chosen_threshold"])
def threshold_sweep_feasible(spark, d):
    rows = signals(spark, d).selectExpr("sample_id", "int(risk_score >= 0.56D) AS label", "risk_score")
    return M.threshold_sweep(rows)
