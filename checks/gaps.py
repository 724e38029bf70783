"""Queries over signals with NULL and NaN, repeated ids, marked texts and CSV values of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import (
    _SWEEP, COLUMNS, METRICS, METRICS_SQL, WINDOWED, auc_sql, windowed_sql,
)
from checks.inputs import TEST_PHRASES, decision_sql, documents, pages, signals, sql_density, table, vision_rows, with_
from checks.models import _DOCUMENT_COLUMNS, _DOCUMENT_CTES, _DOCUMENT_SQL, _counter
from checks.registry import check
from checks.scalars import _ENGINEERED, VISION_SCORE_SQL
from docguard.fixed_values import INJECTION_PHRASES
from docguard.functions import layout as L
from docguard.functions import registry
from docguard.functions import signals as S
from docguard.functions import text as T
from docguard.functions.phrases import PhraseIndex
from docguard.operators import decisions as D
from docguard.operators import features as FE
from docguard.operators import metrics as M
from docguard.operators import model as MO
from docguard.operators import profile as P
from docguard.operators import texts as X
from docguard.operators.rules import evaluate_rules, rule_hits
from docguard.plans.documents import decide_documents
from docguard.session import new_path
from docguard.sources import tables

# column -> ids (modulus) whose value is NULL, and ids whose value is NaN; both are NULL in SQL
GAPS = {"risk_score": (7, 11), "vision_score": (5, 13), "hidden_text_score": (23, 17), "keyword_density": (29, 31),
        "malicious_probability": (19, 37)}
_NULLED = ", ".join(f"CASE WHEN doc_id % {a} = 0 OR doc_id % {b} = 0 THEN NULL ELSE {c} END AS {c}" for c, (a, b) in GAPS.items())
_GAPS = {"gaps": f"SELECT * REPLACE ({_NULLED}) FROM sig"}


def with_gaps(spark, d):
    return FE.replaced(signals(spark, d), {
        c: f"CASE WHEN doc_id % {a} = 0 THEN NULL WHEN doc_id % {b} = 0 THEN double('NaN') ELSE {c} END" for c, (a, b) in GAPS.items()})


@check("gaps_vision_score", with_("vision_rows") + f"""SELECT sample_id, CASE WHEN sample_id::bigint % 3 = 0 OR sample_id::bigint % 5 = 0 THEN NULL
    ELSE {VISION_SCORE_SQL} END AS score, CASE WHEN sample_id::bigint % 3 = 0 OR sample_id::bigint % 5 = 0 THEN NULL ELSE conf END AS clamped
    FROM (SELECT sample_id, keyword_density AS kd, hidden_text_score AS hidden, watermark_score AS wm, footer_text_density AS footer,
    tiny_text_count AS tiny, ocr_confidence AS conf FROM vision_rows)""", rounded=["score", "clamped"])
def gaps_vision_score(spark, d):
    rows = FE.replaced(vision_rows(spark, d), {
        "ocr_confidence": "CASE WHEN bigint(sample_id) % 3 = 0 THEN NULL WHEN bigint(sample_id) % 5 = 0 THEN double('NaN') ELSE ocr_confidence END"})
    return rows.selectExpr("sample_id", f"{L.vision_score()} AS score", f"{L.clamp_confidence('ocr_confidence')} AS clamped")


@check("gaps_engineer_features", with_("sig", **_GAPS) + f"""SELECT sample_id, {_ENGINEERED}
    FROM (SELECT sample_id, coalesce(malicious_probability, 0.0) AS mp, coalesce(vision_score, 0.0) AS vs FROM gaps)""")
def gaps_engineer_features(spark, d):
    return FE.engineer_features(with_gaps(spark, d)).select("sample_id", "prompt_vision_agreement", "max_signal", "signal_product", "signal_diff")


@check("gaps_feature_stats", with_("sig", **_GAPS) + " UNION ALL ".join(f"""SELECT '{c}' AS feature, printf('%.6f', avg({c}))::double AS mean,
    printf('%.6f', stddev_samp({c}))::double AS std, printf('%.6f', min({c}))::double AS min, printf('%.6f', max({c}))::double AS max,
    count(*) FILTER ({c} = 0) AS zeros, printf('%.2f', count(*) FILTER ({c} <> 0)*100.0::double/count(*))::double AS nonzero_pct FROM gaps""" for c in COLUMNS))
def gaps_feature_stats(spark, d):
    return P.feature_stats(with_gaps(spark, d), COLUMNS)


@check("feature_stats_large", """SELECT 'x' AS feature, avg(doc_id::double*1e13) AS mean, stddev_samp(doc_id::double*1e13) AS std, min(doc_id::double*1e13) AS min,
    max(doc_id::double*1e13) AS max, count(*) FILTER (doc_id = 0) AS zeros FROM documents""", rounded=["mean", "std", "min", "max"], digits=-6)
def feature_stats_large(spark, d):
    return P.feature_stats(table(spark, d, "documents").selectExpr("double(doc_id) * 1e13D AS x"), ["x"]).drop("nonzero_pct")


@check("gaps_describe", with_("sig", **_GAPS) + " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
    min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM gaps""" for c in COLUMNS),
       rounded=["mean", "std", "min", "q25", "q50", "q75", "max"], digits=4)
def gaps_describe(spark, d):
    return P.describe(with_gaps(spark, d), COLUMNS)


@check("gaps_calibration_curve", with_("sig", **_GAPS) + """SELECT greatest(0, least(9, ceil(risk_score*10)::int-1)) AS bin, avg(risk_score) AS mean_score,
    avg(label::double) AS positive_share, count(*) AS n FROM gaps WHERE risk_score IS NOT NULL GROUP BY 1""", rounded=["mean_score", "positive_share"])
def gaps_calibration_curve(spark, d):
    return M.calibration_curve(with_gaps(spark, d), "label", "risk_score")


@check("gaps_roc_auc", with_("sig", **_GAPS) + f"SELECT {auc_sql('risk_score', '(SELECT * FROM gaps WHERE risk_score IS NOT NULL)')} AS roc_auc", rounded=["roc_auc"])
def gaps_roc_auc(spark, d):
    return M.roc_auc(with_gaps(spark, d), "label", "risk_score")


@check("gaps_classification_metrics", with_("sig", **_GAPS) + f"""SELECT *, {METRICS_SQL} FROM (SELECT count(*) FILTER (label = 0 AND risk_score < 0.5) AS tn,
    count(*) FILTER (label = 0 AND risk_score >= 0.5) AS fp, count(*) FILTER (label = 1 AND risk_score < 0.5) AS fn,
    count(*) FILTER (label = 1 AND risk_score >= 0.5) AS tp, count(*) FILTER (risk_score IS NULL) AS n_unscored FROM gaps)""", rounded=METRICS)
def gaps_classification_metrics(spark, d):
    scored = with_gaps(spark, d).selectExpr("label", "int(if(isnan(risk_score), null, risk_score) >= 0.5D) AS predicted")
    return M.with_metrics(M.confusion_matrix(scored, "label", "predicted", unscored="count"))


_CONTEXT = """SELECT doc_id, sample_id, label, split, risk_score, coalesce(vision_score, 0.0::double) AS vision_score,
    coalesce(hidden_text_score >= 0.5, false) AS hidden_text_detected, coalesce(keyword_density, 0.0::double) AS keyword_density,
    footer_text_density AS footer_density, watermark_score, coalesce(malicious_probability, 0.0::double) AS prompt_score,
    lower(trim(attack_family)) AS attack_family, lower(trim(severity)) AS severity FROM gaps"""


@check("gaps_evaluate_rules", with_("sig", **_GAPS, known=_CONTEXT) + f"SELECT sample_id, decision, rule_id FROM ({decision_sql('known')})")
def gaps_evaluate_rules(spark, d):
    return evaluate_rules(with_gaps(spark, d)).select("sample_id", "decision", "rule_id")


@check("gaps_threshold_sweep", with_("sig", **_GAPS, known=_CONTEXT, scored=f"SELECT * REPLACE (coalesce(risk_score, -1.0::double) AS risk_score) FROM ({decision_sql('known')})")
       + ", " + _SWEEP, rounded=["threshold", "f1_macro", "fnr", "chosen_threshold"])
def gaps_threshold_sweep(spark, d):
    return M.threshold_sweep(with_gaps(spark, d))


_BATCH = """SELECT doc_id, sample_id, hidden_text_score, coalesce(vision_score, 0.0::double) AS vision_score, coalesce(malicious_probability, 0.5::double) AS prompt_score,
    coalesce(risk_score, greatest(coalesce(malicious_probability, 0.5::double), coalesce(vision_score, 0.0::double))) AS risk_score,
    coalesce(hidden_text_score >= 0.5, false) AS hidden_text_detected, coalesce(keyword_density, 0.0::double) AS keyword_density,
    footer_text_density AS footer_density, watermark_score, lower(trim(attack_family)) AS attack_family, lower(trim(severity)) AS severity FROM gaps"""


@check("gaps_decide_batch", with_("sig", **_GAPS, batch=_BATCH) + f"""SELECT sample_id, decision, rule_id AS governance_rule_triggered, risk_score, prompt_score,
    vision_score FROM ({decision_sql('batch')})""")
def gaps_decide_batch(spark, d):
    return D.decide_batch(with_gaps(spark, d)).select("sample_id", "decision", "governance_rule_triggered", "risk_score", "prompt_score", "vision_score")


# --- texts, folds and files --------------------------------------------------------------------------------


@check("sliding_window_repeated_ids", f"SELECT * FROM ({WINDOWED}) UNION ALL SELECT * FROM ({WINDOWED})")
def sliding_window_repeated_ids(spark, d):
    return X.sliding_window_score(documents(spark, d).unionByName(documents(spark, d)), X.phrase_scorer(TEST_PHRASES))


_APPENDED = "CASE page_id % 40 " + " ".join(f"WHEN {i} THEN ' {p.upper()}. '" for i, p in enumerate(INJECTION_PHRASES[:39])) + " ELSE ' no phrase ' END"


@check("keyword_density_default_hits", f"SELECT page_id, {sql_density('html', INJECTION_PHRASES)} AS keyword_density FROM (SELECT page_id, html || {_APPENDED} AS html FROM pages)")
def keyword_density_default_hits(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"concat(html, {_APPENDED}) AS html")
    return rows.selectExpr("page_id", f"{T.keyword_density('html', INJECTION_PHRASES)} AS keyword_density")


@check("stratified_folds", with_("sig") + """SELECT label, fold, (ceil(n*(fold+1)/3.0::double) - ceil(n*fold/3.0::double))::bigint AS n
    FROM (SELECT label, count(*) AS n FROM sig GROUP BY 1), (SELECT unnest([0, 1, 2])::int AS fold)""")
def stratified_folds(spark, d):
    return MO.with_folds(signals(spark, d), "label").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


_KINDS = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || text || '  ' WHEN 3 THEN '\"' || text || '\", \"' WHEN 4 THEN text || chr(10) ELSE text END"


@check("csv_roundtrip", f"SELECT doc_id, {_KINDS} AS value, lang FROM documents")
def csv_roundtrip(spark, d):
    path = new_path(spark, "csv_roundtrip")
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_KINDS.replace('chr(10)', chr(39) + chr(92) + 'n' + chr(39))} AS value", "lang")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, "doc_id long, value string, lang string")


# --- a registered backend in the decision plan ---------------------------------------------------------------

_MARKED = f"""CASE WHEN contains(text, 'clown') THEN NULL ELSE w.malicious_probability END"""


def _backend_sql() -> str:
    base = _DOCUMENT_SQL.replace("w.malicious_probability AS prompt_score",
                                 "coalesce(CASE WHEN contains(d.text, 'clown') THEN NULL ELSE w.malicious_probability END, 0.5::double) AS prompt_score, contains(d.text, 'clown') AS broken") \
        .replace("FROM vision_out v JOIN w USING (sample_id)", "FROM vision_out v JOIN w USING (sample_id) JOIN documents d ON d.doc_id = v.doc_id") \
        .replace("SELECT doc_id, sample_id, prompt_score, CASE", "SELECT doc_id, sample_id, broken, prompt_score, CASE")
    return base + f"""SELECT sample_id, decision, risk_score, prompt_score, vision_score, rule_id AS governance_rule_triggered,
        CASE WHEN broken THEN 'cannot score this text' END AS prompt_error FROM ({decision_sql('ctx')})"""


@check("decide_documents_backend", _backend_sql(), rounded=["risk_score", "prompt_score", "vision_score"])
def decide_documents_backend(spark, d):
    registry.register("marked", _counter("clown"))
    decided = decide_documents(pages(spark, d), registry.window_scorer("marked"), phrases=TEST_PHRASES)
    return decided.select("sample_id", "decision", "risk_score", "prompt_score", "vision_score", "governance_rule_triggered", "prompt_error")


# --- a model of given numbers: scores of all documents in plain arithmetic --------------------------------------

_FIXED = MO.RiskModel(["malicious_probability", "vision_score", "keyword_density"], [0.5, 0.4, 0.3], [0.3, 0.25, 0.2], 1.0,
                      [MO.FoldModel([1.5, -0.75, 0.5], 0.25, 1.1, -0.2), MO.FoldModel([1.25, 0.5, 0.0], -0.5, 0.9, 0.1)])
_PROBABILITY = "(" + " + ".join(
    f"1.0::double/(1.0::double + exp(-({f.slope}::double*({f.intercept}::double + "
    + " + ".join(f"{w}::double*(coalesce({c}, 0.0::double) - {m}::double)/{s}::double" for w, c, m, s in zip(f.coefficients, _FIXED.columns, _FIXED.means, _FIXED.scales))
    + f") + {f.offset}::double)))" for f in _FIXED.folds) + f")/{len(_FIXED.folds)}"
_RISK = f"SELECT * REPLACE ({_PROBABILITY} AS risk_score) FROM gaps"


@check("score_risk_fixed", with_("sig", **_GAPS, risk=_RISK) + """SELECT sample_id, risk_score, CASE WHEN risk_score < 0.35::double THEN 'LOW' WHEN risk_score < 0.65::double THEN 'MEDIUM'
    WHEN risk_score < 0.80::double THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, risk_score >= 0.65::double AS is_high_risk FROM risk""", rounded=["risk_score"])
def score_risk_fixed(spark, d):
    rows = FE.replaced(with_gaps(spark, d), {c: f"if(isnan({c}), null, {c})" for c in _FIXED.columns}).drop("risk_score")
    return MO.score_risk(rows, _FIXED).select("sample_id", "risk_score", "risk_level", "is_high_risk")


@check("evaluate_risk_fixed", with_("sig", **_GAPS, risk=_RISK) + f"""SELECT c.*, {METRICS_SQL}, {auc_sql('risk_score', 'risk')} AS roc_auc,
    (SELECT avg(power(risk_score-label, 2)) FROM risk) AS brier FROM (SELECT count(*) FILTER (label = 0 AND risk_score < 0.5) AS tn,
    count(*) FILTER (label = 0 AND risk_score >= 0.5) AS fp, count(*) FILTER (label = 1 AND risk_score < 0.5) AS fn,
    count(*) FILTER (label = 1 AND risk_score >= 0.5) AS tp FROM risk) c""", rounded=[*METRICS, "roc_auc", "brier"], digits=5)
def evaluate_risk_fixed(spark, d):
    rows = FE.replaced(with_gaps(spark, d), {c: f"if(isnan({c}), null, {c})" for c in _FIXED.columns}).drop("risk_score")
    return M.evaluate_risk(FE.replaced(MO.score_risk(rows, _FIXED), {"split": "'all'"})).drop("split")


# --- evaluation of rows without scores ---------------------------------------------------------------------------

def _judged_sql(source: str, test: str) -> str:
    """Confusion counts with the rows that a test cannot judge."""
    return f"""SELECT count(*) FILTER (label = 0 AND NOT ({test})) AS tn, count(*) FILTER (label = 0 AND ({test})) AS fp,
    count(*) FILTER (label = 1 AND NOT ({test})) AS fn, count(*) FILTER (label = 1 AND ({test})) AS tp,
    count(*) FILTER (label IS NOT NULL AND ({test}) IS NULL) AS n_unscored FROM {source}"""


_BOTH = "CASE WHEN malicious_probability IS NOT NULL AND vision_score IS NOT NULL THEN greatest(malicious_probability, vision_score) END"
_LOST = "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE decision END AS decision"
_DECIDED = f"SELECT g.* REPLACE (attack_family AS attack_family), {_LOST} FROM gaps g JOIN (SELECT sample_id AS s, decision FROM ({decision_sql('known')})) ON s = sample_id"
_JUDGED = dict(gaps=_GAPS["gaps"], known=_CONTEXT, judged=_DECIDED)
_FIVE = [("C1: Prompt Agent Only", "malicious_probability >= 0.5", "malicious_probability"), ("C2: Vision Agent Only", "vision_score >= 0.35::double", "vision_score"),
         ("C3: Prompt + Vision (max)", f"{_BOTH} >= 0.5", _BOTH), ("C4: Risk Model Fusion", "risk_score >= 0.5", "risk_score"),
         ("C5: Full Framework", "decision IN ('BLOCK', 'SANITIZE')", "risk_score")]


def _judged(spark, d):
    rows = with_gaps(spark, d)
    decided = evaluate_rules(rows).selectExpr("sample_id", "if(bigint(sample_id) % 41 = 0, null, decision) AS decision")
    return rows.join(decided, "sample_id")


@check("gaps_evaluate_risk", with_("sig", **_GAPS) + " UNION ALL ".join(
    f"""SELECT '{s}' AS split, c.*, {METRICS_SQL}, {auc_sql('risk_score', f"(SELECT * FROM gaps WHERE split = '{s}' AND risk_score IS NOT NULL)")} AS roc_auc,
    (SELECT avg(power(risk_score-label, 2)) FROM gaps WHERE split = '{s}') AS brier
    FROM ({_judged_sql(f"gaps WHERE split = '{s}'", 'risk_score >= 0.5')}) c""" for s in ("train", "val", "test")), rounded=[*METRICS, "roc_auc", "brier"])
def gaps_evaluate_risk(spark, d):
    return M.evaluate_risk(with_gaps(spark, d), unscored="count")


@check("gaps_ablation", with_("sig", **_JUDGED) + " UNION ALL ".join(
    f"""SELECT '{name}' AS config, c.*, {METRICS_SQL}, {auc_sql(score, f'(SELECT * FROM judged WHERE ({score}) IS NOT NULL)')} AS roc_auc, fn::double/greatest(1, tp+fn) > 0.05 AS fnr_above_limit
    FROM ({_judged_sql('judged', test)}) c""" for name, test, score in _FIVE), rounded=[*METRICS, "roc_auc"])
def gaps_ablation(spark, d):
    return M.ablation(_judged(spark, d), unscored="count")


@check("gaps_family_detection", with_("sig", **_JUDGED) + "SELECT attack_family, " + ", ".join(
    f"avg(({test})::int::double) AS c{i + 1}" for i, (_, test, _) in enumerate(_FIVE)) + ", count(*) AS n, count(*) FILTER ("
       + " OR ".join(f"({test}) IS NULL" for _, test, _ in _FIVE) + ") AS n_unscored FROM judged WHERE label = 1 GROUP BY 1", rounded=["c1", "c2", "c3", "c4", "c5"])
def gaps_family_detection(spark, d):
    return M.family_detection(_judged(spark, d), unscored="count")


@check("gaps_governance_eval", with_("sig", **_JUDGED) + f"""SELECT *, fn::double/greatest(1, tp+fn) AS fnr, fp::double/greatest(1, tn+fp) AS fpr
    FROM ({_judged_sql('judged', "decision IN ('BLOCK', 'SANITIZE')")})""", rounded=["fnr", "fpr"])
def gaps_governance_eval(spark, d):
    return M.governance_eval(_judged(spark, d), unscored="count")


@check("gaps_brier", with_("sig", **_GAPS) + """SELECT split, avg(power(risk_score-label, 2)) AS brier, count(*) FILTER (label IS NOT NULL AND risk_score IS NULL) AS n_unscored
    FROM gaps GROUP BY 1""", rounded=["brier"])
def gaps_brier(spark, d):
    return M.brier(with_gaps(spark, d), "label", "risk_score", ["split"], unscored="count")


@check("gaps_prediction_record", with_("sig", **_GAPS) + """SELECT sample_id, malicious_probability, (malicious_probability >= 0.5)::int AS predicted_label,
    CASE WHEN malicious_probability IS NOT NULL THEN greatest(malicious_probability, 1-malicious_probability) END AS confidence, risk_score >= 0.65::double AS is_high_risk FROM gaps""")
def gaps_prediction_record(spark, d):
    rows = with_gaps(spark, d).withColumn("text", F.lit("a text"))
    risk = rows.selectExpr("sample_id", f"{S.is_high_risk('risk_score')} AS is_high_risk")
    return X.prediction_record(rows).select("sample_id", "malicious_probability", "predicted_label", "confidence").join(risk, "sample_id")


_CORRELATED = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, {f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0::double END" if a == b else f"corr({a}, {b})"} AS r FROM gaps"""
                                 for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])


@check("gaps_correlation_matrix", with_("sig", **_GAPS) + _CORRELATED, rounded=["r"])
def gaps_correlation_matrix(spark, d):
    return P.correlation_matrix(with_gaps(spark, d), COLUMNS)


@check("correlation_matrix_blocked", with_("sig", **_GAPS) + _CORRELATED, rounded=["r"])
def correlation_matrix_blocked(spark, d):
    return P.correlation_matrix(with_gaps(spark, d), COLUMNS, narrow=0)


# --- large rule tables -------------------------------------------------------------------------------------------

#: The numeric fields of generated rules: field -> column of the signals.
_NUMERIC = {"risk_score": "risk_score", "vision_score": "vision_score", "keyword_density": "keyword_density",
            "footer_density": "footer_density", "watermark_score": "watermark_score", "prompt_score": "prompt_score"}


def many_rules(n: int) -> list[dict]:
    """n rules with bounds of their own on two numbers each, every third with a list of families, in mixed priorities."""
    fields, out = list(_NUMERIC), []
    for i in range(n):
        one, two = fields[i % 6], fields[(i // 6 + 1 + i % 6) % 6]
        low = (i * 7919 % 10007) / 10007
        condition = {one: {"gte": low, "lt": low + 0.02}}
        if two != one:
            condition[two] = {"gt": (i * 104729 % 9973) / 9973 * 0.9}
        if i % 3 == 0:
            condition["attack_family"] = {"in": ["fraud", "jailbreak"] if i % 2 else ["unknown"]}
        out.append({"id": f"R{i:05d}", "priority": (i * 31) % 65537, "name": f"rule {i}", "action": ("BLOCK", "SANITIZE", "ALLOW")[i % 3], "severity": "high",
                    "policy_ref": "p", "condition": condition, "reason_template": f"rule {i}"})
    return out


_MANY = """SELECT 'R' || lpad(i::varchar, 5, '0') AS rule_id, (i*31) % 65537 AS priority, ['BLOCK', 'SANITIZE', 'ALLOW'][i % 3 + 1] AS decision, i % 6 AS one,
    (i//6 + 1 + i % 6) % 6 AS two, (i*7919 % 10007)::double/10007 AS low, (i*104729 % 9973)::double/9973*0.9::double AS above,
    CASE WHEN i % 3 <> 0 THEN NULL WHEN i % 2 = 1 THEN ['fraud', 'jailbreak'] ELSE ['unknown'] END AS families FROM range(5000) r(i)"""
_FIRED = f"""SELECT sample_id, rule_id, priority, decision FROM (SELECT *, [{', '.join(_NUMERIC)}] AS v FROM known) k JOIN many m
    ON v[one + 1] >= low AND v[one + 1] < low + 0.02::double AND (two = one OR v[two + 1] > above) AND (families IS NULL OR list_contains(families, attack_family))"""
_MANY_CTES = dict(gaps=_GAPS["gaps"], known=_CONTEXT, many=_MANY, fired=_FIRED)


@check("evaluate_rules_5000", with_("sig", **_MANY_CTES) + """SELECT k.sample_id, coalesce(f.decision, 'ALLOW') AS decision, f.rule_id FROM known k
    LEFT JOIN (SELECT sample_id, arg_min(decision, priority) AS decision, arg_min(rule_id, priority) AS rule_id FROM fired GROUP BY 1) f USING (sample_id)""")
def evaluate_rules_5000(spark, d):
    return evaluate_rules(with_gaps(spark, d), many_rules(5000)).select("sample_id", "decision", "rule_id")


@check("rule_hits_5000", with_("sig", **_MANY_CTES) + "SELECT sample_id, rule_id, priority::int AS priority FROM fired")
def rule_hits_5000(spark, d):
    return rule_hits(with_gaps(spark, d), many_rules(5000))


# --- phrases by index --------------------------------------------------------------------------------------------

#: The phrases of the tests among 20,000 that occur nowhere.
MANY_PHRASES = [*TEST_PHRASES, *[f"zq{i} qz{i % 977}" for i in range(20000)]]


@check("keyword_density_20000", f"SELECT doc_id, {sql_density('text')} AS keyword_density FROM documents")
def keyword_density_20000(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{PhraseIndex(MANY_PHRASES).density('text')} AS keyword_density")


@check("sliding_window_20000_phrases", WINDOWED)
def sliding_window_20000_phrases(spark, d):
    return X.sliding_window_score(documents(spark, d), X.indexed_phrase_scorer(MANY_PHRASES))


# --- documents to decisions with the model of given numbers ------------------------------------------------------

_AT_PAGE = _PROBABILITY.replace("malicious_probability", "prompt_score").replace("coalesce(keyword_density", "coalesce(CASE WHEN seen THEN kd ELSE 0.0::double END") \
    .replace("coalesce(vision_score", "coalesce(CASE WHEN seen THEN vs ELSE 0.0::double END")
_PAGE_CTES = {**_DOCUMENT_CTES, "ctx": _DOCUMENT_CTES["ctx"].replace(
    "greatest(prompt_score, CASE WHEN seen THEN vs ELSE 0.0::double END) AS risk_score", f"{_AT_PAGE} AS risk_score")}


@check("decide_documents_fixed", with_("vision_out", w=WINDOWED, **_PAGE_CTES) + f"""SELECT sample_id, decision, risk_score, CASE WHEN risk_score < 0.35::double THEN 'LOW'
    WHEN risk_score < 0.65::double THEN 'MEDIUM' WHEN risk_score < 0.80::double THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
    prompt_score, vision_score, greatest(prompt_score, 1-prompt_score) AS confidence, rule_id AS governance_rule_triggered,
    sanitization_action, vision_error FROM ({decision_sql('ctx')})""", rounded=["risk_score", "prompt_score", "vision_score", "confidence"])
def decide_documents_fixed(spark, d):
    return decide_documents(pages(spark, d), X.phrase_scorer(TEST_PHRASES), model=_FIXED, phrases=TEST_PHRASES).select(*_DOCUMENT_COLUMNS)
