"""Risk and text models, document decisions, streams and scoring backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import WINDOWED, windowed_sql
from checks.inputs import SPLIT, TEST_PHRASES, decision_sql, documents, labelled, pages, signals, sql_density, sql_tokens, table, u, with_
from checks.registry import check
from checks.scalars import heuristic_sql
from checks.sources import AUDIT_SQL, audit_rows
from docguard.fixed_values import HEURISTIC_PHRASES, IMPERATIVE_VERBS, NINE_FEATURES
from docguard.functions import registry
from docguard.operators import metrics as M
from docguard.operators import model as MO
from docguard.operators import newton as N
from docguard.operators.linear import LinearTextModel, compiled, with_window_scores
from docguard.operators import texts as X
from docguard.operators.features import fill_defaults
from docguard.operators.layouts import vision_features
from docguard.plans.documents import analyze_texts, decide_documents
from docguard.plans.evaluation import evaluate_matrix
from docguard.session import listed_names, new_path, written

from docguard.streaming import decisions as ST

_FITTED: dict[tuple[str, str], tuple] = {}


def matrix(spark, d):
    """The nine features of all documents, from their texts, boxes and layers; label is NULL where there is none."""
    seen = vision_features(pages(spark, d), TEST_PHRASES, keep=["doc_id", "text", "severity"])
    labels = table(spark, d, "labels").selectExpr("doc_id", "toxic AS label")
    scored = seen.join(labels, "doc_id", "left").selectExpr(
        *NINE_FEATURES[1:-1], "sample_id", "label", "severity", "'unknown' AS attack_family", f"{SPLIT} AS split",
        # a second, independent opinion on the text: half of the density and noise
        f"keyword_density * 0.5D + {u('s7')} * 0.5D AS malicious_probability")
    return fill_defaults(scored, "nine").select("sample_id", "label", "split", "severity", "attack_family", *NINE_FEATURES)


def fitted(spark, d):
    """(matrix, model, search table), fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        stored = written(matrix(spark, d), "matrix")
        model, search = MO.fit_risk(stored.filter("split = 'train' AND label IS NOT NULL"))
        _FITTED[key] = (stored, model, search)
    return _FITTED[key]


@check("standardise", with_("sig") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS scale FROM sig WHERE split = 'train'"
    for c in ("risk_score", "vision_score", "keyword_density")), rounded=["mean", "scale"])
def standardise(spark, d):
    columns = ["risk_score", "vision_score", "keyword_density"]
    rows = signals(spark, d).filter("split = 'train'")
    means, scales = MO.standardise(rows, columns)
    sd = MO.standardised(rows, columns, means, scales)
    return sd.groupBy().agg(F.expr("count(1) AS n"), *[F.expr(e) for c in columns for e in (f"avg({c}) AS a_{c}", f"stddev_pop({c}) AS s_{c}")]) \
        .selectExpr(f"stack({len(columns)}, " + ", ".join(
            f"'{c}', a_{c} * {scale}D + {mean}D, s_{c} * {scale}D" for c, mean, scale in zip(columns, means, scales)) + ") AS (feature, mean, scale)")


@check("fit_risk_model")
def fit_risk_model(spark, d):
    stored, _, search = fitted(spark, d)
    return stored.sparkSession.createDataFrame(search, "c double, mean_f1_macro double, iterations int, converged boolean")


def _newton_sql(source: str, x: list[str], y: str, weight: str, penalty: str, steps: int = 14) -> str:
    """CTEs n0, n1, ...: Newton steps for the weights of x (an intercept last) per row of n0 (key, penalty), unrolled."""
    p = len(x) + 1
    terms = [*x, "1.0::double"]
    b = [f"b{i}" for i in range(p)]
    parts = [f"n0 AS (SELECT k, {', '.join(f'0.0::double AS {c}' for c in b)} FROM keys)"]
    z = " + ".join(f"n.{c}*{t}" for c, t in zip(b, terms))
    for s in range(steps):
        ridge = [f"{penalty}" if i < p - 1 else "0.0::double" for i in range(p)]
        sums = ", ".join([f"sum({weight}*(q-{y})*{t}) + {r}*any_value({c}) AS g{i}" for i, (t, r, c) in enumerate(zip(terms, ridge, b))]
                         + [f"sum({weight}*q*(1-q)*{terms[i]}*{terms[j]}){f' + {ridge[i]}' if i == j else ''} AS h{i}{j}" for i in range(p) for j in range(i, p)])
        h = lambda i, j: f"h{min(i, j)}{max(i, j)}"

        def det(m: list[list[str]]) -> str:
            if len(m) == 1:
                return m[0][0]
            return "(" + " ".join(f"{'+-'[j % 2]} {m[0][j]}*{det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"

        full = [[h(i, j) for j in range(p)] for i in range(p)]
        moved = [f"b{i} - {det([[f'g{r}' if c == i else full[r][c] for c in range(p)] for r in range(p)])}/{det(full)} AS b{i}" for i in range(p)]
        parts.append(f"""n{s + 1} AS (SELECT k, {', '.join(moved)} FROM (SELECT k, {', '.join(f'any_value({c}) AS {c}' for c in b)}, {sums}
            FROM (SELECT n.*, r.* EXCLUDE (k), 1/(1+exp(-({z}))) AS q FROM n{s} n JOIN {source} r USING (k)) GROUP BY k))""")
    return ", ".join(parts)


_NEWTON_ROWS = "SELECT label::double AS y, risk_score + 0.5::double*label AS u, vision_score AS v FROM sig"


@check("logistic_newton", with_("sig", keys="SELECT unnest([1, 100]) AS k", rows_of=f"SELECT k, r.* FROM keys, ({_NEWTON_ROWS}) r") + ", "
       + _newton_sql("rows_of", ["u", "v"], "y", "CASE WHEN y = 1 THEN 1.5::double ELSE 0.75::double END", "k::double")
       + " SELECT k::double AS penalty, b0 AS u, b1 AS v, b2 AS intercept FROM n14", rounded=["u", "v", "intercept"])
def logistic_newton(spark, d):
    rows = signals(spark, d).selectExpr("double(label) AS y", "risk_score + 0.5D * label AS u", "vision_score AS v")
    fits = N.fit_logistic(rows, ["u", "v"], [N.Problem(None, 0.75, 1.5, float(k)) for k in (1, 100)])
    return spark.createDataFrame([(float(k), *f.weights) for k, f in zip((1, 100), fits)], "penalty double, u double, v double, intercept double")


_SOFT = "CASE WHEN y = 1 THEN (pos+1.0::double)/(pos+2.0::double) ELSE 1.0::double/(neg+2.0::double) END"


@check("platt_newton", with_("sig", rows_of=f"""SELECT k, m, {_SOFT} AS t FROM (SELECT (doc_id % 3)::int AS k, label AS y, 2.0::double*(risk_score + 0.5::double*label)
    - vision_score - 0.1::double*(doc_id % 3) AS m, count(*) FILTER (label = 1) OVER (PARTITION BY doc_id % 3) AS pos,
    count(*) FILTER (label = 0) OVER (PARTITION BY doc_id % 3) AS neg FROM sig)""", keys="SELECT DISTINCT k FROM rows_of") + ", "
       + _newton_sql("rows_of", ["m"], "t", "1.0::double", "0.0::double") + " SELECT k AS fold, b0 AS slope, b1 AS offset_ FROM n14", rounded=["slope", "offset_"])
def platt_newton(spark, d):
    rows = signals(spark, d).selectExpr("double(label) AS y", "int(bigint(sample_id) % 3) AS fold", "risk_score + 0.5D * label AS u", "vision_score AS v")
    sizes = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.expr("count(1) AS n")).collect()}
    targets = [N.soft_targets(sizes.get((fold, 1.0), 0), sizes.get((fold, 0.0), 0)) for fold in range(3)]
    fits = N.fit_sigmoids(rows, ["u", "v"], [[2.0, -1.0, -0.1 * fold] for fold in range(3)], targets)
    return spark.createDataFrame([(k, *f.weights) for k, f in enumerate(fits)], "fold int, slope double, offset_ double")


@check("risk_model_conditions", f"""SELECT fold, term, true AS holds FROM (SELECT unnest([0, 1, 2])::int AS fold),
    (SELECT unnest([{', '.join(f"'{c}'" for c in NINE_FEATURES)}, 'intercept', 'platt_slope', 'platt_offset']) AS term)""")
def risk_model_conditions(spark, d):
    """Of each fold's fit, in Spark SQL over all rows: the gradient vanishes, and so do both of the calibration's."""
    stored, model, _ = fitted(spark, d)
    train = stored.filter("split = 'train' AND label IS NOT NULL")
    z = MO.scaled(NINE_FEATURES, model.means, model.scales)
    rows = MO.with_folds(train, "label").selectExpr("double(label) AS y", "fold", *[f"{e} AS z{i}" for i, e in enumerate(z)], "1.0D AS z9")
    sizes = "count(1) OVER (PARTITION BY fold, y)"
    sized = rows.selectExpr("*", f"{sizes} AS own", "count(1) OVER (PARTITION BY y) AS same", "count(1) OVER (PARTITION BY fold) AS here", "count(1) OVER (PARTITION BY 1) AS n")
    out = None
    for k, fold in enumerate(model.folds):
        margin = " + ".join(f"({w!r}D) * z{i}" for i, w in enumerate([*fold.coefficients, fold.intercept]))
        # rows outside the fold: of this class, of all; inside it: of this class
        marked = sized.selectExpr("*", f"max(if(fold = {k}, own, 0)) OVER (PARTITION BY y) AS mine", f"max(if(fold = {k}, here, 0)) OVER (PARTITION BY 1) AS held",
                                  f"{margin} AS m").selectExpr("*", "(n - held) / (2D * (same - mine)) AS w", "1D / (1D + exp(-m)) AS p",
                                  f"1D / (1D + exp(-(({fold.slope!r}D) * m + ({fold.offset!r}D)))) AS q", "if(y = 1D, (mine + 1D) / (mine + 2D), 1D / (mine + 2D)) AS t")
        slopes = [f"abs(sum(if(fold <> {k}, w * (p - y) * z{i}, 0D)) + ({(c / model.c)!r}D)) / count(1)"
                  for i, c in enumerate([*fold.coefficients, 0.0])]
        slopes += [f"abs(sum(if(fold = {k}, (q - t) * m, 0D))) / count(1)", f"abs(sum(if(fold = {k}, q - t, 0D))) / count(1)"]
        terms = [*NINE_FEATURES, "intercept", "platt_slope", "platt_offset"]
        part = marked.agg(*[F.expr(f"{e} <= 1e-8D AS c{i}") for i, e in enumerate(slopes)]).selectExpr(
            f"{k} AS fold", f"stack({len(terms)}, " + ", ".join(f"'{t}', c{i}" for i, t in enumerate(terms)) + ") AS (term, holds)")
        out = part if out is None else out.unionByName(part)
    return out


@check("platt_calibrate")
def platt_calibrate(spark, d):
    stored, model, _ = fitted(spark, d)
    scored = stored.selectExpr("split", "label", f"{MO.risk_probability(model)} AS risk_score")
    return M.calibration_curve(scored.filter("split <> 'train' AND label IS NOT NULL"), "label", "risk_score")


@check("score_risk")
def score_risk(spark, d):
    stored, model, _ = fitted(spark, d)
    return MO.score_risk(stored, model).select("sample_id", "split", "risk_score", "risk_level", "is_high_risk")


@check("evaluate_risk_model")
def evaluate_risk_model(spark, d):
    stored, model, _ = fitted(spark, d)
    return M.evaluate_risk(MO.score_risk(stored, model).filter("split <> 'train' AND label IS NOT NULL"))


@check("feature_importance")
def feature_importance(spark, d):
    _, model, _ = fitted(spark, d)
    return MO.feature_importance(spark, model)


@check("model_roundtrip", with_("docs") + """SELECT count(*) AS n, count(*) AS n_equal FROM docs""")
def model_roundtrip(spark, d):
    stored, model, _ = fitted(spark, d)
    path = new_path(spark, "risk_model")
    MO.save_model(spark, model, path)
    again = MO.load_model(spark, path)
    both = stored.selectExpr(f"{MO.risk_probability(model)} AS a", f"{MO.risk_probability(again)} AS b")
    return both.agg(F.expr("count(1) AS n"), F.expr("count_if(abs(a - b) < 0.00001D) AS n_equal"))


@check("text_model")
def text_model(spark, d):
    model = MO.fit_text_model(labelled(spark, d).select("text", "label"))
    docs = documents(spark, d).selectExpr("sample_id", "text", "toxic AS label")
    return MO.text_probability(docs, model).select("sample_id", "label", "malicious_probability")


# a text model of given weights: 256 buckets by the first byte of a token's digest
_GIVEN = LinearTextModel([((b * 37) % 101) / 500.0 - 0.1 for b in range(256)], -0.75, "conv(substring(md5({t}), 1, 2), 16, 10)")
_GIVEN_SQL = r"""(SELECT 1.0::double/(1.0::double + exp(-(-0.75::double + coalesce(sum(((b*37) % 101)/500.0::double - 0.1::double), 0.0::double))))
    FROM (SELECT ('0x' || substr(md5(t), 1, 2))::int AS b FROM (SELECT unnest(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}_]+')) AS t) WHERE t <> ''))"""
_GIVEN_WINDOWED = windowed_sql(_GIVEN_SQL)


@check("text_model_windows", _GIVEN_WINDOWED, rounded=["malicious_probability"])
def text_model_windows(spark, d):
    return X.sliding_window_score(documents(spark, d), _GIVEN)


@check("text_model_compiled", "SELECT count(*) AS n, count(*) AS n_equal FROM documents")
def text_model_compiled(spark, d):
    """The lookup of a fitted pipeline gives what the pipeline gives, on whole texts."""
    model = MO.fit_text_model(labelled(spark, d).repartition("doc_id").select("text", "label"), features=1 << 12)
    docs = documents(spark, d).repartition("doc_id").select("sample_id", "text")
    plain = MO.text_probability(docs, model).select("sample_id", "malicious_probability")
    looked = with_window_scores(docs, compiled(model), size=1 << 30).selectExpr("sample_id", "_scores[0] AS score")
    return plain.join(looked, "sample_id").agg(F.expr("count(1) AS n"), F.expr("count_if(abs(score - malicious_probability) < 1e-9D) AS n_equal"))


@check("evaluate_matrix")
def evaluate_matrix_query(spark, d):
    stored, model, _ = fitted(spark, d)
    _, _, table_of_five = evaluate_matrix(stored.filter("label IS NOT NULL"), model=model)
    return table_of_five


# --- documents to decisions ----------------------------------------------------------------

_DOCUMENT_CTES = dict(s="""
    SELECT v.doc_id, v.sample_id, v.severity, trim(coalesce(v.image_path, '')) <> '' AS seen, v.error, w.malicious_probability AS prompt_score,
        v.vision_score AS vs, v.hidden_text_score, v.keyword_density AS kd, v.footer_text_density AS fd, v.watermark_score AS wm
    FROM vision_out v JOIN w USING (sample_id)""", ctx="""
    SELECT doc_id, sample_id, prompt_score, CASE WHEN seen THEN vs ELSE 0.0::double END AS vision_score,
        greatest(prompt_score, CASE WHEN seen THEN vs ELSE 0.0::double END) AS risk_score,
        seen AND hidden_text_score >= 0.5 AS hidden_text_detected, CASE WHEN seen THEN kd ELSE 0.0::double END AS keyword_density,
        CASE WHEN seen THEN fd ELSE 0.0::double END AS footer_density, CASE WHEN seen THEN wm ELSE 0.0::double END AS watermark_score,
        'unknown' AS attack_family, severity, CASE WHEN seen THEN error END AS vision_error FROM s""")


_DOCUMENT_SQL = with_("vision_out", w=WINDOWED, **_DOCUMENT_CTES)


def _document_sql(windowed: str = WINDOWED) -> str:
    return with_("vision_out", w=windowed, **_DOCUMENT_CTES) + f"""SELECT sample_id, decision, risk_score, CASE WHEN risk_score >= 0.65::double THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
        prompt_score, vision_score, greatest(prompt_score, 1-prompt_score) AS confidence, rule_id AS governance_rule_triggered,
        sanitization_action, vision_error FROM ({decision_sql('ctx')})"""


_DOCUMENT_COLUMNS = ["sample_id", "decision", "risk_score", "risk_level", "prompt_score", "vision_score", "confidence",
                     "governance_rule_triggered", "sanitization_action", "vision_error"]


def _decide(docs):
    return decide_documents(docs, X.phrase_scorer(TEST_PHRASES), phrases=TEST_PHRASES)


@check("decide_documents", _document_sql(), rounded=["risk_score", "prompt_score", "vision_score", "confidence"])
def decide_documents_query(spark, d):
    return _decide(pages(spark, d)).select(*_DOCUMENT_COLUMNS)


_ANALYSED = with_(h=heuristic_sql(HEURISTIC_PHRASES + TEST_PHRASES, IMPERATIVE_VERBS), ctx="""
    SELECT doc_id, risk_score, 0.0::double AS vision_score, false AS hidden_text_detected, keyword_density, 0.0::double AS footer_density,
        0.0::double AS watermark_score, prompt_score, 'unknown' AS attack_family, 'medium' AS severity FROM h""")


@check("analyze_texts", _ANALYSED + f"""SELECT doc_id::varchar AS sample_id, decision, risk_score, prompt_score, keyword_density,
    greatest(prompt_score, 1-prompt_score) AS confidence, rule_id, reason FROM ({decision_sql('ctx')})""", rounded=["confidence"])
def analyze_texts_query(spark, d):
    docs = table(spark, d, "documents").selectExpr("string(doc_id) AS sample_id", "text")
    return analyze_texts(docs, HEURISTIC_PHRASES + TEST_PHRASES).select(
        "sample_id", "decision", "risk_score", "prompt_score", "keyword_density", "confidence", "rule_id", "reason")


@check("heuristic_windows", windowed_sql(f"""(SELECT least(1.0::double, least(1.0::double, hits::double/greatest(1.0::double, n/10.0::double))*0.6::double
    + (verbs/5.0::double)*0.4::double) FROM (SELECT {' + '.join(f"contains(lower(chunk), '{p}')::int" for p in TEST_PHRASES)} AS hits,
    len({sql_tokens('chunk')}) AS n,
    len(list_filter(({sql_tokens('lower(chunk)')})[1:20], lambda x: x IN ('the', 'la'))) AS verbs))"""), rounded=["malicious_probability"])
def heuristic_windows(spark, d):
    return X.sliding_window_score(documents(spark, d), X.heuristic_scorer(TEST_PHRASES, ["the", "la"]))


@check("decide_documents_text_model", _document_sql(_GIVEN_WINDOWED), rounded=["risk_score", "prompt_score", "vision_score", "confidence"])
def decide_documents_text_model(spark, d):
    return decide_documents(pages(spark, d), _GIVEN, phrases=TEST_PHRASES).select(*_DOCUMENT_COLUMNS)


@check("decide_documents_model")
def decide_documents_model(spark, d):
    _, model, _ = fitted(spark, d)
    return decide_documents(pages(spark, d), X.phrase_scorer(TEST_PHRASES), model=model, phrases=TEST_PHRASES) \
        .select(*_DOCUMENT_COLUMNS)


@check("stream_decisions", _document_sql(), rounded=["risk_score", "prompt_score", "vision_score", "confidence"])
def stream_decisions(spark, d):
    sink, checkpoint = new_path(spark, "audit_stream"), new_path(spark, "audit_stream_state")
    prepared = new_path(spark, "page_rows")
    pages(spark, d).drop("doc_id", "lang", "source", "n_chars", "toxic").write.parquet(prepared + "/pages.parquet")
    schema = spark.read.parquet(prepared + "/pages.parquet").schema
    # the second run finds nothing new: every document is decided once
    for _ in range(2):
        source = ST.stream_table(spark, prepared, "pages", schema)
        ST.stream_decisions(source, _decide, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select(*_DOCUMENT_COLUMNS)


@check("stream_decisions_once", f"SELECT *, upper(md5(sample_id)) AS audit_log_id FROM ({_document_sql()})", rounded=["risk_score", "prompt_score", "vision_score", "confidence"])
def stream_decisions_once(spark, d):
    """Documents that arrive in up to three files are decided once; ids have 32 digits."""
    sink, checkpoint, prepared = new_path(spark, "audit_stream"), new_path(spark, "audit_stream_state"), new_path(spark, "page_rows")
    rows = pages(spark, d).withColumn("arrived", F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id % 3600)")) \
        .drop("doc_id", "lang", "source", "n_chars", "toxic")
    for share in (1, 3, 5):
        rows.filter(f"bigint(sample_id) % {share} = 0").write.mode("append").parquet(prepared + "/pages.parquet")
    schema = spark.read.parquet(prepared + "/pages.parquet").schema
    # an arrival has as many files as tasks wrote it; three batches take them all
    files = sum(name.startswith("part-") for name in listed_names(spark, prepared + "/pages.parquet"))
    for _ in range(2):
        source = ST.each_once(ST.stream_table(spark, prepared, "pages", schema, files_per_batch=max(1, -(-files // 3))), "arrived")
        ST.stream_decisions(source, lambda docs: decide_documents(docs, X.phrase_scorer(TEST_PHRASES), phrases=TEST_PHRASES, id_digits=32), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select(*_DOCUMENT_COLUMNS, "audit_log_id")


@check("stream_decision_counts", with_("decided", audit=AUDIT_SQL.replace("e.value AS total_ms", "e.value AS total_ms, e.ts")) + """
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, decision, count(*) AS n
    FROM (SELECT date_trunc('hour', ts) AS w, decision FROM audit)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM audit) - INTERVAL 10 MINUTE GROUP BY w, decision""")
def stream_decision_counts(spark, d):
    log = new_path(spark, "audit_log") + "/audit.parquet"
    audit_rows(spark, d).write.parquet(log)
    sink, checkpoint = new_path(spark, "counts"), new_path(spark, "counts_state")
    source = ST.stream_table(spark, log[: -len("/audit.parquet")], "audit", spark.read.parquet(log).schema)
    ST.stream_decision_counts(source, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "decision", "n")


# --- scoring backends ----------------------------------------------------------------------


def _counter(marker: str | None = None):
    """A stand-in for a model that fails on texts with a marker phrase; a nested function travels by value."""
    words = list(TEST_PHRASES)

    def load():
        import re
        pattern = re.compile(r"\b(?:" + "|".join(words) + r")\b")

        def score(texts):
            if marker and texts.str.contains(marker, regex=False).any():
                raise ValueError("cannot score this text")
            return texts.str.lower().map(lambda t: min(1.0, 0.5 * len(set(pattern.findall(t)))))

        return score

    return load


def _missing():
    def load():
        raise RuntimeError("no such model file")

    return load


@check("backend_registry", f"""SELECT doc_id, CASE WHEN contains(text, 'clown') THEN NULL ELSE {sql_density('text')} END AS score,
    CASE WHEN contains(text, 'clown') THEN 'cannot score this text' END AS error, 'no such model file' AS broken FROM documents""")
def backend_registry(spark, d):
    registry.register("marked", _counter("clown"))
    registry.register("broken", _missing())
    docs = table(spark, d, "documents")
    scored = docs.select("doc_id", registry.scorer("marked")("text").alias("r"),
                         registry.scorer("broken")("text").alias("b"))
    return scored.selectExpr("doc_id", "r.score", "r.error", "b.error AS broken")


@check("scorer_udf", WINDOWED)
def scorer_udf(spark, d):
    registry.register("counter", _counter())
    backend = registry.scorer("counter")
    return X.sliding_window_score(documents(spark, d), lambda text: backend(text)["score"])
