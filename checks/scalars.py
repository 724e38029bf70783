"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    TEST_PHRASES, documents, events_of, labelled, layers, pairs, predictions, signals, sql_density, sql_tokens, table,
    vision_rows, with_,
)
from checks.registry import check
from docguard.fixed_values import (
    ALLOWED_CONTENT_TYPES, FOURTEEN_FEATURES, HEURISTIC_PHRASES, IMPERATIVE_VERBS, INJECTION_PHRASES, NINE_FEATURES,
)
from docguard.functions import layout as L
from docguard.functions import signals as S
from docguard.functions import text as T
from docguard.operators import decisions as D
from docguard.operators import features as FE
from docguard.operators import texts as X
from docguard.operators.rules import evaluate_rules
from docguard.operators.splits import normalise_split, with_group_key


@check("encode_label", with_("pairs") + """SELECT sample_id, (label = 'malicious')::int AS strict,
    (attack_family = 'malicious')::int AS lenient FROM pairs""")
def encode_label(spark, d):
    df = pairs(spark, d)
    return df.selectExpr("sample_id", f"{S.label_code('label', True)} AS strict",
                         f"{S.label_code('attack_family', False)} AS lenient")


@check("normalise_split", with_("pairs") + "SELECT sample_id, original_split AS split FROM pairs")
def normalise_split_query(spark, d):
    raw = "if(original_split = 'val', ' Validation ', upper(original_split)) AS corrected_split"
    return normalise_split(pairs(spark, d).selectExpr("sample_id", raw))


@check("pick_text_column", """SELECT conv_id, turn, text AS for_inference, role AS for_training FROM conversations""")
def pick_text_column(spark, d):
    df = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role AS text", "text AS ocr_text")
    return X.pick_text(X.pick_text(df, X.INFERENCE_ORDER, "for_inference"), X.TRAINING_ORDER, "for_training") \
        .select("conv_id", "turn", "for_inference", "for_training")


@check("group_key", with_("pairs") + "SELECT sample_id, group_key FROM pairs")
def group_key(spark, d):
    return with_group_key(pairs(spark, d).drop("group_key")).select("sample_id", "group_key")


_WORDS = f"len({sql_tokens('text')})::int"


@check("token_length", f"""SELECT doc_id, {_WORDS} AS word_count, floor({_WORDS}*1.3::double)::int AS approx_tokens FROM documents""")
def token_length(spark, d):
    return X.token_length(table(spark, d, "documents")).select("doc_id", "word_count", "approx_tokens")


_TRUNCATED = """CASE WHEN len(w) <= 512 THEN text ELSE
    array_to_string(list_concat(list_concat(w[1:128], list_slice(w, greatest(128, len(w)//2-128)+1, greatest(128, len(w)//2-128)+256)),
                    list_slice(w, -128, -1)), ' ') END"""


@check("smart_truncate", f"""SELECT doc_id, md5({_TRUNCATED}) AS digest, length({_TRUNCATED})::int AS n_chars
    FROM (SELECT doc_id, text, {sql_tokens('text')} AS w FROM documents)""")
def smart_truncate(spark, d):
    cut = X.truncate_texts(table(spark, d, "documents"))
    return cut.selectExpr("doc_id", "md5(text) AS digest", "length(text) AS n_chars")


_HIT_LIST = "array_to_string(list_filter([" + ", ".join(
    rf"CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){p}([^\p{{L}}\p{{N}}_]|$)') THEN '{p}' END" for p in TEST_PHRASES
) + "], lambda p: p IS NOT NULL), ',')"


@check("keyword_hits", f"SELECT doc_id, {_HIT_LIST} AS hits FROM documents")
def keyword_hits(spark, d):
    hits = T.keyword_hits("text", TEST_PHRASES)
    return table(spark, d, "documents").selectExpr("doc_id", f"array_join({hits}, ',') AS hits")


@check("keyword_density", f"SELECT doc_id, {sql_density('text')} AS keyword_density, {_WORDS} AS total_words FROM documents")
def keyword_density(spark, d):
    return X.with_keyword_density(table(spark, d, "documents"), phrases=TEST_PHRASES) \
        .select("doc_id", "keyword_density", "total_words")


@check("keyword_density_default", f"""SELECT page_id, {sql_density('html', INJECTION_PHRASES)} AS keyword_density FROM pages""")
def keyword_density_default(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{T.keyword_density('html', INJECTION_PHRASES)} AS keyword_density")


def heuristic_sql(phrases, verbs):
    hits = " + ".join(f"contains(lower(text), '{p}')::int" for p in phrases)
    listed = ", ".join(f"'{v}'" for v in verbs)
    return f"""SELECT doc_id, printf('%.4f', p)::double AS prompt_score, printf('%.4f', density)::double AS keyword_density,
        0.0::double AS vision_score, printf('%.4f', p)::double AS risk_score
        FROM (SELECT doc_id, density, least(1.0::double, density*0.6::double + (verbs/5.0::double)*0.4::double) AS p
        FROM (SELECT doc_id, least(1.0::double, hits::double/greatest(1.0::double, n/10.0::double)) AS density, verbs
        FROM (SELECT doc_id, {hits} AS hits, len(w) AS n, len(list_filter(w[1:20], lambda x: x IN ({listed}))) AS verbs
        FROM (SELECT doc_id, text, {sql_tokens('lower(text)')} AS w FROM documents))))"""


@check("heuristic_score", heuristic_sql(HEURISTIC_PHRASES + TEST_PHRASES, IMPERATIVE_VERBS + ["the", "and", "idiot", "la"]))
def heuristic_score(spark, d):
    scored = X.heuristic_scores(table(spark, d, "documents"), phrases=HEURISTIC_PHRASES + TEST_PHRASES,
                                verbs=IMPERATIVE_VERBS + ["the", "and", "idiot", "la"])
    return scored.select("doc_id", "prompt_score", "keyword_density", "vision_score", "risk_score")


VISION_SCORE_SQL = """greatest(0.0::double, least(1.0::double, 0.6::double*kd + 0.1::double*hidden + 0.05::double*wm
    + 0.05::double*footer + 0.05::double*least(1.0::double, ln(1+tiny::double)/ln(11.0::double)) + 0.15::double*(1-conf)))"""


@check("vision_score", with_("vision_rows") + f"""SELECT sample_id, {VISION_SCORE_SQL} AS score FROM (SELECT sample_id,
    keyword_density AS kd, hidden_text_score AS hidden, watermark_score AS wm, footer_text_density AS footer,
    tiny_text_count AS tiny, ocr_confidence AS conf FROM vision_rows)""", rounded=["score"])
def vision_score(spark, d):
    return vision_rows(spark, d).selectExpr("sample_id", f"{L.vision_score()} AS score")


def _set(text):
    return f"list_distinct({sql_tokens(f'lower({text})')})"


@check("watermark_score", with_("layers") + f"""SELECT doc_id, CASE WHEN len(hc) = 0 THEN 0.0::double ELSE len(new)::double/len(hc) END AS watermark_score,
    array_to_string(list_sort(new), ' ') AS new_words
    FROM (SELECT doc_id, hc, list_filter(hc, lambda w: NOT list_contains(base, w)) AS new
          FROM (SELECT doc_id, {_set('high_contrast')} AS hc, {_set('normal')} AS base FROM layers))""")
def watermark_score(spark, d):
    return layers(table(spark, d, "documents")).selectExpr(
        "doc_id", f"{L.watermark_score('normal', 'high_contrast')} AS watermark_score",
        f"array_join({L.new_words('normal', 'high_contrast')}, ' ') AS new_words")


@check("hidden_text_score", with_("layers") + """SELECT doc_id,
    CASE WHEN length(trim(near_white)) > 3 THEN 1.0::double ELSE 0.0::double END AS hidden_text_score,
    coalesce(length(trim(near_white)) > 3, false) AS detected FROM layers""")
def hidden_text_score(spark, d):
    scored = layers(table(spark, d, "documents")).selectExpr("doc_id", f"{L.hidden_text_score('near_white')} AS hidden_text_score")
    return scored.selectExpr("*", f"{L.hidden_text_detected('hidden_text_score')} AS detected")


@check("combine_layers", with_("layers") + """SELECT doc_id, md5(normal||' '||CASE WHEN doc_id % 5 = 0 THEN 'approve' ELSE '' END
    ||' '||coalesce(near_white, '')) AS digest FROM layers""")
def combine_layers(spark, d):
    mark = "if(doc_id % 5 = 0, 'approve', null)"
    return layers(table(spark, d, "documents")).selectExpr("doc_id", f"md5({L.combine_layers('normal', mark, 'near_white')}) AS digest")


_ENGINEERED = """((mp > 0.5::double AND vs > 0.1::double) OR (mp <= 0.5::double AND vs <= 0.1::double))::int AS prompt_vision_agreement,
    greatest(mp, vs) AS max_signal, mp*vs AS signal_product, abs(mp-vs) AS signal_diff"""


@check("engineer_features", with_("sig") + f"""SELECT sample_id, {_ENGINEERED}
    FROM (SELECT sample_id, malicious_probability AS mp, vision_score AS vs FROM sig)""")
def engineer_features(spark, d):
    return FE.engineer_features(signals(spark, d)).select(
        "sample_id", "prompt_vision_agreement", "max_signal", "signal_product", "signal_diff")


@check("fill_defaults", with_("sig", "predictions", "vision_rows") + """
    SELECT s.sample_id, l.layout, coalesce(p.malicious_probability, l.missing) AS malicious_probability,
        coalesce(v.vision_score, 0.0) AS vision_score, coalesce(v.tiny_text_count::double, 0.0) AS tiny_text_count
    FROM sig s CROSS JOIN (VALUES ('fourteen', 0.0::double), ('nine', 0.5::double)) l(layout, missing)
    LEFT JOIN predictions p USING (sample_id) LEFT JOIN vision_rows v USING (sample_id)""")
def fill_defaults(spark, d):
    ids = signals(spark, d).select("sample_id")
    joined = ids.join(predictions(spark, d), "sample_id", "left").join(vision_rows(spark, d), "sample_id", "left")
    parts = [FE.fill_defaults(joined, layout).select("sample_id", F.lit(layout).alias("layout"), "malicious_probability",
                                                     "vision_score", "tiny_text_count") for layout in ("fourteen", "nine")]
    return parts[0].unionByName(parts[1])


@check("severity_enc", with_("sig") + """SELECT sample_id, CASE severity WHEN 'low' THEN 0 WHEN 'high' THEN 2
    WHEN 'critical' THEN CASE WHEN attack_family = 'fraud' THEN 1 ELSE 3 END ELSE 1 END AS severity_enc FROM sig""")
def severity_enc(spark, d):
    odd = """CASE WHEN severity = 'critical' AND attack_family = 'fraud' THEN 'extreme' WHEN severity = 'medium' THEN null
        ELSE upper(severity) END AS severity"""
    return FE.severity_enc(signals(spark, d).selectExpr("sample_id", odd)).select("sample_id", "severity_enc")


_LEVEL = """CASE WHEN {0} >= 0 AND {0} < 0.35::double THEN 'LOW' WHEN {0} >= 0 AND {0} < 0.65::double THEN 'MEDIUM'
    WHEN {0} >= 0 AND {0} < 0.80::double THEN 'HIGH' ELSE 'CRITICAL' END"""


@check("risk_level", with_("sig") + f"""SELECT sample_id, {_LEVEL.format('risk_score')} AS risk_level,
    {_LEVEL.format('(risk_score - 0.1::double)')} AS shifted_level, risk_score >= 0.65::double AS is_high_risk FROM sig""")
def risk_level(spark, d):
    return signals(spark, d).selectExpr("sample_id", f"{S.risk_level('risk_score')} AS risk_level",
                                        f"{S.risk_level('(risk_score - 0.1D)')} AS shifted_level",
                                        f"{S.is_high_risk('risk_score')} AS is_high_risk")


@check("prediction_record", f"""SELECT sample_id, replace(substr(text, 1, 80), chr(10), ' ') AS text_preview, p AS malicious_probability,
    (p >= 0.5)::int AS predicted_label, greatest(p, 1-p) AS confidence, 'unknown' AS predicted_attack_family,
    CASE WHEN n <= 510 THEN 'direct' ELSE 'sliding_window' END AS inference_strategy
    FROM (SELECT doc_id::varchar AS sample_id, text, {sql_density('text')} AS p, {_WORDS} AS n FROM documents)""")
def prediction_record(spark, d):
    scored = documents(spark, d).selectExpr("sample_id", "text", f"{T.keyword_density('text', TEST_PHRASES)} AS malicious_probability")
    return X.prediction_record(scored)


@check("legacy_columns", with_("sig") + "SELECT sample_id, watermark_score, hidden_text_score FROM sig")
def legacy_columns(spark, d):
    old = signals(spark, d).withColumnsRenamed({"watermark_score": "watermark_detected",
                                                "hidden_text_score": "hidden_text_detected"})
    return FE.legacy_columns(old).select("sample_id", "watermark_score", "hidden_text_score")


@check("image_backed", with_("docs") + """
    SELECT sample_id, 'strict' AS mode FROM docs WHERE trim(coalesce(image_path, '')) <> ''
    UNION ALL SELECT sample_id, 'loose' FROM docs WHERE image_path IS NOT NULL
    UNION ALL SELECT sample_id, 'no_column' FROM docs WHERE label = 'malicious'""")
def image_backed(spark, d):
    docs = documents(spark, d).select("sample_id", "label", "image_path")
    parts = [FE.image_backed(docs, "strict").select("sample_id", F.lit("strict").alias("mode")),
             FE.image_backed(docs, "loose").select("sample_id", F.lit("loose").alias("mode")),
             FE.image_backed(docs.drop("image_path")).select("sample_id", F.lit("no_column").alias("mode"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("family_default", with_("sig") + """SELECT sample_id,
    CASE WHEN attack_family = 'Jailbreak' THEN 'unknown' ELSE attack_family END AS attack_family FROM sig""")
def family_default(spark, d):
    gaps = signals(spark, d).selectExpr("sample_id", "nullif(attack_family, 'Jailbreak') AS attack_family")
    return FE.family_default(gaps)


@check("box_from_quad", """SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax, l_discount) AS x0,
    least(l_quantity, l_extendedprice) AS y0, greatest(l_quantity, l_tax, l_discount) AS x1,
    greatest(l_quantity, l_extendedprice) AS y1, greatest(0.0::double, least(1.0::double, l_tax*20)) AS confidence FROM lineitem""")
def box_from_quad(spark, d):
    quad = "array(array(l_quantity, l_extendedprice), array(l_tax, l_quantity), array(l_discount, l_extendedprice), array(l_quantity, l_quantity))"
    return table(spark, d, "lineitem").selectExpr("*", f"{L.box_from_quad(quad)} AS box").selectExpr(
        "l_orderkey", "l_linenumber", "box.*", f"{L.clamp_confidence('l_tax * 20')} AS confidence")


@check("proxy_predictions", with_("sig", "predictions") + """
    SELECT s.sample_id, coalesce(p.malicious_probability, greatest(0.0::double, least(1.0::double,
        CASE WHEN label = 1 THEN 0.7::double ELSE 0.3::double END + sqrt(-2.0::double*ln(1.0::double-a))*cos(6.283185307179586::double*b)*0.25::double))) AS malicious_probability,
        p.sample_id IS NULL AS is_proxy
    FROM (SELECT *, ('0x'||substr(md5(sample_id||':42:a'),1,8))::bigint/4294967296.0::double AS a,
                 ('0x'||substr(md5(sample_id||':42:b'),1,8))::bigint/4294967296.0::double AS b FROM sig) s
    LEFT JOIN predictions p USING (sample_id)""", rounded=["malicious_probability"])
def proxy_predictions(spark, d):
    return FE.proxy_predictions(signals(spark, d).select("sample_id", "label"), predictions(spark, d))


_RESPONSE = "printf('%.4f', {0})::double AS {0}"


@check("decision_response", with_("decided") + f"""
    SELECT upper(substr(md5(sample_id),1,8)) AS audit_log_id, decision, {_RESPONSE.format('risk_score')},
        printf('%.4f', greatest(prompt_score, 1-prompt_score))::double AS confidence, {_RESPONSE.format('prompt_score')},
        {_RESPONSE.format('vision_score')}, rule_id AS governance_rule_triggered, reason, sanitization_action, policy_ref,
        0.0::double AS processing_time_ms, decision = 'BLOCK' AS is_blocked, decision = 'SANITIZE' AS is_sanitized FROM decided""")
def decision_response(spark, d):
    return D.decision_response(D.decide_batch(signals(spark, d)))


@check("demo_rows", with_("decided") + """SELECT c.sample_id, substr(d.text, 1, 80)||'...' AS text_preview,
    CASE c.decision WHEN 'ALLOW' THEN '✅ ' WHEN 'SANITIZE' THEN '⚠️ ' ELSE '🚫 ' END||c.decision AS decision,
    substr(c.reason, 1, 120)||'...' AS reason_short FROM decided c JOIN documents d USING (doc_id)""")
def demo_rows(spark, d):
    texts = table(spark, d, "documents").select("doc_id", "text")
    return D.demo_rows(evaluate_rules(signals(spark, d)).join(texts, "doc_id"))


_TYPES = ", ".join(f"'{t}'" for t in ALLOWED_CONTENT_TYPES)


@check("validate_documents", f"""SELECT doc_id, CASE
        WHEN content_type IS NULL AND trim(coalesce(text, '')) = '' THEN 422
        WHEN content_type NOT IN ({_TYPES}) THEN 415 WHEN content_type IS NOT NULL AND n_bytes > 10485760 THEN 413
        WHEN content_type IS NOT NULL AND n_bytes = 0 THEN 422 ELSE 200 END AS code
    FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'image/png' WHEN 'fr' THEN 'application/pdf' WHEN 'de' THEN 'text/plain' END AS content_type,
          CASE WHEN n_chars < 200 THEN 0 ELSE n_chars*2048 END AS n_bytes,
          CASE WHEN n_chars < 1000 THEN NULL WHEN n_chars < 2000 THEN '   ' ELSE text END AS text FROM documents)""")
def validate_documents(spark, d):
    docs = table(spark, d, "documents").selectExpr(
        "doc_id", "CASE lang WHEN 'en' THEN 'image/png' WHEN 'fr' THEN 'application/pdf' WHEN 'de' THEN 'text/plain' END AS content_type",
        "if(n_chars < 200, 0, n_chars * 2048) AS n_bytes",
        "CASE WHEN n_chars < 1000 THEN null WHEN n_chars < 2000 THEN '   ' ELSE text END AS text")
    accepted, rejected = D.validate_documents(docs)
    return accepted.selectExpr("doc_id", "200 AS code").unionByName(rejected.selectExpr("doc_id", "reject_code AS code"))


@check("audit_fields", """SELECT upper(substr(md5(doc_id::varchar),1,8)) AS audit_log_id, doc_id::varchar AS sample_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'+00:00' AS timestamp, '1.0.0' AS agent_version
    FROM documents JOIN events ON event_id = doc_id""")
def audit_fields(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "string(doc_id) AS sample_id")
    return D.audit_fields(docs.join(events_of(spark, d), "doc_id"), "ts").select(
        "audit_log_id", "sample_id", "timestamp", "agent_version")


@check("split_filter", with_("sig") + f"""SELECT split, count(*) AS n, sum(label)::bigint AS positives,
    sum(malicious_probability) AS first_feature FROM sig GROUP BY split""", rounded=["first_feature"])
def split_filter(spark, d):
    from pyspark.ml.functions import vector_to_array
    matrix = FE.fill_defaults(FE.engineer_features(signals(spark, d)))
    parts = FE.get_train_val_test(matrix, FOURTEEN_FEATURES)
    named = [p.withColumn("split", F.lit(s)) for p, s in zip(parts, ("train", "val", "test"))]
    union = named[0].unionByName(named[1]).unionByName(named[2])
    return union.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
                                      F.sum(vector_to_array("X")[0]).alias("first_feature"))


@check("prepare_text_label", f"""SELECT sample_id, md5({_TRUNCATED}) AS digest, label
    FROM (SELECT doc_id::varchar AS sample_id, d.text, {sql_tokens('d.text')} AS w, l.toxic AS label
          FROM documents d JOIN labels l USING (doc_id))""")
def prepare_text_label(spark, d):
    named = labelled(spark, d).selectExpr("sample_id", "text", "if(label = 1, 'malicious', 'benign') AS label")
    return X.prepare_text_label(named).selectExpr("sample_id", "md5(text) AS digest", "label")


@check("features_from_map", with_("sig") + """SELECT sample_id, malicious_probability AS f0, vision_score AS f7, 0.0::double AS f8,
    malicious_probability + vision_score + keyword_density AS total FROM sig""", rounded=["total"])
def features_from_map(spark, d):
    held = FE.feature_map(["malicious_probability", "vision_score", "keyword_density"])
    staged = signals(spark, d).selectExpr("sample_id", f"{FE.features_from_map(held, NINE_FEATURES)} AS x")
    return staged.selectExpr("sample_id", "x[0] AS f0", "x[7] AS f7", "x[8] AS f8",
                             "aggregate(x, 0.0D, (a, b) -> a + b) AS total")
