"""Joins, membership, set operations, split repair and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import RULE_SQL, TEST_PHRASES, pages, pairs, predictions, signals, table, vision_rows, with_
from checks.registry import check
from docguard.fixed_values import FOURTEEN_FEATURES, IMAGE_COLUMNS, NINE_FEATURES
from docguard.functions.signals import risk_level as risk_level_of
from docguard.operators import features as FE
from docguard.operators import layouts as LO
from docguard.operators import quality as Q
from docguard.operators import splits as SP
from docguard.operators.rules import evaluate_rules, load_rules, rule_hits
from docguard.plans.feature_matrix import build_feature_matrix, feature_matrix
from docguard.session import new_path


@check("join_labels_splits", with_("pairs") + "SELECT sample_id, label, original_split AS split, attack_family FROM pairs")
def join_labels_splits(spark, d):
    df = pairs(spark, d)
    return FE.join_labels_splits(df.select("sample_id", "label", "attack_family"),
                                 df.select("sample_id", F.col("original_split").alias("split")))


_FUSED = """SELECT s.sample_id, s.label, s.split, s.attack_family, coalesce(p.malicious_probability, 0.0) AS malicious_probability,
    coalesce(v.vision_score, 0.0) AS vision_score, coalesce(v.keyword_density, 0.0) AS keyword_density,
    coalesce(v.total_boxes::double, 0.0) AS total_boxes, coalesce(v.ocr_confidence, 0.0) AS ocr_confidence,
    coalesce(v.hidden_text_score, 0.0) AS hidden_text_score
    FROM sig s LEFT JOIN predictions p USING (sample_id) LEFT JOIN vision_rows v USING (sample_id)"""
_FUSED_COLUMNS = ["sample_id", "label", "split", "attack_family", "malicious_probability", "vision_score",
                  "keyword_density", "total_boxes", "ocr_confidence", "hidden_text_score"]


def _labels(spark, d):
    return signals(spark, d).select("sample_id", "label", "split", "attack_family")


@check("fuse_sources", with_("sig", "predictions", "vision_rows") + _FUSED)
def fuse_sources(spark, d):
    return FE.fuse_sources(_labels(spark, d), predictions(spark, d), vision_rows(spark, d)).select(*_FUSED_COLUMNS)


_MATRIX = f"""SELECT *, ((malicious_probability > 0.5::double) = (vision_score > 0.1::double))::int AS prompt_vision_agreement,
    greatest(malicious_probability, vision_score) AS max_signal FROM ({_FUSED})"""


@check("feature_matrix", with_("sig", "predictions", "vision_rows") + _MATRIX)
def feature_matrix_query(spark, d):
    master = _labels(spark, d)
    built = feature_matrix(master.drop("split"), master.select("sample_id", F.col("split").alias("corrected_split")),
                           predictions(spark, d), vision_rows(spark, d))
    return built.select(*_FUSED_COLUMNS, "prompt_vision_agreement", "max_signal")


@check("build_feature_matrix", with_("sig", "predictions", "vision_rows") + f"""
    SELECT split, count(*) AS n, sum(prompt_vision_agreement)::bigint AS agreeing, avg(max_signal) AS mean_max
    FROM ({_MATRIX}) GROUP BY split""", rounded=["mean_max"])
def build_feature_matrix_query(spark, d):
    master = _labels(spark, d)
    stored = build_feature_matrix(
        master.drop("split"), master.select("sample_id", F.col("split").alias("corrected_split")), predictions(spark, d),
        vision_rows(spark, d), new_path(spark, "matrix"), new_path(spark, "summary"))
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_vision_agreement").alias("agreeing"),
                                       F.avg("max_signal").alias("mean_max"))


def risk_rows(spark, d):
    return signals(spark, d).selectExpr("sample_id", "risk_score", f"{risk_level_of('risk_score')} AS risk_level")


_LEVEL = """CASE WHEN risk_score < 0.35::double THEN 'LOW' WHEN risk_score < 0.65::double THEN 'MEDIUM'
    WHEN risk_score < 0.80::double THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level"""


@check("join_risk", with_("sig") + f"SELECT sample_id, vision_score, risk_score, {_LEVEL} FROM sig")
def join_risk(spark, d):
    return FE.join_risk(signals(spark, d).select("sample_id", "vision_score"), risk_rows(spark, d))


@check("join_eval", with_("decided") + f"SELECT sample_id, vision_score, risk_score, {_LEVEL}, decision, rule_id FROM decided")
def join_eval(spark, d):
    return FE.join_eval(signals(spark, d).select("sample_id", "vision_score"), risk_rows(spark, d),
                        evaluate_rules(signals(spark, d)))


@check("membership_flag", with_("sig", "predictions", "pairs") + """
    SELECT s.sample_id, (p.sample_id IS NOT NULL)::int AS has_prediction, s.split AS original_split
    FROM sig s LEFT JOIN predictions p USING (sample_id)""")
def membership_flag(spark, d):
    sig = signals(spark, d)
    flagged = SP.flag_membership(sig.select("sample_id"), predictions(spark, d), "has_prediction")
    # train is listed first and holds all ids: the later source must win
    sources = {"train": sig, "val": sig.filter("split = 'val'"), "test": sig.filter("split = 'test'")}
    return SP.original_split(flagged, sources)


@check("missing_predictions", with_("sig", "predictions") + """
    SELECT s.sample_id, s.label FROM sig s ANTI JOIN predictions p USING (sample_id)""")
def missing_predictions(spark, d):
    return FE.missing_predictions(signals(spark, d).select("sample_id", "label"), predictions(spark, d))


@check("overlay_image_features", with_("sig", "vision_rows") + """
    SELECT s.sample_id, s.keyword_density, (v.sample_id IS NOT NULL)::int AS has_image,
        coalesce(v.ocr_confidence, 0.0) AS ocr_confidence, coalesce(v.tiny_text_count::double, 0.0) AS tiny_text_count,
        coalesce(v.hidden_text_score, 0.0) AS hidden_text_detected, coalesce(v.watermark_score, 0.0) AS watermark_detected,
        0.0::double AS spatial_spread
    FROM sig s LEFT JOIN vision_rows v USING (sample_id)""")
def overlay_image_features(spark, d):
    image = vision_rows(spark, d).drop("keyword_density").withColumnsRenamed(
        {"hidden_text_score": "hidden_text_detected", "watermark_score": "watermark_detected"})
    merged = FE.overlay_image_features(signals(spark, d).select("sample_id", "keyword_density"), image, IMAGE_COLUMNS)
    return merged.select("sample_id", "keyword_density", "has_image", "ocr_confidence", "tiny_text_count",
                         "hidden_text_detected", "watermark_detected", "spatial_spread")


_HITS = " UNION ALL ".join(
    f"SELECT sample_id, '{r['id']}' AS rule_id, {r['priority']}::int AS priority FROM ctx WHERE {RULE_SQL[r['id']]}"
    for r in load_rules())


@check("rule_hits", with_("ctx") + _HITS)
def rule_hits_query(spark, d):
    return rule_hits(signals(spark, d))


@check("union_predictions", with_("sig", "predictions") + """
    SELECT sample_id, malicious_probability, false AS is_proxy FROM predictions
    UNION ALL SELECT s.sample_id, s.risk_score, true FROM sig s ANTI JOIN predictions p USING (sample_id)""")
def union_predictions(spark, d):
    missing = FE.missing_predictions(signals(spark, d), predictions(spark, d))
    stand_in = missing.select("sample_id", F.col("risk_score").alias("malicious_probability"), F.lit(True).alias("is_proxy"))
    return FE.union_predictions(predictions(spark, d), stand_in)


@check("id_intersect", with_("predictions", "vision_rows")
       + "SELECT sample_id FROM predictions INTERSECT SELECT sample_id FROM vision_rows")
def id_intersect(spark, d):
    return SP.id_intersect(predictions(spark, d), vision_rows(spark, d))


@check("id_except", with_("predictions", "vision_rows")
       + "SELECT sample_id FROM predictions EXCEPT SELECT sample_id FROM vision_rows")
def id_except(spark, d):
    return SP.id_except(predictions(spark, d), vision_rows(spark, d))


# --- splits ------------------------------------------------------------------------------

_FORKED = """SELECT sample_id, 'train' AS split FROM predictions UNION ALL SELECT sample_id, 'val' FROM vision_rows
    UNION ALL SELECT sample_id, split FROM sig WHERE split = 'test'"""


def _forked(spark, d):
    """Three sources that share ids."""
    return predictions(spark, d).select("sample_id", F.lit("train").alias("split")) \
        .unionByName(vision_rows(spark, d).select("sample_id", F.lit("val").alias("split"))) \
        .unionByName(signals(spark, d).filter("split = 'test'").select("sample_id", "split"))


_OVERLAP = """SELECT a.split||'-'||b.split AS pair, count(*) AS n_overlap FROM forked a JOIN forked b USING (sample_id)
    WHERE a.split||'-'||b.split IN ('train-val', 'train-test', 'val-test') GROUP BY 1"""


@check("split_overlap", with_("sig", "predictions", "vision_rows", forked=_FORKED) + _OVERLAP)
def split_overlap(spark, d):
    return SP.split_overlap(_forked(spark, d))


@check("validate_splits", with_("sig", "predictions", "vision_rows", forked=_FORKED, o=_OVERLAP) + """
    SELECT 'disjoint_splits' AS "check", sum(n_overlap) = 0 AS passed,
        'train-val='||max(n_overlap) FILTER (pair = 'train-val')||', train-test='||max(n_overlap) FILTER (pair = 'train-test')
        ||', val-test='||max(n_overlap) FILTER (pair = 'val-test') AS detail FROM o""")
def validate_splits(spark, d):
    return Q.validate_splits(_forked(spark, d))


@check("group_split", with_("resplit") + "SELECT sample_id, group_key, corrected_split FROM resplit")
def group_split(spark, d):
    return SP.group_split(pairs(spark, d)).select("sample_id", "group_key", "corrected_split")


def _resplit(spark, d):
    return SP.group_split(pairs(spark, d))


@check("class_balance", with_("resplit") + """
    SELECT corrected_split AS split, count(*) AS n, count(*) FILTER (label = 'benign') AS benign,
        count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign')::double/count(*) AS benign_ratio,
        abs(count(*) FILTER (label = 'benign')::double/count(*) - 0.5) < 0.01 AS balanced FROM resplit GROUP BY 1""",
       rounded=["benign_ratio"])
def class_balance(spark, d):
    return SP.class_balance(_resplit(spark, d), "corrected_split")


@check("group_sizes", """SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size
    FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""", rounded=["mean_size"])
def group_sizes(spark, d):
    return SP.group_sizes(table(spark, d, "events"), "user_id")


@check("group_leakage", with_("resplit") + """
    SELECT 'before' AS stage, count(*) AS n_groups, count(*) FILTER (k > 1) AS leaked_groups,
        count(*) FILTER (k > 1)*100.0::double/count(*) AS leaked_pct
    FROM (SELECT group_key, count(DISTINCT original_split) AS k FROM resplit GROUP BY 1)
    UNION ALL SELECT 'after', count(*), count(*) FILTER (k > 1), count(*) FILTER (k > 1)*100.0::double/count(*)
    FROM (SELECT group_key, count(DISTINCT corrected_split) AS k FROM resplit GROUP BY 1)""", rounded=["leaked_pct"])
def group_leakage(spark, d):
    df = _resplit(spark, d)
    before = SP.group_leakage(df, "original_split").select(F.lit("before").alias("stage"), "*")
    return before.unionByName(SP.group_leakage(df, "corrected_split").select(F.lit("after").alias("stage"), "*"))


@check("duplicate_ids", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def duplicate_ids(spark, d):
    return SP.duplicate_ids(table(spark, d, "orders"), "o_custkey")


@check("split_proportions", with_("resplit") + """
    SELECT corrected_split AS split, count(*) AS n, printf('%.2f', count(*)*100.0::double/(SELECT count(*) FROM resplit))::double AS pct
    FROM resplit GROUP BY 1""")
def split_proportions(spark, d):
    return SP.split_proportions(_resplit(spark, d), "corrected_split")


_REPORT_PARTS = []
for _i, _s in enumerate(("train", "val", "test")):
    _w = f"corrected_split = '{_s}'"
    _REPORT_PARTS += [
        (4 + 4 * _i, f"{_s}_benign_ratio", f"printf('%.4f', count(*) FILTER ({_w} AND label = 'benign')::double/count(*) FILTER ({_w}))::double"),
        (5 + 4 * _i, f"{_s}_total", f"count(*) FILTER ({_w})"),
        (6 + 4 * _i, f"{_s}_benign", f"count(*) FILTER ({_w} AND label = 'benign')"),
        (7 + 4 * _i, f"{_s}_malicious", f"count(*) FILTER ({_w} AND label = 'malicious')"),
        (16 + _i, f"{_s}_pct", f"printf('%.2f', count(*) FILTER ({_w})*100.0::double/count(*))::double"),
    ]
_REPORT = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{n}' AS check_name, ({q})::double AS value FROM resplit" for i, n, q in [
        (2, "total_rows", "count(*)"), (3, "unique_sample_ids", "count(DISTINCT sample_id)"), *_REPORT_PARTS])


@check("verification_report", with_("resplit") + _REPORT + """ UNION ALL
    SELECT 1, 'group_leakage_count', count(*)::double FROM (SELECT group_key FROM resplit GROUP BY 1 HAVING count(DISTINCT corrected_split) > 1)""")
def verification_report(spark, d):
    return SP.verification_report(_resplit(spark, d))


# --- gates -------------------------------------------------------------------------------


@check("validate_feature_matrix", with_("sig") + """
    SELECT * FROM (VALUES ('columns', true, ''), ('no_null_features', true, '0'), ('unique_ids', true, '0'),
        ('vision_score_range', true, '0'), ('malicious_probability_range', true, '0'), ('label_values', true, '0'),
        ('split_values', true, '0'),
        ('label_balance', true, (SELECT CASE WHEN least(sum(label), count(*)-sum(label))/greatest(sum(label), count(*)-sum(label)) < 0.3
                                 THEN 'imbalanced' ELSE 'ok' END FROM sig))) t("check", passed, detail)""")
def validate_feature_matrix(spark, d):
    matrix = FE.engineer_features(FE.fuse_sources(_labels(spark, d), predictions(spark, d), vision_rows(spark, d)))
    return Q.validate_feature_matrix(matrix)


@check("validate_feature_matrix_faults", with_("sig", "predictions", "vision_rows") + """
    SELECT * FROM (VALUES ('columns', true, ''),
        ('no_null_features', false, (SELECT count(*)::varchar FROM sig s WHERE NOT (s.sample_id IN (SELECT sample_id FROM predictions)
            AND s.sample_id IN (SELECT sample_id FROM vision_rows)))),
        ('unique_ids', true, '0'),
        ('vision_score_range', false, (SELECT (count(*) - (SELECT count(*) FROM vision_rows))::varchar FROM sig)),
        ('malicious_probability_range', false, (SELECT (count(*) - (SELECT count(*) FROM predictions))::varchar FROM sig)),
        ('label_values', true, '0'), ('split_values', true, '0')) t("check", passed, detail)""")
def validate_feature_matrix_faults(spark, d):
    raw = _labels(spark, d).join(predictions(spark, d), "sample_id", "left").join(vision_rows(spark, d), "sample_id", "left")
    rest = {c: F.lit(0.0) for c in FOURTEEN_FEATURES if c not in raw.columns}
    return Q.validate_feature_matrix(raw.withColumns(rest)).filter("check <> 'label_balance'")


@check("validate_vision", with_("vision_out") + """SELECT * FROM (VALUES ('columns', true, ''), ('float_types', true, ''), ('no_null', true, '0'),
    ('vision_score_range', true, '0'),
    ('read_rows', true, (SELECT count(*) FILTER (ocr_confidence > 0)||'/'||count(*) FROM vision_out))) t("check", passed, detail)""")
def validate_vision(spark, d):
    return Q.validate_vision(LO.vision_features(pages(spark, d), TEST_PHRASES))


@check("verify_splits", with_("resplit") + """
    SELECT * FROM (VALUES ('group_leakage', true, '0'), ('total_rows', true, (SELECT count(*)::varchar FROM resplit)),
        ('unique_ids', true, (SELECT count(DISTINCT sample_id)::varchar FROM resplit))) t("check", passed, detail)""")
def verify_splits(spark, d):
    expected = table(spark, d, "documents").count()
    return Q.verify_splits(_resplit(spark, d), expected)


@check("verify_roundtrip", """SELECT * FROM (VALUES ('row_count', true, (SELECT count(*)::varchar FROM documents)),
    ('columns', true, ''), ('no_null', true, '0')) t("check", passed, detail)""")
def verify_roundtrip(spark, d):
    nine = FE.fill_defaults(signals(spark, d), "nine")
    path = new_path(spark, "features")
    nine.write.parquet(path)
    return Q.verify_roundtrip(nine, spark.read.parquet(path), NINE_FEATURES)
