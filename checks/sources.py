"""Scans, sinks, inventories and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    SPLIT, TEST_PHRASES, documents, events_of, signals, sql_density, table, with_,
)
from checks.registry import check
from docguard.functions.signals import audit_id, has_path
from docguard.functions.text import keyword_density
from docguard.operators import decisions as D
from docguard.operators.metrics import latency_stats as exact_latency_stats
from docguard.operators.metrics import rule_counts
from docguard.operators.profile import dataset_card, run_log
from docguard.operators.rules import evaluate_rules, load_rules, rules_df
from docguard.session import new_path
from docguard.sources import images, schemas, tables


def _split_tables(spark, folder):
    """The documents written as three split tables; the folder they are in."""
    root = new_path(spark, "splits")
    docs = documents(spark, folder).selectExpr("sample_id", "label", "n_chars", "attack_family",
                                               f"replace({SPLIT}, 'val', 'validation') AS _split")
    docs.write.partitionBy("_split").parquet(root + "/all")
    for name in ("train", "validation", "test"):
        part = spark.read.parquet(f"{root}/all/_split={name}")
        part.write.parquet(f"{root}/{name}.parquet")
    return root


_SPLITS = with_("docs", "sig") + """SELECT d.sample_id, d.label, d.n_chars, s.split
    FROM docs d JOIN sig s USING (doc_id)"""


@check("scan_splits", _SPLITS)
def scan_splits(spark, d):
    return tables.read_splits(spark, _split_tables(spark, d)).select("sample_id", "label", "n_chars", "split")


@check("scan_csv_typed", "SELECT lpad(doc_id::varchar, 8, '0') AS sample_id, source AS label, lang AS attack_family FROM documents")
def scan_csv_typed(spark, d):
    path = new_path(spark, "labels_csv")
    docs = table(spark, d, "documents")
    tables.write_csv(docs.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("sample_id"),
                                 F.col("source").alias("label"), F.col("lang").alias("attack_family")), path)
    return tables.read_csv(spark, path, schemas.LABELS)


@check("scan_pruned", "SELECT doc_id, n_chars FROM documents")
def scan_pruned(spark, d):
    return tables.read_cols(spark, f"{d}/documents.parquet", ["doc_id", "n_chars"])


@check("scan_with_fallback", with_("docs", "sig") + """
    SELECT d.sample_id, d.n_chars, s.split, 'original' AS origin FROM docs d JOIN sig s USING (doc_id)
    UNION ALL
    SELECT d.sample_id, d.n_chars, CASE WHEN d.lang = 'en' THEN 'train' ELSE 'val' END, 'corrected' FROM docs d""")
def scan_with_fallback(spark, d):
    root = _split_tables(spark, d)
    path = root + "/corrected_splits"
    before = tables.load_splits(spark, path, root).select("sample_id", "n_chars", "split", F.lit("original").alias("origin"))
    corrected = documents(spark, d).select(
        "sample_id", F.when(F.col("lang") == "en", "train").otherwise("validation").alias("corrected_split"))
    tables.write_csv(corrected, path)
    after = tables.load_splits(spark, path, root).select("sample_id", "n_chars", "split", F.lit("corrected").alias("origin"))
    return before.unionByName(after)


def audit_rows(spark, d):
    """Audit records of all documents, stamped by the events table."""
    joined = signals(spark, d).join(events_of(spark, d), "doc_id")
    return D.decide_batch(joined, at="ts")


AUDIT_SQL = """SELECT upper(substr(md5(c.sample_id),1,8)) AS audit_log_id, c.sample_id,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f')||'+00:00' AS timestamp, c.decision, c.risk_score, 'MEDIUM' AS risk_level,
    c.prompt_score, c.vision_score, greatest(c.prompt_score, 1-c.prompt_score) AS confidence,
    c.rule_id AS governance_rule_triggered, c.reason, c.sanitization_action, c.policy_ref,
    c.raw_family AS attack_family_predicted, 0.0::double AS vision_ms, 0.0::double AS prompt_ms, 0.0::double AS risk_ms,
    0.0::double AS governance_ms, e.value AS total_ms, NULL::varchar AS vision_error, NULL::varchar AS prompt_error,
    '1.0.0' AS agent_version
    FROM decided c JOIN events e ON e.event_id = c.doc_id"""


def audit_log(spark, d):
    path = new_path(spark, "audit_log")
    tables.append_audit(audit_rows(spark, d), path, fresh=True)
    return tables.read_audit(spark, path)


@check("scan_audit", with_("decided", audit=AUDIT_SQL)
       + "SELECT audit_log_id, sample_id, timestamp, decision, governance_rule_triggered, vision_error FROM audit")
def scan_audit(spark, d):
    return audit_log(spark, d).select("audit_log_id", "sample_id", "timestamp", "decision",
                                      "governance_rule_triggered", "vision_error")


@check("sink_audit_append", with_("decided", audit=AUDIT_SQL) + "SELECT *, 2::bigint AS n FROM audit")
def sink_audit_append(spark, d):
    path = new_path(spark, "audit_log")
    rows = audit_rows(spark, d)
    tables.append_audit(rows, path, fresh=True)
    tables.append_audit(rows, path)
    again = tables.read_audit(spark, path)
    return again.groupBy(*again.columns).agg(F.count(F.lit(1)).alias("n"))


_RULES = [(r["id"], r["name"], r["priority"], r["action"], r["severity"], r["policy_ref"]) for r in load_rules()]
_RULE_VALUES = ", ".join("('" + "', '".join([i, n, str(p), a, s, ref]) + "')" for i, n, p, a, s, ref in _RULES)


@check("rules_table", with_("decided", hits="SELECT rule_id, count(*) AS n_decided FROM decided GROUP BY rule_id") + f"""
    SELECT v.id, v.name, v.priority::int AS priority, v.action, v.severity, v.policy_ref,
           coalesce(h.n_decided, 0)::bigint AS n_decided
    FROM (VALUES {_RULE_VALUES}) v(id, name, priority, action, severity, policy_ref)
    LEFT JOIN hits h ON h.rule_id = v.id""")
def rules_table(spark, d):
    decided = rule_counts(evaluate_rules(signals(spark, d))).withColumnsRenamed({"rule_id": "id", "n": "n_decided"})
    return rules_df(spark, load_rules()).join(decided, "id", "left").fillna(0, ["n_decided"])


@check("sink_parquet", with_("sig") + "SELECT sample_id, split, risk_score, vision_score FROM sig")
def sink_parquet(spark, d):
    path = new_path(spark, "matrix")
    tables.write_parquet(signals(spark, d), path, ["split"])
    return spark.read.parquet(path).select("sample_id", "split", "risk_score", "vision_score") \
        .withColumn("sample_id", F.col("sample_id").cast("string"))


@check("sink_csv", with_("sig") + "SELECT sample_id, risk_score, split FROM sig")
def sink_csv(spark, d):
    path = new_path(spark, "risk_scores_csv")
    tables.write_csv(signals(spark, d).select("sample_id", "risk_score", "split"), path)
    return tables.read_csv(spark, path, "sample_id string, risk_score double, split string")


@check("dataset_card", with_("docs", "sig", j="SELECT d.*, s.split FROM docs d JOIN sig s USING (doc_id)") + """
    SELECT count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_samples,
        count(*) FILTER (split = 'val') AS val_samples, count(*) FILTER (split = 'test') AS test_samples,
        count(image_path) AS image_backed_samples, count(*) FILTER (label = 'benign') AS benign,
        count(*) FILTER (label = 'malicious') AS malicious,
        (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT attack_family AS f FROM docs)) AS families,
        'sample_id,label,attack_family,image_path,split' AS column_names, 42 AS random_seed
    FROM j""")
def dataset_card_query(spark, d):
    docs = documents(spark, d).selectExpr("*", f"{SPLIT} AS split")
    card = dataset_card(docs.select("sample_id", "label", "attack_family", "image_path", "split"))
    return card.select(
        "total_samples", "train_samples", "val_samples", "test_samples", "image_backed_samples",
        F.col("label_distribution")["benign"].alias("benign"), F.col("label_distribution")["malicious"].alias("malicious"),
        F.array_join(F.array_sort("attack_families"), ",").alias("families"),
        F.array_join("columns", ",").alias("column_names"), "random_seed")


@check("run_log", with_("docs") + """
    SELECT count(*) AS total_samples, count(*) FILTER (trim(coalesce(image_path, '')) <> '') AS image_samples,
        'text' AS text_col_used, false AS gpu_used FROM docs""")
def run_log_query(spark, d):
    flagged = documents(spark, d).selectExpr(f"int({has_path('image_path')}) AS has_image")
    path = new_path(spark, "run_log")
    tables.write_record(run_log(flagged, {"text_col_used": "text", "gpu_used": False}), path)
    return spark.read.schema("total_samples bigint, image_samples bigint, text_col_used string, gpu_used boolean").json(path)


@check("resume_incremental", f"""
    SELECT doc_id, {sql_density('text')} AS keyword_density, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run FROM documents""")
def resume_incremental(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    path = new_path(spark, "resumed")

    def run(number):
        return lambda rest: rest.selectExpr("doc_id", f"{keyword_density('text', TEST_PHRASES)} AS keyword_density",
                                            f"{number} AS run")

    tables.resume(docs.filter(F.col("lang") == "en"), path, "doc_id", run(1))
    return tables.resume(docs, path, "doc_id", run(2))


@check("cache_or_compute", with_("sig") + "SELECT split, count(*) AS n, 1 AS version FROM sig GROUP BY split")
def cache_or_compute(spark, d):
    path = new_path(spark, "cached")
    sizes = signals(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    tables.cached(spark, path, lambda: sizes.withColumn("version", F.lit(1)))
    return tables.cached(spark, path, lambda: sizes.withColumn("version", F.lit(2)))


def _resolved(spark, d):
    """Files exist for the longer documents, in another folder than the paths say."""
    docs = documents(spark, d)
    files = table(spark, d, "documents").filter("n_chars >= 1000").select(
        F.concat(F.lit("/mnt/images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return images.resolve_images(docs, files)


_RESOLVED = """SELECT *, trim(coalesce(image_path, '')) <> '' AS has_path,
    CASE WHEN trim(coalesce(image_path, '')) <> '' AND n_chars >= 1000 THEN '/mnt/images/'||doc_id||'.png' END AS resolved_path
    FROM docs"""


@check("image_resolution", with_("docs", r=_RESOLVED) + "SELECT sample_id, image_path, resolved_path FROM r")
def image_resolution(spark, d):
    return _resolved(spark, d).select("sample_id", "image_path", "resolved_path")


@check("image_inventory", with_("docs", r=_RESOLVED) + """
    SELECT count(*) FILTER (has_path) AS image_backed, count(*) FILTER (has_path AND resolved_path IS NOT NULL) AS found,
           count(*) FILTER (has_path AND resolved_path IS NULL) AS missing FROM r""")
def image_inventory(spark, d):
    return images.image_inventory(_resolved(spark, d))


@check("missing_examples", with_("docs", r=_RESOLVED) + """
    SELECT image_path FROM r WHERE has_path AND resolved_path IS NULL ORDER BY image_path LIMIT 5""")
def missing_examples(spark, d):
    return images.missing_examples(_resolved(spark, d))


@check("recent_decisions", with_("decided", audit=AUDIT_SQL) + """
    SELECT timestamp, sample_id, decision, risk_score, prompt_score, vision_score, governance_rule_triggered, reason
    FROM audit ORDER BY timestamp DESC, audit_log_id LIMIT 5""")
def recent_decisions(spark, d):
    return D.recent_decisions(audit_log(spark, d))


@check("audit_lookup", with_("decided", audit=AUDIT_SQL)
       + "SELECT sample_id, decision, total_ms FROM audit WHERE audit_log_id = upper(substr(md5('7'),1,8))")
def audit_lookup(spark, d):
    wanted = spark.range(1).selectExpr(audit_id("'7'")).first()[0]
    return D.audit_lookup(audit_log(spark, d), wanted).select("sample_id", "decision", "total_ms")


def audit_table(spark, d):
    path = new_path(spark, "audit_table")
    tables.append_audit_table(audit_rows(spark, d), path, fresh=True)
    return path


@check("audit_table_lookup", with_("decided", audit=AUDIT_SQL)
       + "SELECT sample_id, decision, total_ms FROM audit WHERE audit_log_id = upper(substr(md5('7'),1,8))")
def audit_table_lookup(spark, d):
    wanted = spark.range(1).selectExpr(audit_id("'7'")).first()[0]
    return D.audit_lookup(tables.read_audit_table(spark, audit_table(spark, d)), wanted).select("sample_id", "decision", "total_ms")


@check("audit_table_recent", with_("decided", audit=AUDIT_SQL) + """
    SELECT timestamp, sample_id, decision, risk_score, prompt_score, vision_score, governance_rule_triggered, reason
    FROM audit ORDER BY timestamp DESC, audit_log_id LIMIT 5""")
def audit_table_recent(spark, d):
    return D.recent_decisions(tables.newest_audit(spark, audit_table(spark, d)))


@check("resume_without_keys", f"""
    SELECT doc_id, text, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS doc_id, text, lang FROM documents)""")
def resume_without_keys(spark, d):
    """Rows without a key are processed once, too."""
    docs = table(spark, d, "documents").selectExpr("if(doc_id % 3 = 0, null, doc_id) AS doc_id", "text", "lang", "doc_id AS place")
    path = new_path(spark, "resumed")

    def run(number):
        return lambda rest: rest.selectExpr("doc_id", "text", f"{number} AS run")

    tables.resume(docs.filter("lang = 'en'"), path, "doc_id", run(1))
    tables.resume(docs, path, "doc_id", run(2))
    return tables.resume(docs, path, "doc_id", run(3))


@check("latency_stats", with_("decided", audit=AUDIT_SQL) + """
    SELECT avg(total_ms) AS mean, max(total_ms) AS max, quantile_cont(total_ms, 0.95) AS p95,
           quantile_cont(total_ms, 0.99) AS p99 FROM audit""", rounded=["mean", "p95", "p99"])
def latency_stats(spark, d):
    return exact_latency_stats(audit_rows(spark, d))


@check("union_splits", _SPLITS)
def union_splits(spark, d):
    docs = documents(spark, d).selectExpr("sample_id", "label", "n_chars", f"{SPLIT} AS split")
    return tables.union_splits([docs.filter(f"split = '{name}'") for name in ("train", "val", "test")])
