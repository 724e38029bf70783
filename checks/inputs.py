"""Inputs of the operators, derived row by row from the given tables, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docguard.fixed_values import DEFAULT_ALLOW, DEFAULT_RULES
from docguard.functions.numbers import listed, num, uniform

# Words the test texts really contain; the default lists do not occur in them.
TEST_PHRASES = ["trash", "pathetic", "idiot", "worthless", "disgusting",
                "stupid", "clown", "scum", "loser", "moron"]
FAMILIES = ["Data Exfiltration", "PII extraction", "claim manipulation", "fraud",
            "Instruction Override", "Jailbreak", "unknown"]
SEVERITIES = ["low", "medium", "high", "critical"]
PAGE_HEIGHT = 2000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def u(tag: str) -> str:
    return uniform("doc_id", tag)


def _pick(options: list[str], at: str) -> str:
    return f"element_at(array({listed(options)}), int(floor({at} * {len(options)})) + 1)"


SPLIT = f"CASE WHEN {u('s10')} < 0.8D THEN 'train' WHEN {u('s10')} < 0.9D THEN 'val' ELSE 'test' END"
_HIDDEN = f"if({u('s3')} >= 0.9D, 1.0D, 0.0D) AS hidden_text_score"
_PATH = (f"CASE WHEN {u('img')} < 0.25D THEN concat('/data/IMAGES/', doc_id, '.png') "
         f"WHEN {u('img')} < 0.5D THEN '' WHEN {u('img')} < 0.75D THEN '  ' END")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with the label, family and path columns of a split table."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").selectExpr(
        "*", "string(doc_id) AS sample_id", "if(toxic = 1, 'malicious', 'benign') AS label", "lang AS attack_family",
        f"{_PATH} AS image_path", f"{_pick(SEVERITIES, u('s9'))} AS severity")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a label, with label as a number."""
    labels = table(spark, folder, "labels").selectExpr("doc_id", "toxic AS label")
    return table(spark, folder, "documents").join(labels, "doc_id").selectExpr("*", "string(doc_id) AS sample_id")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """One row of scores per document."""
    docs = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id", "string(doc_id) AS sample_id", f"{u('s1')} AS risk_score", f"{u('s2')} AS vision_score", _HIDDEN,
        f"{u('s4')} AS keyword_density", f"{u('s5')} AS footer_text_density", f"{u('s6')} AS watermark_score",
        f"{u('s7')} AS malicious_probability", f"{_pick(FAMILIES, u('s8'))} AS attack_family",
        f"{_pick(SEVERITIES, u('s9'))} AS severity", "coalesce(toxic, int(doc_id % 2)) AS label", f"{SPLIT} AS split")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt scores, known for the documents of the labels table only."""
    return table(spark, folder, "labels").selectExpr("string(doc_id) AS sample_id", f"{u('s7')} AS malicious_probability")


def vision_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Vision scores, known for the documents with an image only."""
    return table(spark, folder, "documents").select("doc_id").filter(f"{u('img')} < 0.25D").selectExpr(
        "string(doc_id) AS sample_id", f"{u('s2')} AS vision_score", _HIDDEN, f"{u('s4')} AS keyword_density",
        f"{u('s5')} AS footer_text_density", f"{u('s6')} AS watermark_score", f"{u('s11')} AS ocr_confidence",
        f"int(floor({u('s12')} * 12)) AS tiny_text_count", f"int(floor({u('s13')} * 40)) AS total_boxes",
        f"int(floor({u('s14')} * 400)) AS total_words")


def _y0(pos: str, n: str) -> str:
    return f"({num(PAGE_HEIGHT)} * ({pos} + 1) / ({n} + 1))"


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """One box per non-blank line of a text."""
    lines = table(spark, folder, "documents").selectExpr(
        "doc_id", "size(split(text, '\\n')) AS n", "posexplode(split(text, '\\n')) AS (pos, text)")
    key = "concat_ws(':', doc_id, pos)"
    return lines.filter("trim(text) <> ''").selectExpr(
        "string(doc_id) AS sample_id", "pos", "text", f"{uniform(key, 'c')} AS confidence", f"{_y0('pos', 'n')} AS y0",
        f"{_y0('pos', 'n')} + 60.0D * {uniform(key, 'h')} AS y1", f"{num(PAGE_HEIGHT)} AS height")


def _nested_boxes() -> str:
    """The same boxes as one array inside the document's row: no explode."""
    lines, key = "_lines", "concat_ws(':', doc_id, pos)"
    y0 = _y0("pos", "_n_lines")
    box = (f"named_struct('pos', pos, 'text', line, 'confidence', {uniform(key, 'c')}, "
           f"'y0', {y0}, 'y1', {y0} + 60.0D * {uniform(key, 'h')})")
    return f"filter(transform({lines}, (line, pos) -> {box}), b -> trim(b.text) <> '')"


LAYERS = ["text AS normal", "concat(text, if(doc_id % 5 = 0, ' approve claim', '')) AS high_contrast",
          "CASE doc_id % 7 WHEN 0 THEN 'hidden text' WHEN 1 THEN 'abc' END AS near_white"]


def layers(df: DataFrame) -> DataFrame:
    """Add the text layers of a page image."""
    return df.selectExpr("*", *LAYERS)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as page images: nested boxes, layers, path, and an error where it cannot be read."""
    error = f"if(image_path IS NOT NULL AND {u('err')} < 0.1D, 'cannot read image', null)"
    # a file of few row groups is read by few tasks, however large; what follows is costly for each row
    docs = documents(spark, folder).repartition("doc_id")
    lined = docs.selectExpr("*", "split(text, '\\n') AS _lines").selectExpr("*", "size(_lines) AS _n_lines")
    return lined.selectExpr(*docs.columns, *LAYERS, f"{_nested_boxes()} AS boxes", f"{num(PAGE_HEIGHT)} AS height",
                            f"{error} AS error")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that come in pairs of one benign and one malicious sample per group."""
    name, number = "if(doc_id % 2 = 1, 'malicious', 'benign')", "lpad(string(doc_id div 2), 8, '0')"
    return table(spark, folder, "documents").selectExpr(
        f"concat({name}, '_', {number}) AS sample_id", f"{number} AS group_key", f"{name} AS label",
        f"{SPLIT} AS original_split", "lang AS attack_family")


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("event_id AS doc_id", "ts", "value AS total_ms")


# --- the same in SQL ---------------------------------------------------------------------


def su(tag: str, key: str = "doc_id") -> str:
    return f"(('0x'||substr(md5({key}||':{tag}'),1,8))::bigint/4294967296.0::double)"


def _sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _sql_pick(options: list[str], tag: str) -> str:
    return f"list_extract({_sql_list(options)}, (floor({su(tag)}*{len(options)})+1)::int)"


_SPLIT_SQL = f"CASE WHEN {su('s10')} < 0.8::double THEN 'train' WHEN {su('s10')} < 0.9::double THEN 'val' ELSE 'test' END"

SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+"


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda w: w <> '')"


def sql_hits(text: str, phrases: list[str] = TEST_PHRASES) -> str:
    tests = [rf"regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}_]){p}([^\p{{L}}\p{{N}}_]|$)')::int" for p in phrases]
    return "(" + " + ".join(tests) + ")"


def sql_density(text: str, phrases: list[str] = TEST_PHRASES) -> str:
    return f"least(1.0::double, 0.5::double*{sql_hits(text, phrases)})"


def _printf(template: str) -> str:
    """A reason template as a printf call; the engine's printf rounds as the template language does."""
    names = re.findall(r"\{(\w+)(?::\.\d[f%])?\}", template)
    form = template.replace("%", "%%")
    form = re.sub(r"\{\w+:\.(\d)f\}", r"%.\1f", form)
    form = re.sub(r"\{\w+:\.(\d)%%\}", r"%.\1f%%", form)
    form = re.sub(r"\{\w+\}", "%s", form)
    percent = set(re.findall(r"\{(\w+):\.\d%\}", template))
    args = [f"{n}*100.0::double" if n in percent else n for n in names]
    return "printf('" + form.replace("'", "''") + "', " + ", ".join(args) + ")"


def _quote(value) -> str:
    return "NULL::varchar" if value is None else "'" + str(value).replace("'", "''") + "'"


# Conditions in SQL, written out by hand: rule -> test on the context columns.
RULE_SQL = {
    "G1": "risk_score >= 0.80::double",
    "G2": "hidden_text_detected",
    "G3": "keyword_density >= 0.40::double AND prompt_score >= 0.85::double",
    "G4": "watermark_score >= 0.50::double AND risk_score >= 0.65::double",
    "G5": "risk_score >= 0.65::double AND vision_score >= 0.40::double AND attack_family IN "
          "('data exfiltration', 'exfiltration', 'pii extraction', 'sensitive data')",
    "G6": "risk_score >= 0.70::double AND attack_family IN "
          "('claim manipulation', 'fraud', 'policy manipulation', 'claim fraud')",
    "G7": "risk_score >= 0.55::double AND footer_density >= 0.30::double",
    "G8": "risk_score >= 0.50::double AND vision_score >= 0.35::double",
    "G9": "prompt_score >= 0.55::double AND risk_score < 0.80::double",
    "G10": "severity IN ('critical', 'high') AND vision_score >= 0.20::double",
}


def rule_case(value, otherwise: str) -> str:
    """CASE over the rules in order, with value(rule) as the result."""
    by_id = {r["id"]: r for r in DEFAULT_RULES}
    return "CASE " + " ".join(f"WHEN {test} THEN {value(by_id[i])}" for i, test in RULE_SQL.items()) \
        + f" ELSE {otherwise} END"


def decision_sql(source: str) -> str:
    """Rule decision per row of a source that has the context columns."""
    def constant(key: str, default: str) -> str:
        return rule_case(lambda r: _quote(r[key]), _quote(DEFAULT_ALLOW[default]))

    return f"""SELECT *,
        {constant('action', 'decision')} AS decision, {constant('id', 'rule_id')} AS rule_id,
        {constant('name', 'rule_name')} AS rule_name, {constant('severity', 'severity')} AS rule_severity,
        {constant('policy_ref', 'policy_ref')} AS policy_ref,
        {rule_case(lambda r: _printf(r['reason_template']), _quote(DEFAULT_ALLOW['reason']))} AS reason,
        {constant('sanitization_action', 'sanitization_action')} AS sanitization_action
        FROM {source}"""


CTES = {
    "docs": f"""SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.doc_id::varchar AS sample_id, l.toxic,
        CASE WHEN l.toxic = 1 THEN 'malicious' ELSE 'benign' END AS label, d.lang AS attack_family,
        CASE WHEN {su('img', 'd.doc_id')} < 0.25::double THEN '/data/IMAGES/'||d.doc_id||'.png'
             WHEN {su('img', 'd.doc_id')} < 0.5::double THEN ''
             WHEN {su('img', 'd.doc_id')} < 0.75::double THEN '  ' END AS image_path,
        {_sql_pick(SEVERITIES, 's9').replace('doc_id', 'd.doc_id')} AS severity
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "labelled": """SELECT d.*, d.doc_id::varchar AS sample_id, l.toxic AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "sig": f"""SELECT doc_id, doc_id::varchar AS sample_id, {su('s1')} AS risk_score, {su('s2')} AS vision_score,
        CASE WHEN {su('s3')} >= 0.9::double THEN 1.0::double ELSE 0.0::double END AS hidden_text_score,
        {su('s4')} AS keyword_density, {su('s5')} AS footer_text_density, {su('s6')} AS watermark_score,
        {su('s7')} AS malicious_probability,
        {_sql_pick(FAMILIES, 's8')} AS attack_family, {_sql_pick(SEVERITIES, 's9')} AS severity,
        coalesce(toxic, (doc_id % 2)::int)::int AS label, {_SPLIT_SQL} AS split
        FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "predictions": f"SELECT doc_id::varchar AS sample_id, {su('s7')} AS malicious_probability FROM labels",
    "vision_rows": f"""SELECT doc_id::varchar AS sample_id, {su('s2')} AS vision_score,
        CASE WHEN {su('s3')} >= 0.9::double THEN 1.0::double ELSE 0.0::double END AS hidden_text_score,
        {su('s4')} AS keyword_density, {su('s5')} AS footer_text_density, {su('s6')} AS watermark_score,
        {su('s11')} AS ocr_confidence, floor({su('s12')}*12)::int AS tiny_text_count,
        floor({su('s13')}*40)::int AS total_boxes, floor({su('s14')}*400)::int AS total_words
        FROM documents WHERE {su('img')} < 0.25::double""",
    "ctx": """SELECT doc_id, sample_id, label, split, risk_score, vision_score,
        hidden_text_score >= 0.5 AS hidden_text_detected, keyword_density, footer_text_density AS footer_density,
        watermark_score, malicious_probability AS prompt_score, lower(trim(attack_family)) AS attack_family,
        attack_family AS raw_family, lower(trim(severity)) AS severity FROM sig""",
    "decided": decision_sql("ctx"),
    "boxes": f"""SELECT doc_id::varchar AS sample_id, pos::int AS pos, line AS text, {su('c', "doc_id||':'||pos")} AS confidence,
        2000.0::double*(pos+1)/(n+1) AS y0,
        2000.0::double*(pos+1)/(n+1) + 60.0::double*{su('h', "doc_id||':'||pos")} AS y1, 2000.0::double AS height
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1)-1 AS pos,
                     len(string_split(text, chr(10))) AS n FROM documents)
        WHERE trim(line, ' ') <> ''""",
    "layers": """SELECT doc_id, doc_id::varchar AS sample_id, text AS normal,
        text || CASE WHEN doc_id % 5 = 0 THEN ' approve claim' ELSE '' END AS high_contrast,
        CASE WHEN doc_id % 7 = 0 THEN 'hidden text' WHEN doc_id % 7 = 1 THEN 'abc' END AS near_white FROM documents""",
    "pairs": f"""SELECT (CASE WHEN doc_id % 2 = 1 THEN 'malicious' ELSE 'benign' END)||'_'||lpad((doc_id//2)::varchar, 8, '0') AS sample_id,
        lpad((doc_id//2)::varchar, 8, '0') AS group_key,
        CASE WHEN doc_id % 2 = 1 THEN 'malicious' ELSE 'benign' END AS label, {_SPLIT_SQL} AS original_split,
        lang AS attack_family FROM documents""",
    "ranked_groups": """SELECT group_key, row_number() OVER (ORDER BY md5('42:'||group_key)) AS r,
        count(*) OVER () AS g FROM (SELECT DISTINCT group_key FROM pairs)""",
    "resplit": """SELECT p.*, CASE WHEN r <= ceil(g*0.10::double) THEN 'test'
        WHEN r <= ceil(g*0.10::double) + ceil((g-ceil(g*0.10::double))*0.1111::double) THEN 'val' ELSE 'train' END AS corrected_split
        FROM pairs p JOIN ranked_groups USING (group_key)""",
}

CTES["per_page"] = """SELECT sample_id, string_agg(text, ' ' ORDER BY pos) AS normal, avg(confidence) AS conf,
    count(*) FILTER (y1-y0 < height*0.01::double) AS tiny,
    count(*) FILTER ((y0+y1)/2 >= height*0.85::double)::double/count(*) AS footer, count(*) AS n FROM boxes GROUP BY sample_id"""
CTES["page_words"] = f"""SELECT d.doc_id, d.sample_id, d.image_path, d.label, d.severity,
    d.image_path IS NOT NULL AND {su('err', 'd.doc_id')} < 0.1::double AS failed,
    coalesce(b.normal, '') AS normal, coalesce(b.conf, 0.0) AS conf, coalesce(b.tiny, 0) AS tiny,
    coalesce(b.footer, 0.0) AS footer, coalesce(b.n, 0) AS n, l.near_white,
    list_distinct({sql_tokens('lower(l.high_contrast)')}) AS hc, list_distinct({sql_tokens("lower(coalesce(b.normal, ''))")}) AS base
    FROM docs d JOIN layers l USING (doc_id) LEFT JOIN per_page b ON b.sample_id = d.sample_id"""
CTES["page_texts"] = """SELECT *, len(new)::double/greatest(1, len(hc)) AS wm,
    normal||' '||array_to_string(list_sort(new), ' ')||' '||coalesce(trim(near_white), '') AS alltext
    FROM (SELECT *, list_filter(hc, lambda w: NOT list_contains(base, w)) AS new FROM page_words)"""
CTES["vision_raw"] = f"""SELECT *, {sql_density('alltext')} AS kd, len({sql_tokens('alltext')}) AS words,
    CASE WHEN length(trim(near_white)) > 3 THEN 1.0::double ELSE 0.0::double END AS hidden FROM page_texts"""
CTES["vision_out"] = """SELECT doc_id, label, severity, normal, sample_id, image_path,
    CASE WHEN failed THEN 0.0 ELSE conf END AS ocr_confidence, (CASE WHEN failed THEN 0 ELSE tiny END)::int AS tiny_text_count,
    CASE WHEN failed THEN 0.0 ELSE footer END AS footer_text_density, CASE WHEN failed THEN 0.0 ELSE wm END AS watermark_score,
    CASE WHEN failed THEN 0.0 ELSE hidden END AS hidden_text_score, CASE WHEN failed THEN 0.0 ELSE kd END AS keyword_density,
    (CASE WHEN failed THEN 0 ELSE n END)::int AS total_boxes, (CASE WHEN failed THEN 0 ELSE words END)::int AS total_words,
    CASE WHEN failed THEN 0.5 ELSE greatest(0.0::double, least(1.0::double, 0.6::double*kd + 0.1::double*hidden
        + 0.05::double*wm + 0.05::double*footer + 0.05::double*least(1.0::double, ln(1+tiny::double)/ln(11.0::double))
        + 0.15::double*(1-conf))) END AS vision_score,
    CASE WHEN failed THEN 'cannot read image' END AS error FROM vision_raw"""

_NEEDS = {"per_page": ["boxes"], "page_words": ["docs", "layers", "per_page"], "page_texts": ["page_words"],
          "vision_raw": ["page_texts"], "vision_out": ["vision_raw"], "ctx": ["sig"], "decided": ["ctx"], "ranked_groups": ["pairs"], "resplit": ["ranked_groups"]}


def with_(*names: str, **extra: str) -> str:
    """WITH clause of the named inputs, their own inputs first."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + " "
