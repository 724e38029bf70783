"""The prioritised rule table, compiled to one CASE expression.

No UDF and no join: every rule becomes a condition, and the first that holds decides.  Only tables of hundreds of rules
go through an index (rule_index.py).
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.fixed_values import DEFAULT_ALLOW, DEFAULT_RULES, FAIL_SAFE_BLOCK
from docguard.functions.numbers import fixed, listed, nan_to_null, num, percent, quote
from docguard.functions.signals import is_flagged
from docguard.functions.text import strip
from docguard.operators.rule_index import RuleIndex, placing_udf

RULES_SCHEMA = "id string, name string, priority int, action string, severity string, policy_ref string"

# context field -> (candidate columns, default, kind)
CONTEXT = {
    "risk_score": (("risk_score",), "null", "number"),
    "vision_score": (("vision_score",), "0.0D", "number"),
    "hidden_text_detected": (("hidden_text_detected", "hidden_text_score"), "false", "flag"),
    "keyword_density": (("keyword_density",), "0.0D", "number"),
    "footer_density": (("footer_density", "footer_text_density"), "0.0D", "number"),
    "watermark_score": (("watermark_score",), "0.0D", "number"),
    "prompt_score": (("prompt_score", "malicious_probability"), "0.0D", "number"),
    "attack_family": (("attack_family_predicted", "attack_family"), "'unknown'", "text"),
    "severity": (("severity",), "'medium'", "text"),
}
_TYPES = {"number": "double", "flag": "boolean", "text": "string"}
_OPERATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "in": "IN"}
# result -> key of the rule it comes from
_RESULTS = {"decision": "action", "rule_id": "id", "rule_name": "name", "severity": "severity",
            "policy_ref": "policy_ref", "sanitization_action": "sanitization_action"}
EMPTY = "''"
_PLACEHOLDER = re.compile(r"\{(\w+)(?::\.(\d+)([f%]))?\}")


def load_rules(path: str | None = None) -> list[dict[str, Any]]:
    """Rules in priority order from a JSON file (UTF-8), or the default table."""
    if path is None:
        rules = copy.deepcopy(DEFAULT_RULES)
    else:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)["rules"]
    return sorted(rules, key=lambda rule: rule["priority"])


def with_threshold(rules: Sequence[dict], rule_id: str, field: str, value: float) -> list[dict]:
    """A copy of the rules in which one rule's lower bound on a field is replaced."""
    changed = copy.deepcopy(list(rules))
    for rule in changed:
        if rule["id"] == rule_id:
            rule["condition"][field]["gte"] = float(value)
    return changed


def rules_df(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """The rule list as rows in priority order."""
    rows = [(r["id"], r["name"], r["priority"], r["action"], r["severity"], r.get("policy_ref") or "") for r in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA).orderBy("priority")


def rule_conditions(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Every single condition as a row (rule_id, field, op, value as JSON text)."""
    rows = []
    for rule in rules:
        for field, constraint in rule["condition"].items():
            parts = constraint.items() if isinstance(constraint, dict) else [("is", constraint)]
            rows += [(rule["id"], field, op, json.dumps(value)) for op, value in parts]
    return spark.createDataFrame(rows, "rule_id string, field string, op string, value string")


def rule_context(df: DataFrame) -> DataFrame:
    """Add the normalised rule inputs as columns ctx_*; missing columns get their default."""
    added = []
    for field, (candidates, default, kind) in CONTEXT.items():
        present = next((c for c in candidates if c in df.columns), None)
        if present is None:
            value = "null"
        elif kind == "number":
            value = nan_to_null(f"double({present})")
        elif kind == "flag":
            value = present if present == candidates[0] else f"{nan_to_null(f'double({present})')} >= 0.5D"
        else:
            value = f"lower({strip(present)})"
        added.append(f"coalesce({_TYPES[kind]}({value}), {default}) AS ctx_{field}")
    return df.selectExpr("*", *added)


def compile_condition(condition: dict[str, Any], compat: bool = False) -> str:
    """A condition map as one boolean expression over ctx_* columns that is never NULL.

    Fields are joined by AND, and NULL never fires.  By default every operator of a field
    counts and an unknown one is an error; compat=True looks at the first operator only
    and lets unknown ones pass.
    """
    if any(field not in CONTEXT for field in condition):
        return "false"
    tests = [_constraint(f"ctx_{field}", CONTEXT[field][2], field, constraint, compat)
             for field, constraint in condition.items()]
    return f"coalesce({' AND '.join(tests) or 'true'}, false)"


def render(templates: Sequence[str], looked_up: str) -> tuple[list[dict[str, str | int | None]], str, str]:
    """Reason templates with {x}, {x:.3f} and {x:.1%}, as three parts.

    The constants of each template (its literals, and the numbers of the values between
    them), the array of formatted values, and the text from both.  looked_up is the column
    that holds the constants of the template that applies.  This keeps the generated code
    small enough for the JIT compiler, and formats every value once.
    """
    literals, fields, texts = [], [], {}
    for template in templates:
        parts = _PLACEHOLDER.split(template)  # literal, (field, digits, style), literal, ...
        literals.append(parts[0::4])
        names = []
        for field, digits, style in zip(parts[1::4], parts[2::4], parts[3::4]):
            name = f"_text_{field}_{digits or ''}{'p' if style == '%' else ''}"
            value = f"ctx_{field}"
            if digits:
                texts[name] = f"coalesce({(fixed if style == 'f' else percent)(value, int(digits))}, 'nan')"
            else:
                texts[name] = f"coalesce(string({value}), 'None')"
            names.append(name)
        fields.append(names)
    order = list(texts)
    constants, pieces = [{} for _ in templates], []
    for k in range(max(len(x) for x in literals)):
        for i, row in enumerate(constants):
            row[f"literal{k}"] = literals[i][k] if k < len(literals[i]) else ""
            row[f"value{k}"] = order.index(fields[i][k]) + 2 if k < len(fields[i]) else 1
        pieces.append(f"{looked_up}.literal{k}")
        if any(row[f"value{k}"] != 1 for row in constants):
            pieces.append(f"element_at(_texts, {looked_up}.value{k})")
    return constants, f"array({', '.join([EMPTY, *texts.values()])})", f"concat({', '.join(pieces)})"


def _first_rule(rules: Sequence[dict], compat: bool, failed: str) -> str:
    """Place of the first rule that holds, the number of rules if none, -1 for failed rows."""
    cases = " ".join(f"WHEN {compile_condition(r['condition'], compat)} THEN {i}" for i, r in enumerate(rules))
    return f"CASE WHEN {failed} IS NOT NULL THEN -1 {cases} ELSE {len(rules)} END"


def evaluate_rules(df: DataFrame, rules: Sequence[dict] | None = None, compat: bool = False,
                   failed: str = "cast(null as string)", indexed: bool | None = None) -> DataFrame:
    """Add the decision of the first rule that holds; ALLOW if none does.

    failed is an error text: rows where it is not NULL are blocked as fail-safe.  Tables of more than INDEXED rules are
    looked up in an index (rule_index.py) instead of one CASE; indexed chooses either way, with equal results.
    """
    rules = load_rules() if rules is None else sorted(rules, key=lambda r: r["priority"])
    ends = [FAIL_SAFE_BLOCK, DEFAULT_ALLOW]
    templates = ["Governance agent failed ({failed}). Blocking as failsafe.",
                 *[r["reason_template"] for r in rules], DEFAULT_ALLOW["reason"]]
    constants, texts, reason = render(templates, "_found")
    for result, key in _RESULTS.items():
        values = [ends[0][result], *[r.get(key) for r in rules], ends[1][result]]
        for row, value in zip(constants, values):
            row[result] = value
    columns = df.columns
    staged = rule_context(df).selectExpr("*", f"{failed} AS ctx_failed")
    if len(rules) > INDEXED if indexed is None else indexed:
        staged = _looked_up(staged, rules, compat, constants).selectExpr(*columns, f"{texts} AS _texts", "_found")
    else:
        table = ", ".join("named_struct(" + ", ".join(
            f"{quote(k)}, {v if isinstance(v, int) else quote(v)}" for k, v in row.items()) + ")" for row in constants)
        # looked up by place: a filter pushed below a result carries the CASE once
        found = f"element_at(array({table}), {_first_rule(rules, compat, 'ctx_failed')} + 2)"
        staged = staged.selectExpr(*columns, f"{texts} AS _texts", f"{found} AS _found")
    return staged.selectExpr(
        *columns, "_found.decision", "_found.rule_id", "_found.rule_name", "_found.severity AS rule_severity",
        "_found.policy_ref", f"{reason} AS reason", "_found.sanitization_action")


#: From so many rules on they are looked up in an index.
INDEXED = 256


def _kinds() -> dict[str, str]:
    return {field: kind for field, (_, _, kind) in CONTEXT.items()}


def _looked_up(staged: DataFrame, rules: Sequence[dict], compat: bool, constants: list[dict]) -> DataFrame:
    """Add _found by the rule index and a join with the table of constants, one row per rule."""
    spark = staged.sparkSession
    index = RuleIndex([r["condition"] for r in rules], _kinds(), compat)
    fields = ", ".join(f"{k}: {'int' if k.startswith('value') else 'string'}" for k in constants[0])
    table = spark.createDataFrame([(i - 1, tuple(row.values())) for i, row in enumerate(constants)], f"_place int, _found struct<{fields}>")
    placed = staged.withColumn("_place", placing_udf(spark, index)).withColumn(
        "_place", F.expr("if(ctx_failed IS NOT NULL, -1, _place)"))
    # as many rows as there are rules
    return placed.join(F.broadcast(table), "_place")


def rule_hits(df: DataFrame, rules: Sequence[dict] | None = None, id_column: str = "sample_id",
              compat: bool = False, indexed: bool | None = None) -> DataFrame:
    """All rules that hold, as (id, rule_id, priority) rows: a generator, no cross join; indexed as in evaluate_rules."""
    rules = load_rules() if rules is None else rules
    if len(rules) > INDEXED if indexed is None else indexed:
        index = RuleIndex([r["condition"] for r in rules], _kinds(), compat)
        names = df.sparkSession.createDataFrame([(i, r["id"], r["priority"]) for i, r in enumerate(rules)], "_place int, rule_id string, priority int")
        places = rule_context(df).select(id_column, placing_udf(df.sparkSession, index, every=True).alias("_places"))
        return places.selectExpr(id_column, "explode(_places) AS _place").join(F.broadcast(names), "_place").select(id_column, "rule_id", "priority")
    fired = ", ".join(
        f"if({compile_condition(r['condition'], compat)}, "
        f"named_struct('rule_id', {quote(r['id'])}, 'priority', {r['priority']}), null)" for r in rules)
    return rule_context(df).selectExpr(id_column, f"inline(array_compact(array({fired})))")


def rules_flag(df: DataFrame, rules: Sequence[dict] | None = None) -> DataFrame:
    """Add only the boolean rules_flag: does the rule table BLOCK or SANITIZE?"""
    rules = load_rules() if rules is None else sorted(rules, key=lambda r: r["priority"])
    cases = " ".join(f"WHEN {compile_condition(r['condition'])} THEN {quote(r['action'])}" for r in rules)
    action = f"CASE {cases} ELSE 'ALLOW' END"
    return rule_context(df).selectExpr(*df.columns, f"{is_flagged(action)} AS rules_flag")


def _constraint(value: str, kind: str, field: str, constraint: Any, compat: bool) -> str:
    present = f"{value} IS NOT NULL"
    if isinstance(constraint, dict):
        if compat:
            op, bound = next(iter(constraint.items()))
            return _compare(value, kind, field, op, bound) if op in _OPERATORS else present
        unknown = sorted(set(constraint) - set(_OPERATORS))
        if unknown:
            raise ValueError(f"unknown operator for {field}: {unknown}")
        return " AND ".join(_compare(value, kind, field, op, bound) for op, bound in constraint.items()) or present
    if isinstance(constraint, bool):
        truth = f"length({value}) > 0" if kind == "text" else f"boolean({value})"
        return f"({truth}) = {str(constraint).lower()}"
    if isinstance(constraint, (int, float)):
        return "false" if kind == "text" else f"double({value}) = {num(constraint)}"
    if compat:
        return present
    raise ValueError(f"condition on {field} must be a map, a flag or a number, not {constraint!r}")


def _compare(value: str, kind: str, field: str, op: str, bound: Any) -> str:
    bounds = list(bound) if op == "in" else [bound]
    if kind == "text":
        comparable = [b for b in bounds if isinstance(b, str)]
    else:
        comparable = [b for b in bounds if isinstance(b, (int, float))]
        value = f"double({value})"
    if op in ("in", "eq"):  # values of another kind are just not equal
        texts = listed(comparable) if kind == "text" else ", ".join(num(b) for b in comparable)
        return f"{value} IN ({texts})" if comparable else "false"
    if not comparable:
        raise ValueError(f"{op} on {field} cannot compare with {bound!r}")
    return f"{value} {_OPERATORS[op]} {quote(bound) if kind == 'text' else num(bound)}"
