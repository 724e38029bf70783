"""Ledger of runs, the searchable audit log, streams with repeated documents, and the rule index."""

import random

import pytest
from pyspark.sql import functions as F

from checks.gaps import many_rules
from docguard.functions import registry
from docguard.operators import decisions as D
from docguard.operators.rules import evaluate_rules, rule_hits
from docguard.session import new_path
from docguard.sources import tables
from docguard.streaming import decisions as ST


def scanned(df):
    """Rows and files that the parquet scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    out = {"numOutputRows": 0, "numFiles": 0}
    for i in range(leaves.size()):
        for name in out:
            metric = leaves.apply(i).metrics().get(name)
            out[name] += metric.get().value() if metric.isDefined() else 0
    return out


def test_a_run_reads_the_parts_it_may_hit(spark):
    path = new_path(spark, "ledger")
    process = lambda rest: rest.selectExpr("id", "id * 2 AS twice")
    tables.resume(spark.range(5000).toDF("id"), path, "id", process)
    keys = lambda ids: spark.createDataFrame([(f"key:{i}",) for i in ids], "_key string").selectExpr(
        "_key", f"int(pmod(xxhash64(_key), {tables.LEDGER_PARTS})) AS part")
    few = scanned(tables.ledger_of(spark, path, ["run-000001"], keys([7, 9])))
    every = scanned(tables.ledger_of(spark, path, ["run-000001"], keys(range(5000))))
    assert few["numFiles"] <= 2 and every["numFiles"] >= 60 and every["numOutputRows"] == 5000
    # a key that no run had: its part is read, the bloom filter passes none of its rows on
    assert scanned(tables.ledger_of(spark, path, ["run-000001"], keys([-5])))["numOutputRows"] == 0
    assert tables.resume(spark.range(5010).toDF("id"), path, "id", process).count() == 5010


def test_rows_without_a_key_and_broken_runs(spark):
    path, calls = new_path(spark, "ledger"), []
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (None, "b")], "id int, v string")

    def process(rest):
        calls.append(sorted(map(tuple, rest.collect()), key=repr))
        return rest

    assert tables.resume(rows, path, "id", process).count() == 4
    assert tables.resume(rows, path, "id", process).count() == 4 and calls[1] == []
    more = rows.unionByName(spark.createDataFrame([(2, "d"), (None, "e")], rows.schema))

    def broken(rest):
        return rest.withColumn("v", F.expr("raise_error('lost')"))

    with pytest.raises(Exception, match="lost"):
        tables.resume(more, path, "id", broken)
    assert tables.resume(more, path, "id", process).count() == 6 and calls[2] == [(2, "d"), (None, "e")]


def test_lookups_skip_row_groups(spark):
    path = new_path(spark, "audit")
    rows = spark.range(20000).selectExpr(
        "string(id) AS sample_id", "upper(md5(string(id))) AS audit_log_id", "date_format(timestamp_seconds(1700000000 + id * 7919 % 20000), \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
        "'ALLOW' AS decision", "double(id) AS risk_score", "0.0D AS prompt_score", "0.0D AS vision_score", "cast(null as string) AS governance_rule_triggered", "'r' AS reason")
    tables.append_audit_table(rows, path, fresh=True, rows_per_group=500)
    log = tables.read_audit_table(spark, path)
    wanted = log.filter("sample_id = '77'").first().audit_log_id
    found = D.audit_lookup(log, wanted)
    assert [r.sample_id for r in found.collect()] == ["77"] and scanned(found)["numOutputRows"] <= 2000
    assert scanned(D.audit_lookup(log, "0" * 32))["numOutputRows"] <= 2000
    newest = tables.newest_audit(spark, path, 5)
    want = [r.sample_id for r in log.orderBy(F.desc("timestamp"), "audit_log_id").limit(5).collect()]
    assert [r.sample_id for r in newest.collect()] == want and scanned(newest)["numOutputRows"] <= 2000


def test_documents_in_several_files_pass_once(spark):
    folder, sink, state = new_path(spark, "docs"), new_path(spark, "once"), new_path(spark, "once_state")
    rows = [("a", "x"), ("b", "y"), (None, "t"), (None, "u"), ("a", "x again")], [("a", "x"), (None, "t"), ("c", "z")]
    for part in rows:
        spark.createDataFrame(part, "sample_id string, text string").withColumn("at", F.expr("timestamp'2024-01-01'")).coalesce(1) \
            .write.mode("append").parquet(folder + "/docs.parquet")
    schema = spark.read.parquet(folder + "/docs.parquet").schema
    source = ST.each_once(ST.stream_table(spark, folder, "docs", schema, files_per_batch=1), "at")
    source.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(sink).select("sample_id", "text").collect()]
    assert len(got) == 5 and {k for k, _ in got} == {"a", "b", "c", None} and {t for k, t in got if k is None} == {"t", "u"}


def signals(spark, n=400):
    draw, nan = random.Random(4), float("nan")
    some = lambda: draw.choice([None, nan, 0.0, 0.25, 0.5, 0.75, 1.0, -1.0, draw.random(), draw.random()])
    rows = [(str(i), some(), some(), some(), some(), some(), draw.choice([None, True, False]), draw.choice([None, "", "fraud", "FRAUD ", "ab", "abc", "zzz"]),
             draw.choice(["low", "high", None])) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, risk_score double, vision_score double, keyword_density double, watermark_score double, "
                                       "prompt_score double, hidden_text_detected boolean, attack_family string, severity string")


def mixed_rules(n, compat):
    draw = random.Random(n)
    out = []
    for i in range(n):
        condition = {}
        for field in draw.sample(["risk_score", "vision_score", "keyword_density", "watermark_score", "prompt_score", "hidden_text_detected", "attack_family", "severity"], draw.randint(1, 4)):
            low = draw.choice([0.0, 0.25, 0.5, 1.0, draw.random()])
            text = draw.choice(["fraud", "", "abc", "zz", "high", "low"])
            choices = [{draw.choice(["gt", "gte", "lt", "lte"]): low}, {"gte": low, "lt": low + .3}, {"in": [low, .25, "fraud"]}, {"eq": low}, True, False, low]
            if field in ("attack_family", "severity"):
                choices = [{draw.choice(["gt", "gte", "lt", "lte"]): text}, {"in": [text, "fraud", 3]}, {"eq": text}, True, False, 3]
            if compat:
                choices += [{"like": "x", "gte": 9}, "word", {"gte": low if field not in ("attack_family", "severity") else text, "lt": None}]
            condition[field] = draw.choice(choices)
        if i == 17:
            condition["no_such_field"] = {"gt": 1}
        out.append({"id": f"R{i}", "priority": (i * 13) % n, "name": f"n{i}", "action": draw.choice(["BLOCK", "SANITIZE", "ALLOW"]), "severity": "low", "condition": condition,
                    "policy_ref": None if i % 4 else "p", "reason_template": "rule {risk_score:.3f} of '{attack_family}' at {watermark_score:.1%}" if i % 2 else f"it's {i}"})
    return out


@pytest.mark.parametrize("n,compat", [(150, False), (150, True), (64, False), (1, False)])
def test_index_and_case_decide_alike(spark, n, compat):
    df, rules = signals(spark), mixed_rules(n, compat)
    failed = "if(bigint(sample_id) % 50 = 0, 'broken', null)"
    one = evaluate_rules(df, rules, compat, failed, indexed=False)
    two = evaluate_rules(df, rules, compat, failed, indexed=True)
    assert one.columns == two.columns
    text = lambda frame: sorted(repr(r) for r in frame.collect())
    assert text(one) == text(two)
    assert text(rule_hits(df, rules, compat=compat, indexed=False)) == text(rule_hits(df, rules, compat=compat, indexed=True))


def test_unknown_operators_fail_in_the_index(spark):
    rule = {"id": "R", "priority": 1, "name": "n", "action": "BLOCK", "severity": "low", "condition": {"risk_score": {"like": 1}}, "reason_template": ""}
    with pytest.raises(ValueError, match="unknown operator"):
        evaluate_rules(signals(spark, 3), [rule], indexed=True)


def test_no_rules_and_no_rows_in_the_index(spark):
    df = signals(spark, 5)
    assert {r.decision for r in evaluate_rules(df, [], indexed=True).collect()} == {"ALLOW"}
    assert evaluate_rules(df.limit(0), many_rules(300)).count() == 0


def test_a_backend_is_loaded_once_per_registration(spark, tmp_path):
    marks = str(tmp_path / "loads")

    def backend(value):
        def load():
            import pandas as pd
            with open(marks, "a") as file:
                file.write(f"{value}\n")
            return lambda texts: pd.Series([value] * len(texts))
        return load

    df = spark.createDataFrame([("a",)], "text string").coalesce(1)
    registry.register("counted", backend(0.25))
    for _ in range(3):
        assert df.select(registry.scorer("counted")("text").alias("r")).first().r.score == 0.25
    registry.register("counted", backend(0.75))
    assert df.select(registry.scorer("counted")("text").alias("r")).first().r.score == 0.75
    loads = open(marks).read().split()
    # tasks may run in several workers, but never more often than there are of them
    assert loads[-1] == "0.75" and loads.count("0.25") <= 3 and loads.count("0.75") == 1


def test_a_worker_keeps_the_last_registration():
    kept = registry.loaded
    assert kept("n", "1", lambda: "one") == "one" and kept("n", "1", lambda: 1 / 0) == "one"
    assert kept("n", "2", lambda: "two") == "two" and kept("n", "1", lambda: "again") == "again"
    assert [v for k, v in registry._LOADED.items() if k == "n"] == [("1", "again")]


def test_backends_see_few_texts_at_once(spark):
    """The score is the number of texts that came with it: a bound on what a worker holds, whatever the table's size."""
    from docguard.functions import registry
    from docguard.operators.texts import sliding_window_score
    from docguard.plans.documents import prompt_scores

    def load():
        return lambda texts: texts.map(lambda t: float(len(texts)))

    registry.register("counted", load)
    docs = spark.range(3500).selectExpr("string(id) AS sample_id", "if(id = 7, repeat('word ', 1500), 'short text') AS text").coalesce(1)
    rows = sliding_window_score(docs, lambda text: registry.scorer("counted")(text)["score"], stop_above=1e9)
    assert rows.count() == 3500 and rows.selectExpr("max(malicious_probability)").first()[0] <= registry.TEXTS
    rows = prompt_scores(docs, registry.window_scorer("counted", stop_above=1e9)).select("sample_id", "prompt_score", "prompt_error")
    found = rows.collect()
    assert len(found) == 3500 and all(r.prompt_error is None and 1 <= r.prompt_score <= registry.TEXTS for r in found)


def test_streamed_copies_are_written_by_several_tasks():
    """No step of the query brings a whole arrival to one task."""
    import inspect

    from checks import models
    assert "coalesce(1)" not in inspect.getsource(models.stream_decisions_once)


def test_rows_of_one_file_are_worked_off_by_several_tasks(spark):
    """A file of one row group is read by one task; the costly steps on its rows are not."""
    from checks.inputs import pages

    parts = pages(spark, "/root/testdata/sf0.1").selectExpr("spark_partition_id() AS part", "size(boxes) AS n").groupBy("part").agg({"n": "sum"}).collect()
    assert len(parts) > 1
