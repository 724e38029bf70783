"""Invariants, skew, guards and edge cases of the operators."""

import itertools
import random

import pytest

from docguard.operators import decisions, features, layouts, metrics, model, profile, quality, ranked, splits, texts
from docguard.session import new_path
from docguard.sources import tables


def test_running_totals_equal_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), round(draw.random(), 3), draw.randint(0, 1)) for _ in range(4000)]
    rows += [("a", 0.5, 1)] * 3000  # one value holds over a third of all rows
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(8)
    counts = df.groupBy("g", "x").agg({"y": "sum"}).withColumnRenamed("sum(y)", "n")
    got = {(r["g"], r["x"]): (r["n_before"], r["n_total"]) for r in
           ranked.running_totals(counts, "x", ["n"], ["g"]).collect()}
    for g in "ab":
        values = sorted({x for h, x, _ in rows if h == g})
        before = 0
        sums = {v: sum(y for h, x, y in rows if h == g and x == v) for v in values}
        for v in values:
            assert got[(g, v)] == (before, sum(sums.values()))
            before += sums[v]


def test_exact_quantiles(spark):
    import numpy as np
    draw = random.Random(5)
    xs = [draw.gauss(0, 1) for _ in range(1001)] + [0.25] * 700
    got = ranked.exact_quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"],
                                 {"q1": 0.1, "q50": 0.5, "q99": 0.99}).first()
    for name, p in (("q1", 10), ("q50", 50), ("q99", 99)):
        assert got[name] == pytest.approx(float(np.percentile(xs, p)), abs=1e-12)


def test_auc_equals_all_pairs(spark):
    draw = random.Random(11)
    rows = [(draw.randint(0, 1), round(draw.random(), 2)) for _ in range(600)] + [(1, 0.5)] * 200
    df = spark.createDataFrame([*rows, (1, None)], "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg))
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()["roc_auc"] is None
    curve = metrics.roc_curve(df, "y", "s").orderBy("threshold").collect()
    assert len(curve) == len({s for _, s in rows}) and curve[0]["tpr"] == curve[0]["fpr"] == 1.0


def test_group_split_never_divides_a_group(spark):
    rows = [(f"s{i}", "hot" if i % 3 == 0 else f"g{i % 97}") for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id string, group_key string")
    split = splits.group_split(df)
    assert splits.group_leakage(split, "corrected_split").first()["leaked_groups"] == 0
    sizes = {r["corrected_split"]: r["n"] for r in split.select("group_key", "corrected_split").distinct()
             .groupBy("corrected_split").count().withColumnRenamed("count", "n").collect()}
    assert sizes == {"test": 10, "val": 10, "train": 78}  # of 98 groups: ceil(9.8), ceil(88 * 0.1111)
    again = splits.group_split(df.repartition(13))
    assert split.join(again, ["sample_id", "group_key", "corrected_split"]).count() == len(rows)


def test_group_split_moves_no_rows(spark):
    df = spark.range(1000).selectExpr("string(id) AS sample_id", "string(id % 50) AS group_key")
    plan = splits.group_split(df)._jdf.queryExecution().executedPlan().toString()
    rows_part = plan.split("Subquery")[0]
    assert "Exchange" not in rows_part and "Join" not in rows_part


def test_duplicate_right_keys_fail(spark):
    left = spark.createDataFrame([("1", 0, "train", "x")], "sample_id string, label int, split string, attack_family string")
    twice = spark.createDataFrame([("1", 0.5), ("1", 0.6)], "sample_id string, malicious_probability double")
    vision = spark.createDataFrame([("1", 0.5)], "sample_id string, vision_score double")
    with pytest.raises(Exception, match="duplicate sample_id: 1"):
        features.fuse_sources(left, twice, vision).collect()


def test_strict_labels_fail(spark):
    df = spark.createDataFrame([("benign",), ("odd",)], "label string")
    with pytest.raises(Exception, match="unknown label: odd"):
        features.encode_label(df).collect()
    assert [r["label_int"] for r in features.encode_label(df, strict=False).collect()] == [0, 0]


def test_quality_gate_raises(spark):
    df = spark.createDataFrame([("1", "train"), ("1", "val")], "sample_id string, split string")
    with pytest.raises(quality.QualityError, match="train-val=1"):
        quality.enforce(quality.validate_splits(df))
    with pytest.raises(quality.QualityError, match="columns"):
        quality.enforce(quality.validate_feature_matrix(df))


def test_windowed_score_stops_early(spark):
    words = ["w"] * 2000
    words[600], words[1500] = "bad", "worse"
    df = spark.createDataFrame([("1", " ".join(words)), ("2", "bad"), ("3", "")], "sample_id string, text string")
    scorer = texts.TextScorer(lambda t: f"CASE WHEN contains({t}, 'worse') THEN 1.0D WHEN contains({t}, 'bad') THEN 0.995D ELSE 0.1D END")
    expected = {"1": 0.995, "2": 0.995, "3": 0.1}
    assert {r[0]: r[1] for r in texts.sliding_window_score(df, scorer).select("sample_id", "malicious_probability").collect()} == expected
    assert {r[0]: r[1] for r in texts.windowed_score(df, scorer).select("sample_id", "prompt_score").collect()} == expected


def test_windows_cover_the_whole_text(spark):
    n = 5000
    df = spark.createDataFrame([("1", " ".join(f"w{i}" for i in range(n - 1)) + " needle")], "sample_id string, text string")
    scorer = texts.TextScorer(lambda t: f"if(contains({t}, 'needle'), 1.0D, 0.0D)")
    row = texts.sliding_window_score(df, scorer).first()
    assert row["malicious_probability"] == 1.0 and row["n_windows"] == len(range(0, n, 256))


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): None, ("a", "b"): None, ("b", "b"): 1.0}
    assert profile.histogram(df, "a", 5).first()["n"] == 5
    assert model.standardise(df, ["a"])[1] == [1.0]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (1, 0.10001), (1, 1.0)], "y int, s double")
    got = {r["bin"]: r["n"] for r in metrics.calibration_curve(df, "y", "s").collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_metrics_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["fnr"], row["fpr"]) == (0.0, 0.0, 1.0, 0.0)
    assert row["f1_macro"] == pytest.approx(0.25)


def test_sweep_without_feasible_threshold(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, risk_score double")
    assert metrics.tuned_threshold(metrics.threshold_sweep(df)) == 0.80


def test_random_audit_ids(spark):
    df = spark.range(50).selectExpr("0.1D AS risk_score")
    rows = decisions.decide_batch(df, deterministic=False).collect()
    assert len({r["audit_log_id"] for r in rows}) == 50
    assert all(r["sample_id"] == r["audit_log_id"] and len(r["audit_log_id"]) == 8 for r in rows)


def test_documents_without_boxes(spark):
    schema = ("sample_id string, image_path string, boxes array<struct<text: string, confidence: double, y0: double, y1: double>>, "
              "height double, high_contrast string, near_white string, error string")
    rows = [("1", "a.png", [], 100.0, None, None, None), ("2", "b.png", None, 100.0, "", " ab ", None),
            ("3", "c.png", None, None, None, None, "broken")]
    got = {r["sample_id"]: r for r in layouts.vision_features(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"]["vision_score"] == got["2"]["vision_score"] == pytest.approx(0.15)
    assert got["2"]["hidden_text_score"] == 0.0 and got["2"]["total_words"] == 1
    assert got["3"]["vision_score"] == 0.5 and got["3"]["total_boxes"] == 0


def test_resume_and_cache(spark):
    path, calls = new_path(spark, "resume"), []

    def process(rest):
        calls.append(rest.count())
        return rest.selectExpr("id", "id * 2 AS twice")

    tables.resume(spark.range(10), path, "id", process)
    assert tables.resume(spark.range(15), path, "id", process).count() == 15
    assert tables.resume(spark.range(5), path, "id", process, force=True).count() == 5
    assert calls == [10, 5, 5]


def test_fitted_model_learns_and_survives_saving(spark):
    draw = random.Random(1)
    rows = []
    for i in range(600):
        y = i % 2
        rows.append((str(i), y, y * 0.8 + draw.gauss(0, 0.4), draw.random(), 1.0))
    df = spark.createDataFrame(rows, "sample_id string, label int, a double, b double, c double")
    fitted, search = model.fit_risk(df, ["a", "b", "c"], grid=[0.01, 1.0])
    scored = model.score_risk(df, fitted)
    row = metrics.roc_auc(scored, "label", "risk_score").first()
    assert row["roc_auc"] > 0.85 and len(search) == 2 and fitted.scales[2] == 1.0
    assert metrics.brier(scored, "label", "risk_score").first()["brier"] < 0.18
    assert model.feature_importance(spark, fitted).first()["feature"] == "a"
    path = new_path(spark, "model")
    model.save_model(spark, fitted, path)
    assert model.load_model(spark, path) == fitted


def test_images_resolve_by_path_then_by_name(spark):
    from docguard.sources import images
    rows = [("1", "/a/x.png"), ("2", "/old/y.png"), ("3", ""), ("4", None), ("5", "/old/z.png")] + [
        (f"hot{i}", "/old/y.png") for i in range(50)] + [(f"none{i}", "") for i in range(50)]
    files = spark.createDataFrame([("/a/x.png",), ("/b/x.png",), ("/c/y.png",), ("/b/y.png",)], "path string")
    resolved = images.resolve_images(spark.createDataFrame(rows, "sample_id string, image_path string"), files)
    got = {r["sample_id"]: r["resolved_path"] for r in resolved.collect()}
    assert len(got) == len(rows)
    assert (got["1"], got["2"], got["3"], got["4"], got["5"], got["hot7"]) == ("/a/x.png", "/b/y.png", None, None, None, "/b/y.png")
    assert images.image_inventory(resolved).first().asDict() == {"image_backed": 53, "found": 52, "missing": 1}


def test_image_listing_reads_no_contents(spark, tmp_path):
    from docguard.sources import images
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"12345")
    listed = images.list_images(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in listed.collect()) == [("a.png", 5), ("b.png", 5)]


def test_no_filter_is_inferred_below_the_aggregation(spark):
    df = spark.range(100).selectExpr("id % 2 AS y", "double(id) / 100 AS s")
    plan = metrics.roc_auc(df, "y", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(size" not in plan and "isnotnull(coalesce" not in plan


def test_reason_rendering_fits_one_compiled_method(spark):
    import re
    from docguard.operators.rules import evaluate_rules
    path = new_path(spark, "signals")
    spark.range(10).selectExpr("0.5D AS risk_score", "0.1D AS vision_score", "0.2D AS keyword_density",
                               "0.7D AS malicious_probability", "'x' AS attack_family").write.parquet(path)
    plan = evaluate_rules(spark.read.parquet(path))._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
