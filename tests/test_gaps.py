"""Cases that the given tables do not hold: listings of real files, markers, clusters without a shared folder, rare classes."""

import os

import pytest
from pyspark.sql import functions as F

from docguard import session
from docguard.functions import registry
from docguard.functions.numbers import clip, num, rounded
from docguard.functions.signals import audit_id, split_name
from docguard.operators import metrics as M
from docguard.operators import profile as P
from docguard.operators import model as MO
from docguard.operators.features import join_labels_splits
from docguard.plans.documents import prompt_scores
from docguard.sources import images, tables


def value(spark, expression):
    return spark.range(1).selectExpr(f"{expression} AS x").first()[0]


def test_numbers(spark):
    assert value(spark, clip("double(null)")) is None
    assert value(spark, clip("double('NaN')")) is None
    assert value(spark, clip("1.5D")) == 1.0
    assert value(spark, rounded("double('NaN')", 6)) is None
    assert value(spark, rounded("4e13D", 6)) == 4e13
    assert value(spark, rounded("double('Infinity')", 2)) == float("inf")
    assert value(spark, rounded("0.1235D", 3)) == round(0.1235, 3)
    with pytest.raises(ValueError):
        num(float("inf"))


def test_split_names_and_audit_ids(spark):
    assert value(spark, split_name("'\\tValidation\\n'")) == "val"
    assert len(value(spark, audit_id("'a'"))) == 8 and len(value(spark, audit_id("'a'", 40))) == 40
    assert value(spark, audit_id("'a'", 16, "1")) != value(spark, audit_id("'a'", 16, "2"))


def test_a_real_listing_finds_the_file_of_the_path(spark, tmp_path):
    for name in ("a/x.png", "b/x.png", "c d/ü+1.png"):
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(b"1")
    rows = [("1", f"{tmp_path}/b/x.png"), ("2", f"{tmp_path}/a/x.png"), ("3", f"{tmp_path}/c d/ü+1.png"), ("4", "/elsewhere/x.png"), ("5", None)]
    df = spark.createDataFrame(rows, "sample_id string, image_path string")
    found = {r.sample_id: r.resolved_path for r in images.resolve_images(df, images.list_images(spark, str(tmp_path))).collect()}
    assert found == {"1": f"{tmp_path}/b/x.png", "2": f"{tmp_path}/a/x.png", "3": f"{tmp_path}/c d/ü+1.png", "4": f"{tmp_path}/a/x.png", "5": None}


def test_results_without_a_marker_are_kept(spark, tmp_path):
    path = str(tmp_path / "done")
    spark.createDataFrame([(1, "old")], "id int, v string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    for name in os.listdir(path):
        if name.startswith("_SUCCESS") or name.startswith("._SUCCESS"):
            os.remove(f"{path}/{name}")
    todo = spark.createDataFrame([(1,), (2,)], "id int")
    rows = tables.resume(todo, path, "id", lambda df: df.withColumn("v", F.lit("new"))).collect()
    assert sorted(map(tuple, rows)) == [(1, "old"), (2, "new")]
    assert tables.cached(spark, path, lambda: 1 / 0).count() == 2
    assert not session.has_data(spark, str(tmp_path / "nothing"))


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Unset:
        def get(self, name, default):
            return default

    class Other:
        sparkContext = Context()
        conf = Unset()

    with pytest.raises(ValueError):
        session.durable_root(Other())


def test_rows_without_a_prediction_are_not_lost(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (0, 0)], "label int, predicted int")
    with pytest.raises(Exception, match="have no prediction"):
        M.classification_metrics(df, "label", "predicted").collect()
    assert M.confusion_matrix(df, "label", "predicted", unscored="count").first()["n_unscored"] == 1


def test_an_id_in_two_splits_fails(spark):
    labels = spark.createDataFrame([("a", "benign", "x")], "sample_id string, label string, attack_family string")
    splits = spark.createDataFrame([("a", "train"), ("a", "val")], "sample_id string, split string")
    with pytest.raises(Exception, match="duplicate sample_id"):
        join_labels_splits(labels, splits).collect()


def test_folds_of_rare_positives(spark):
    rows = [(str(i), int(i < 3), float(i % 7), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, label int, a double, b double")
    per_fold = {r["fold"]: r["n"] for r in MO.with_folds(df, "label").filter("label = 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_fold == {0: 1, 1: 1, 2: 1}
    model, search = MO.fit_risk(df, ["a", "b"], grid=[0.1, 1.0])
    assert all(converged and iterations > 0 for _, _, iterations, converged in search)
    assert 0 <= df.selectExpr(f"{MO.risk_probability(model)} AS p").agg(F.max("p")).first()[0] <= 1
    with pytest.raises(ValueError, match="too few rows"):
        MO.fit_risk(df.filter("label = 0"), ["a", "b"], grid=[1.0])


def test_backends_in_rows_report_errors(spark):
    def load():
        def score(texts):
            if texts.str.contains("bad").any():
                raise ValueError("bad text")
            return texts.str.len() / 1000.0

        return score

    registry.register("length", load)
    df = spark.createDataFrame([("1", "abc"), ("2", "a bad one"), ("3", "w " * 600)], "sample_id string, text string")
    rows = {r.sample_id: (r.prompt_score, r.prompt_error) for r in prompt_scores(df, registry.window_scorer("length")).collect()}
    assert rows["1"] == (0.003, None) and rows["2"] == (None, "bad text") and rows["3"][0] == 1.019
    registry.register("absent", lambda: 1 / 0)
    assert prompt_scores(df, registry.window_scorer("absent")).first()["prompt_error"] == "division by zero"


def test_folds_of_more_than_a_hundred_classes(spark):
    """No class is left without folds, each is cut evenly, and the cuts are at the ranks of its hashes."""
    rows = [(f"s{k}_{i}", None if k == 0 else k) for k in range(130) for i in range(3 + k % 7)]
    df = spark.createDataFrame(rows, "sample_id string, label int")
    got = MO.with_folds(df, "label").withColumn("h", F.expr(MO.fold_hash("sample_id"))).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"sample_id", "label", "fold", "h"}
    classes = {}
    for r in got:
        classes.setdefault(r.label, []).append((r.h, r.fold))
    for members in classes.values():
        n = len(members)
        assert [fold for _, fold in sorted(members)] == [sum(p > -(-n * i // 3) for i in (1, 2)) for p in range(1, n + 1)]


@pytest.mark.parametrize("measure", [
    lambda df, **k: M.evaluate_risk(df, **k), lambda df, **k: M.brier(df, "label", "risk_score", **k), lambda df, **k: M.ablation(df, **k),
    lambda df, **k: M.family_detection(df, **k), lambda df, **k: M.governance_eval(df, **k)])
def test_unscored_rows_fail_or_are_counted(spark, measure):
    nan = float("nan")
    rows = [(0, nan, .1, nan, "ALLOW", "f", "all"), (1, .9, .2, .9, "BLOCK", "f", "all"), (0, .1, nan, .1, "ALLOW", "f", "all"), (1, None, .9, None, None, "f", "all")]
    df = spark.createDataFrame(rows, "label int, malicious_probability double, vision_score double, risk_score double, decision string, attack_family string, split string")
    with pytest.raises(Exception, match="have no prediction"):
        measure(df).collect()
    got = [r.asDict() for r in measure(df, unscored="count").collect()]
    assert all(r["n_unscored"] in (1, 2, 3) for r in got)
    for r in got:
        assert r.get("fp", 0) == 0 and r.get("brier", 0) == r.get("brier", 0)
        if "tn" in r:
            assert r["tn"] + r["fp"] + r["fn"] + r["tp"] + r["n_unscored"] == 4
    with pytest.raises(ValueError):
        measure(df, unscored="ignore")


def test_correlation_of_incomplete_pairs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (100.0, None), (nan, 7.0)], "x double, y double")
    for narrow in (16, 0):
        got = {(r.a, r.b): r.r for r in P.correlation_matrix(df, ["x", "y"], narrow=narrow).collect()}
        assert got["x", "y"] == pytest.approx(1.0) and got["x", "x"] == got["y", "y"] == 1.0


def test_correlations_of_500_columns(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 500)) @ (np.eye(500) + rng.standard_normal((500, 500)) / 20) + 1e7
    x[rng.random(x.shape) < .05] = np.nan
    x[:, 7] = 3.0
    names = [f"c {i}" for i in range(500)]
    got = P.correlation_matrix(spark.createDataFrame(pd.DataFrame(x, columns=names)), names).toPandas()
    assert len(got) == 500 * 501 // 2
    want = pd.DataFrame(x - 1e7, columns=names).corr()  # exact: pandas itself loses digits to the offset
    at = {n: i for i, n in enumerate(names)}
    mine = got.r.to_numpy(float)
    other = want.to_numpy()[got.a.map(at), got.b.map(at)]
    assert np.array_equal(np.isnan(mine), np.isnan(other)) and np.nanmax(np.abs(mine - other)) < 1e-9
