"""Phrases by index against one regex each; gates observed while a matrix is written."""

import random
import time

import pytest
from pyspark.sql import functions as F

from checks.inputs import TEST_PHRASES
from docguard.fixed_values import FOURTEEN_FEATURES, INJECTION_PHRASES
from docguard.functions import text as T
from docguard.functions.phrases import PhraseIndex
from docguard.operators import texts as X
from docguard.operators.linear import LinearTextModel, load_text_model, save_text_model, windowed_probability, with_window_scores
from docguard.operators.model import fit_text_model, text_probability
from docguard.operators.profile import feature_matrix_summary
from docguard.operators.quality import QualityError
from docguard.plans.feature_matrix import build_feature_matrix, feature_matrix
from docguard.session import exists, new_path


def phrase_texts():
    draw = random.Random(6)
    pieces = [w for p in INJECTION_PHRASES for w in p.split()] + ["x", "Über", "naïve", "a_b", "日本"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "-", ", ", ". ", "\t", " - ", "--", "'"]
    out = ["".join(draw.choice(pieces) + draw.choice(gaps) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    out += [p.upper() for p in INJECTION_PHRASES] + [f"({p})" for p in INJECTION_PHRASES] + [f"x{p}y {p}" for p in INJECTION_PHRASES[:9]]
    return [*out, None, "", " ", "-", "\n\n", "ignore previous previous ignore all", "ignore ignore ignore"]


@pytest.mark.parametrize("phrases", [INJECTION_PHRASES, [*INJECTION_PHRASES, "don't stop", "a-b c", "-dash", "end!", "two  blanks", "ignore previous instructions and x"], ["-x"], []])
def test_index_finds_what_regexes_find(spark, phrases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(phrase_texts() + ["We don't stop a-b c, -dash x-dash end! two  blanks two blanks"])], "i int, t string")
    index = PhraseIndex(phrases)
    plain = T.keyword_hits("t", phrases) if phrases else "array()"
    got = df.selectExpr("i", "t", f"sort_array({plain}) AS plain", f"sort_array({index.hits('t')}) AS hits",
                        f"{T.redact_phrases('t', phrases) if phrases else 't'} AS redacted", f"{index.redacted('t')} AS looked_up").collect()
    assert [r.hits for r in got] == [r.plain for r in got]
    assert [r.looked_up for r in got] == [r.redacted for r in got]
    assert not phrases or sum(len(r.hits) for r in got) > 0


def test_time_does_not_grow_with_phrases(spark):
    words = [f"w{i}" for i in range(500)]
    draw = random.Random(1)
    df = spark.createDataFrame([(" ".join(draw.choice(words) for _ in range(300)),) for _ in range(400)], "t string").persist()
    df.count()

    def seconds(n):
        index = PhraseIndex([f"q{i} r{i % 91} s" for i in range(n)] + ["w1 w2"])
        frame = df.selectExpr(f"{index.density('t')} AS k")
        best = []
        for _ in range(3):
            began = time.perf_counter()
            frame.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        return min(best)

    few, many = seconds(50), seconds(50_000)
    assert many < 4 * few + 1.0


def test_indexed_scorer_equals_plain_one(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(phrase_texts()) if t is not None], "sample_id string, text string")
    one = X.windowed_score(df, X.phrase_scorer(TEST_PHRASES + INJECTION_PHRASES)).select("sample_id", "prompt_score")
    two = X.windowed_score(df, X.indexed_phrase_scorer(TEST_PHRASES + INJECTION_PHRASES)).select("sample_id", "prompt_score")
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_text_models_are_kept(spark):
    model = LinearTextModel([0.5, -1.0, 2.0, 0.0], -0.25)
    path = new_path(spark, "text_model")
    save_text_model(spark, model, path)
    assert load_text_model(spark, path) == model
    df = spark.createDataFrame([("",), (None,), ("one two",), ("w " * 2000,)], "text string")
    got = with_window_scores(df, model).selectExpr("size(_scores) AS n", f"{windowed_probability()} AS p").collect()
    assert [r.n for r in got] == [1, 1, 1, 8] and got[0].p == got[1].p == pytest.approx(1 / (1 + 2.718281828459045 ** .25))


def sources(spark, labels):
    n = len(labels)
    rows = spark.createDataFrame([(f"s{i}", int(x == "malicious"), "f") for i, x in enumerate(labels)], "sample_id string, label int, attack_family string")
    splits = spark.createDataFrame([(f"s{i}", ("train", "validation", "test")[i % 3]) for i in range(n)], "sample_id string, corrected_split string")
    predictions = spark.createDataFrame([(f"s{i}", i / n, "low") for i in range(n)], "sample_id string, malicious_probability double, severity string")
    vision = spark.createDataFrame([(f"s{i}", "p", .5, 1, .1, .1, 0.0, .2, 3, 9, .3) for i in range(n)],
                                   "sample_id string, image_path string, ocr_confidence double, tiny_text_count int, footer_text_density double, watermark_score double, "
                                   "hidden_text_score double, keyword_density double, total_boxes int, total_words int, vision_score double")
    return rows, splits, predictions, vision


def test_gates_while_writing_read_the_sources_once(spark):
    labels, splits, predictions, vision = sources(spark, ["benign", "malicious"] * 30)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(label):
        seen.add(1)
        return label

    path, record = new_path(spark, "matrix"), new_path(spark, "summary")
    stored = build_feature_matrix(labels.withColumn("label", counted("label")), splits, predictions, vision, path, record)
    assert seen.value == 60 and stored.count() == 60
    # a session that has observed could not run such functions
    texts = spark.createDataFrame([("a b", 0), ("c d", 1)] * 5, "text string, label int")
    assert text_probability(texts, fit_text_model(texts, features=16, most_iterations=3)).count() == 10
    summary = feature_matrix_summary(stored, FOURTEEN_FEATURES)
    want = summary.selectExpr("to_json(struct(*)) AS j").first().j
    got = spark.read.schema(summary.schema).json(record).selectExpr("to_json(struct(*)) AS j").first().j
    assert got == want


def test_a_matrix_that_fails_its_gate_replaces_nothing(spark):
    labels, splits, predictions, vision = sources(spark, ["benign", "malicious"] * 10)
    path, record = new_path(spark, "matrix"), new_path(spark, "summary")
    wrong = predictions.withColumn("malicious_probability", F.lit(7.0))
    with pytest.raises(QualityError, match="malicious_probability_range: 20"):
        build_feature_matrix(labels, splits, wrong, vision, path, record)
    twice = labels.unionByName(labels.limit(3))
    with pytest.raises(QualityError, match="unique_ids: 3"):
        build_feature_matrix(twice, splits, predictions, vision, path, record)
    assert not exists(spark, path) and not exists(spark, record)
    assert feature_matrix(labels, splits, predictions, vision).count() == 20
