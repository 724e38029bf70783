"""The filter audit against definitions: every order applied document by document."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from docguard.llm import filter_audit
from docguard.llm.filter_audit import Filter, audit_filters, shapley_weights

DOCS = "doc_id long, text string, lang string, source string, id long, part int, pattern int, n int, digest string, good string"
LABELS = "doc_id long, quality int, toxic int, id int, salt int"


def fails(rows):
    """The set of failed filters of each row, by definition."""
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        out.append({f for f, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
            ("E", i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))) if bad})
    return out


def expected(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, failed) if (lang or "") == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone),
                    sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    prose = lambda n, pool: " ".join(f"w{rng.randrange(pool)}" for _ in range(n))
    texts = [prose(rng.choice([5, 199, 200, 260]), rng.choice([3, 130, 9999])) for _ in range(40)]
    texts = [t.upper() if rng.random() < .3 else t for t in texts]
    texts = [t + rng.choice(["", " #", " |"]) for t in texts]
    texts += [None, "", "", " \t\n", "É" * 50, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "x y x y", prose(30000, 20000), texts[0], texts[0], texts[5]]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (3, texts[3], "de"), (None, texts[4], "en"), (None, texts[4], "en"), (None, None, None), (90, texts[4], "fr")]
    rng.shuffle(rows)
    return rows


def test_audit_filters(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, None, 0), (7, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, 4, "d", "g") for i, t, lang in rows], DOCS)
    marks = spark.createDataFrame([(*x, 1, 2) for x in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(docs, marks).collect()}
    assert got == expected(rows, labels) and len(got) == 600 * len({lang or "" for _, _, lang in rows})


def test_a_text_held_by_a_third(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.kept, r.removed, r.good_lost) for r in got] == [(201, 99, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "abc")], "doc_id long, text string").withColumn("lang", filter_audit.F.lit("x"))
    own = (Filter("x", "length(text) > 1"), Filter("y", "length(text) > 2"), Filter("z", "text = 'a'"))
    got = audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), own)
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got.filter("filter_order = 'yxz'").collect()} == {
        ("yxz", 1): (2, 1, 3), ("yxz", 2): (1, 1, 9), ("yxz", 3): (0, 1, 6)}


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_shapley_weights_equal_the_mean_over_orders(m):
    weights, rng = shapley_weights(m), random.Random(m)
    value = [0] + [rng.randrange(100) for _ in range((1 << m) - 1)]
    for i in range(m):
        total = 0
        for order in permutations(range(m)):
            before = sum(1 << j for j in order[:order.index(i)])
            total += value[before | 1 << i] - value[before]
        assert total == sum(w * v for w, v in zip(weights[i], value))
