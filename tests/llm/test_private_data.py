"""Private data: base spans against Python's re, features, trees and choice against plain Python."""

import hashlib
import re

import numpy as np
import pytest

from docguard.llm import private_data
from docguard.llm.private_data import BASE, FEATURES, KINDS, WIDE, Model, boosted, calibrated, find_private_data, fit, isotonic, private_spans, redacted

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": all(int(p) <= 255 for p in found.split(".")) if kind == "ip" else None,
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_of(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:])))


TEXTS = [
    "mail jo.do@x-y.example.com, a@b.c_d@e.f or x@y; q%+-@1.2.3", "a@b.com@c.de f@g..h i@j.k.", "@a.b .@a.b " * 3,
    "10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000000255.0.0.1 99999999999999999999.1.1.1 1.2.3", "v 1.2.3.4a5.6.7.8.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 4111111111111111 4012888888881881", "4111111111111111 4012888888881881",
    "+1 (415) 555-2671 +49 30 123456 +1 2 +12345678901234567890 ++44 20 7946 0958. (415) 555-2671", "+1.2.3.4.5.6.7.8.9",
    None, "", " \n\t ", "prose without any of it, just words.", "é日本 ü jo@example.org 日 192.168.0.1 é", "1" * 40000, "x" * 40000 + "@a.b",
    "1." * 5000 + "1", "+1 " + " " * 20000, "a" * 30000, ("7 " * 9000), "jo (at) example (dot) com, ann [at] mail7.example.org",
    "word " * 20000 + "4111111111111111", "1\t2 3- 4", "4111111111111111" * 3, "٣٣٣ ４１１１１１１１１１１１１１１１",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "s", 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "s", 2), (None, TEXTS[0], 1, "s", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, k int, base string, s int")


def test_base_spans(spark, docs):
    got = find_private_data(docs, model=Model()).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        base = base_of(TEXTS[0 if r.doc_id is None else r.doc_id])
        assert r.spans == listed(base) and r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in KINDS]


def free_of(text):
    """Proposed spans that overlap no base span, with what stands around them."""
    base = base_of(text)
    out = []
    for kind, pattern in [(k, WIDE[k].replace("*+", "*").replace("++", "+")) for k in KINDS] + list(PLAIN.items()):
        hits = list(re.finditer(pattern, text))
        for i, m in enumerate(hits):
            gap = text[hits[i - 1].end() if i else 0:m.start()]
            after = text[m.end():hits[i + 1].start() if i + 1 < len(hits) else None]
            if not any(s < m.end() and m.start() < e for _, s, e in base):
                out.append((kind, m.start(), m.end(), m[0], gap[-24:], after[:2]))
    return set(out)


def features(kind, text, before, after):
    runs = [len(x) for x in re.findall("[0-9]+", text)]

    def sort_of(c):
        if not c:
            return 0
        return 1 if c in " \t\n\r\f\v" else 2 if c.isalpha() else 3 if c in "0123456789" else 4 if c in '"=:#/_' else 5
    low = before.lower()
    cue = 1 if re.search(r"(?:version|\bv|licen[cs]e|section|page|chapter|token|key|hash|isbn|price|year)\W*$", low, re.A) else \
        2 if re.search(r"(?:mail|phone|tel|call|fax|mobile|card|visa|account|host|address|\bip)\W*$", low, re.A) else 0
    return [KINDS.index(kind), min(31, sum(runs)), min(9, len(runs)), min(31, max(runs, default=0)), min(31, min(runs, default=0)),
            min(31, len(re.findall("[A-Za-z]", text))), min(15, len(re.search("[A-Za-z0-9]*$", text)[0])),
            sort_of(before[-1:]), sort_of(after[:1]), cue]


def test_added_spans_follow_the_trees(spark, docs):
    """A model of given trees: what the SQL adds is what plain Python adds."""
    model = Model(-1.0, [("digits", 9, -1.0, ("longest", 12, 0.5, 2.0)), ("cue", 0, ("before", 1, 0.25, -0.5), 0.75), ("letters", 4, 0.0, 0.6)],
                  {0: -1.2, 2: 1.0, 3: -0.4})
    got = {(r.doc_id, tuple((KINDS[x.k], x.s, x.e) for x in r.added)) for r in private_spans(docs, model).collect()}
    want, some = set(), 0
    for i, text in [*enumerate(TEXTS), (None, TEXTS[0])]:
        passed = set()
        for kind, s, e, *rest in free_of(text or ""):
            k = KINDS.index(kind)
            if k in model.thresholds and model.score(np.array([features(kind, *rest)]))[0] >= model.thresholds[k]:
                passed.add((k, s, e))
        kept = [m for m in passed if not any(x[1] <= m[1] and m[2] <= x[2] and (x[2] - x[1] > m[2] - m[1] or x[0] < m[0]) for x in passed)]
        some += len(kept)
        want.add((i, tuple((KINDS[k], s, e) for k, s, e in sorted(kept))))
    assert got == want and some > 5


def test_fit_finds_numbers_with_a_wrong_digit(spark):
    """Numbers like checked ones are added although their check fails; versions and years are not."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        card = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card += next(c for c in "0123456789" if luhn(card + c))
        if i % 4 == 0:
            card = card[:-1] + str((int(card[-1]) + 3) % 10)
        rows.append((i, f"pay with {card} now, version {i % 9}.{i % 7} of {1900 + i % 120} or 20{i % 90 + 10}-10-{i % 20 + 10}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs)
    got = find_private_data(docs, model=model).collect()
    assert {r.doc_id for r in got if r.spans} == set(range(400))
    assert all(r.spans.startswith("card:9:25") and r.n_card == (r.doc_id % 4 != 0) for r in got)
    assert all(r.spans == "card:9:25" for r in got)
    assert find_private_data(docs).exceptAll(find_private_data(docs, model=model)).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 8, (3000, len(FEATURES)))
    rows[:, 0] = rng.integers(0, 2, 3000)
    true = (rows[:, 1] > 3) & (rows[:, 2] < 6)
    y = (true & (rng.random(3000) < .6)).astype(float)
    model = calibrated(boosted(rows[:2000], np.ones(2000), y[:2000]), rows[2000:], np.ones(1000), y[2000:])
    score = model.score(rows)
    assert set(model.thresholds) == {0, 1}
    chosen = score >= np.array([model.thresholds[k] for k in rows[:, 0]])
    assert (chosen == true).mean() > .97
    values, rates = isotonic(np.array([1., 2., 2., 3., 4.]), np.ones(5), np.array([1., 0., 0., 1., 1.]))
    assert values.tolist() == [1, 2, 3, 4] and np.allclose(rates, [1 / 3, 1 / 3, 1, 1])


def test_model_sql_equals_score(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 8, (200, len(FEATURES)))
    model = boosted(rows, np.ones(200), (rows[:, 3] > 4).astype(float), rounds=5)
    frame = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{f} int" for f in FEATURES))
    named = ", ".join(f"'{f}', {f}" for f in FEATURES)
    got = frame.selectExpr("i", f"named_struct('f', named_struct({named})) AS m").selectExpr("i", f"{model.sql()} AS v").orderBy("i").collect()
    assert np.allclose([r.v for r in got], model.score(rows), atol=1e-12)


def test_redacted(spark):
    frame = spark.createDataFrame([("call é 10.0.0.1 or x@y.de.",)], "t string")
    spans = "array(named_struct('k', 0, 's', 19, 'e', 25), named_struct('k', 1, 's', 7, 'e', 15), named_struct('k', 2, 's', 8, 'e', 12))"
    assert frame.selectExpr(redacted("t", spans)).first()[0] == "call é [IP] or [EMAIL]."


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_private_data(docs).collect() == []
    assert fit(spark.createDataFrame([(1, "no numbers"), (2, None)], "doc_id long, text string")).trees == []


def test_patterns_are_those_stated():
    """Without lookbehinds and possessive marks the base patterns are the stated ones."""
    plain = {k: re.sub(r"\(\?:\\G\|\(\?<![^)]*\)\)|\(\?<![^)]*\)", "", p).replace("++", "+").replace("(?:", "(") for k, p in BASE.items()}
    assert plain["email"] == PLAIN["email"] and plain["card"] == PLAIN["card"] and plain["phone"] == PLAIN["phone"]
    assert plain["ip"].replace(r"\.", ".") == "[0-9]+.[0-9]+.[0-9]+.[0-9]+"
    assert private_data.KINDS == ("email", "ip", "card", "phone")
