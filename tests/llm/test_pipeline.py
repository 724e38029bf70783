"""The pipeline's stages, each against a brute-force version on what the one before it wrote."""

import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pytest
from docguard.llm import pieces
from docguard.llm.queries import MIX
from docguard.llm.mixing import mix_sources

sys.path.insert(0, os.path.dirname(__file__))
from test_text_operators import components, expected_join, expected_removal, made, words_of  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    stems = {"en": "the and of with that house water under".split(), "de": "der und mit haus wasser unter nicht brot".split()}
    prose = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["", "n", "er", "lo"]) for _ in range(n))
    shared = prose("en", 30)
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 4 == 3]
        rows.append((i, f"{prose(lang, 50)} {shared if i % 5 == 0 else ''} {prose(lang, 30)}", lang, f"src{i % 20}"))
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(6)]
    rows += [(120 + i, rows[i + 10][1] + " ending", rows[i + 10][2], rows[i + 10][3]) for i in range(6)]
    rows += [(200, None, "en", "src1"), (201, "", None, None), (202, "### 123", "en", "src2")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    return path


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs, columns = spark.read.parquet(folder + "/documents.parquet"), None
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
        assert k == 4 or docs.columns == columns
    start, a, b, c, d, last = [spark.read.parquet(folder + "/documents.parquet"), *kept]
    assert {r[0] for r in rows_of(start)} - {r[0] for r in rows_of(a)} == {200, 201, 202}
    assert sorted(r[0] for r in rows_of(b)) == sorted(i for i, _, least in expected_join(rows_of(a)).elements() if i == least)
    removed = Counter((i, digest) for i, _, _, _, digest in expected_removal(rows_of(b)).elements())
    assert Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in rows_of(c)) == removed
    assert all(r.n_chars == len(r.text) for r in c.collect())
    assert Counter(r[0] for r in rows_of(d)) == Counter(r.doc_id for r in mix_sources(c, MIX).collect())
    vocabulary = pieces.with_cache(pieces.fitted(d, pieces.MODEL, "doc_id", "text"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == Counter(
        (i, tuple(pieces.encode_all(vocabulary, [t])[0].tolist())) for i, t, *_ in rows_of(d))


def test_near_copies_by_five_words_and_four_fifths(spark, tmp_path):
    """The stage against all pairs; one changed word amid 49 leaves 40 of 50 shingles in common, which is enough, and 48 do not."""
    rng = random.Random(3)
    rows = []
    for n in (20, 44, 48, 49, 50, 60, 90):
        base = [f"w{n}x{i}" for i in range(n)]
        rows.append((len(rows), " ".join(base), "en", "s"))
        for k in (1, 1, 1, 2, 3):
            other = list(base)
            for at in [n // 2] if rows[-1][1] == " ".join(base) else rng.sample(range(n), k):
                other[at] = f"new{len(rows)}"
            rows.append((len(rows), " ".join(other), "en", "s"))
    rows += [(len(rows), "one two three four", "en", "s"), (len(rows) + 1, "One two three four", "en", "s"), (len(rows) + 2, "", "en", "s")]
    sets = []
    for _, t, *_ in rows:
        w = words_of(t.lower())
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = components(len(rows), linked)
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    kept = sorted(r.doc_id for r in stage(spark, made(rows, spark), str(tmp_path)).collect())
    assert kept == sorted(set(comp))
    at = {len(words_of(t)): i for i, t, *_ in reversed(rows)}
    assert at[49] + 1 not in kept and at[48] + 1 in kept
    assert kept != sorted(i for i, _, least in expected_join(rows).elements() if i == least)


def test_tokens_come_with_what_they_decode_to(spark, tmp_path):
    texts = ["Two words,  two blanks", "日本語 über 😀", "", None, f"a{pieces.MARK}b"]
    out = dict(corpus_pipeline.STAGES)["pieces"](spark, made([(i, t, "en", "s") for i, t in enumerate(texts)], spark), str(tmp_path))
    got = {r.doc_id: (r.decoded, r.same_text) for r in out.collect()}
    assert got == {0: (texts[0], True), 1: (texts[1], True), 2: ("", True), 3: ("", True), 4: ("a b", False)}


def test_run_is_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 60


def test_entry_without_the_subpackage(tmp_path):
    """The driver's entry still imports where neither the subpackage nor the pipeline is there."""
    code = ("import sys\nclass No:\n def find_spec(self, name, path=None, target=None):\n"
            "  if name.startswith(('docguard.llm', 'corpus_pipeline')):\n   raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
