"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docguard.llm import (
    embedding_dedup, jaccard_join, language, mixing, pieces, quality_rules, reply_trees, substring_dedup, toxicity, warc,
)

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, shingle string, part int, `chunk` int, id string"


def made(rows, spark, schema=DOCS):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, 1, 2, "s", 3, 4, "z") for i, t, lang, src in rows], schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(30, 120)) for _ in range(25)]
    shared = prose(40)
    out = list(base)
    for t in base[:8]:
        w = t.split()
        for k in range(1, 3):
            v = list(w)
            for at in rng.sample(range(len(v)), k):
                v[at] = rng.choice(words)
            out.append(" ".join(v))
    out += [f"{prose(15)} {shared} {prose(15)}" for _ in range(30)]
    out += [base[3], base[3], base[3].upper(), None, "", "   \n\t", "one", "one two", "ONE two", "ab " * 200, LONG, LONG + " end",
            "é" * 60, "x" * 49, "x" * 50, "x" * 51, "日本語" * 40, "a\x00b " * 30, f"{prose(60)}\n" * 3]
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 4}") for i, t in enumerate(out)]
    rows += [(7, base[9], None, None), (7, base[9], None, None), (None, base[5], "en", None)]
    rng.shuffle(rows)
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# --- 4: shingle join ---------------------------------------------------------------------------------------------


def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 4 else {tuple(w[i:i + 4]) for i in range(len(w) - 3)}


def components(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


def expected_join(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = components(len(rows), linked)
    ids = [r[0] for r in rows]
    least = {c: min((ids[i] for i in range(len(rows)) if comp[i] == c and ids[i] is not None), default=None) for c in comp}
    return Counter((ids[i], len(sets[i]), least[comp[i]] if sets[i] else ids[i]) for i in range(len(rows)))


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(hot=2, chunk=3000, block=4, chain=1), jaccard_join.Settings(hot=2, chunk=3000, block=4, chain=12)])
def test_shingle_join(spark, texts, settings):
    got = Counter(tuple(r) for r in jaccard_join.shingle_join(made(texts, spark), settings).collect())
    assert got == expected_join(texts)


def test_long_list_of_sets_that_differ(spark):
    """Members of a long list are compared even if its first block links none of them."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(common + [f"u{i // 2}_{k}" for k in range(3)] + ([f"v{i}"] if i % 2 else [])), "en", "s"))
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in jaccard_join.shingle_join(made(rows, spark), jaccard_join.Settings(hot=2, chunk=500, block=4, chain=3)).collect())
    assert got == expected_join(rows)


def test_blocks_are_skipped_by_size_and_place(spark):
    """A long list of sets of many sizes and places: the directory drops most pairs of blocks and no link."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        n = 12 + 4 * (i // 2 % 20)
        own = [f"u{i // 2}_{k}" for k in range(n)]
        if i % 2:
            own[rng.randrange(n)] = f"v{i}"
        rows.append((i, " ".join([*own[:n // 2], "all", "of", "these", "share", *own[n // 2:]]), "en", "s"))
    settings = jaccard_join.Settings(hot=2, chunk=900, block=4, chain=2, percent=40)
    got = Counter(tuple(r) for r in jaccard_join.shingle_join(made(rows, spark), settings).collect())
    sets = [shingles(t) for _, t, *_ in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 40 * len(sets[i] | sets[j])])
    assert got == Counter((i, len(sets[i]), comp[i]) for i in range(len(rows)))
    # the directory itself: sizes and places drawn, every pair of members that the bounds allow meets once
    data = [("t", i, i, n, b, n - 2 - b) for i in range(150) for n in [rng.randint(10, 60)] for b in [rng.randint(0, n // 3)]]
    data = [(7, sid, known, n, b, a, int(math.log(n) * 25), int(math.log(a + 1) * 25)) for _, sid, known, n, b, a in data]
    located = spark.createDataFrame(data, "shingle long, sid long, known long, n long, before long, after long, size int, depth int")
    settings = jaccard_join.Settings(block=3)
    placed = jaccard_join.block_pairs(located, jaccard_join.meeting_blocks(located, settings)).collect()
    groups = defaultdict(list)
    for r in placed:
        groups[tuple(r[:7])].append(r.sid)
    assert all(len(g) == len(set(g)) <= 2 * 20 for g in groups.values())
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    allowed = {(x[1], y[1]) for x in data for y in data if x[1] < y[1] and 100 * min(x[3], y[3]) >= 85 * max(x[3], y[3])
               and 185 * (min(x[4], y[4]) + 1 + min(x[5], y[5])) >= 85 * (x[3] + y[3])}
    assert allowed <= met and len(met) < 0.5 * 150 * 149 / 2


def test_buckets_follow_the_bytes(spark, texts, monkeypatch):
    """More buckets than shuffle partitions give the same links and cuts."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    docs = made(texts, spark)
    total = sum(len((t or "").encode()) for _, t, *_ in texts)
    chunks = spark.createDataFrame([(1, [total - 5, 5])], "chunk long, sizes array<long>")
    assert substring_dedup.key_buckets(chunks) == -(-total // 20_000) > 8
    assert Counter(tuple(r) for r in jaccard_join.shingle_join(docs, jaccard_join.Settings(hot=2, chunk=3000)).collect()) == expected_join(texts)
    got = substring_dedup.substring_digests(docs).collect()
    assert Counter(tuple(r) for r in got) == expected_removal(texts)


def test_derived_answers_equal_counted_ones():
    rng = np.random.default_rng(2)
    base = rng.choice(1 << 40, 200, replace=False).astype(np.uint64)
    sets = []
    for k in range(60):
        s = base.copy()
        at = rng.choice(200, rng.integers(0, 25), replace=False)
        s[at] = rng.choice(1 << 40, len(at), replace=False).astype(np.uint64)
        sets.append(np.unique(s))
    plain = [set(x.tolist()) for x in sets]
    linked = [(i, j) for i in range(60) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])]
    got = jaccard_join.list_links(sets, np.array([len(s) for s in sets]), np.arange(60), 85)
    assert got.tolist() == components(60, linked)


def test_one_of_each_keeps_one(spark, texts):
    kept = jaccard_join.one_of_each(made(texts, spark))
    assert kept.columns == made(texts, spark).columns
    joined = {r[0]: r[2] for r in expected_join(texts)}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in joined.items() if i == c or i is None}


# --- 3: substrings -----------------------------------------------------------------------------------------------


def expected_removal(rows, length=50):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t, *_ in order:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s:s + length], i)
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] != i:
                gone[s:s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [2, 64])
def test_only_first_records_that_may_share_a_string_are_ranked(spark, hot):
    """Copies are settled by their prints, short common strings by their contexts; what is ranked does not grow with the copies."""
    from docguard.llm.common import Handoff
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    body, passage = word(1500), word(200)
    settings = substring_dedup.Settings(chunk=2000, hot=hot)

    def ranked(texts):
        docs, hand = made([(i, t, "en", "a") for i, t in enumerate(texts)], spark), Handoff(spark, "test")
        got = {r.id: bytes(r.kept).decode() for r in substring_dedup.cleaned(docs, settings, hand=hand).collect()}
        masks = spark.read.parquet(hand.paths["masks"])
        n = masks.filter(masks.kind.isin(substring_dedup.RECORDS, substring_dedup.STRINGS)).selectExpr("sum(length(masks)) AS n").first().n or 0
        hand.drop()
        substring_dedup.drop_tables(spark)
        return got, n

    few = ranked([body] * 3)[1]
    got, n = ranked([body] * 30)
    assert got == {0: body} | {i: "" for i in range(1, 30)} and n <= 1.5 * few
    common = word(30)
    texts = [word(700) + common + word(700) for _ in range(30)]
    got, n = ranked(texts)
    assert got == dict(enumerate(texts)) and n == 0
    texts = [word(700) + passage + word(700) for _ in range(30)]
    got, n = ranked(texts)
    digests = {i: digest for i, _, _, _, digest in expected_removal(list(enumerate(texts)))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == digests and n > 0


@pytest.mark.parametrize("settings", [substring_dedup.Settings(), substring_dedup.Settings(chunk=2000, hot=2)])
def test_substrings(spark, texts, settings):
    got = Counter(tuple(r) for r in substring_dedup.substring_digests(made(texts, spark), settings).collect())
    assert got == expected_removal(texts)


def test_substrings_of_one_letter_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 256)
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 700))), "en", "s") for i in range(12)] + [(20, "a" * 300, "en", "s"), (21, "a" * 120 + "b" * 80, "en", "s")]
    data = "".join(t for _, t, *_ in rows).encode()
    offsets = np.cumsum([0] + [len(t) for _, t, *_ in rows])
    place, begin, end, doc, h = substring_dedup.triggered(np.frombuffer(data, np.uint8), offsets, substring_dedup.Settings())
    seen = defaultdict(set)
    for p, b, e, k in zip(place, begin, end, h):
        for s in range(b, e + 1):
            seen[data[s:s + 50]].add((p - s, int(k)))
    assert all(len(v) == 1 for v in seen.values())  # equal strings have their trigger at one place
    assert sum(e - b + 1 for b, e in zip(begin, end)) == sum(max(0, len(t) - 49) for _, t, *_ in rows)
    got = Counter(tuple(r) for r in substring_dedup.substring_digests(made(rows, spark)).collect())
    assert got == expected_removal(rows)


def test_without_repeats_keeps_columns(spark, texts):
    docs = made(texts, spark)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)


def test_batches_of_long_rows_are_bounded(spark):
    """Rows of a megabyte, as chunks of texts are, do not come to a worker dozens at once."""
    from docguard.session import BATCH_BYTES, small_batches

    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    small_batches(spark)
    rows = spark.range(0, 48, 1, 1).selectExpr("repeat('x', 1 << 20) AS t").mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in rows) >= 48 << 20 and max(r.n for r in rows) < 2 * BATCH_BYTES


def left_in_workers(spark):
    """What the session's Python workers hold in their caches: bytes of pieces, and powers of the rolling hash."""
    def probe(batches):
        import time

        import pyarrow as pa
        from docguard.llm import common
        for _ in batches:
            time.sleep(0.2)  # so that no worker does it all
        yield pa.RecordBatch.from_arrays([pa.array([pieces._CACHE["bytes"]]), pa.array([sum(len(x) for x in common._POWERS.values())])], ["pieces", "powers"])

    return [tuple(r) for r in spark.range(0, 32, 1, 32).mapInArrow(probe, "pieces long, powers long").collect()]


def test_workers_forget_between_tasks(spark, texts, vocabulary):
    """Workers live on: what a stage leaves in them is held beside the needs of all later ones."""
    pieces.encode_texts(made(texts, spark), vocabulary=vocabulary).collect()
    substring_dedup.without_repeats(made(texts, spark)).collect()
    substring_dedup.drop_tables(spark)
    assert set(left_in_workers(spark)) == {(0, 0)}


def test_tidy_functions_forget_at_their_end():
    """Also if they fail, or are not read to their end; results stay."""
    from docguard.llm.common import tidy

    seen = []
    forget = lambda: seen.append(1)

    def rows(batches):
        yield from batches

    assert list(tidy(rows, forget)([1, 2])) == [1, 2] and len(seen) == 1
    begun = tidy(rows, forget)([1, 2])
    next(begun)
    begun.close()
    assert len(seen) == 2
    with pytest.raises(ZeroDivisionError):
        tidy(lambda table: 1 // table, forget)(0)
    assert tidy(lambda table: 1 // table, forget)(1) == 1 and len(seen) == 4


# --- 2: vectors --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("settings", [embedding_dedup.Settings(), embedding_dedup.Settings(cell_rows=15, block_rows=16),
                                      embedding_dedup.Settings(cell_rows=80, block_rows=6, ringed_blocks=1)])
def test_vectors(spark, settings):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(160):
        v = base[i % 40] + rng.normal(scale=0.12 * (i % 3), size=8)
        rows.append((i, [float(x) for x in (v if i % 7 else base[i % 40] * (i + 1))], i % 2 if i % 11 else None, 1, 2, 3))
    rows += [(200, None, 1, 1, 2, 3), (201, [0.0] * 8, 1, 1, 2, 3), (202, [float("nan")] * 8, 1, 1, 2, 3), (203, [1.0, None] * 4, 1, 1, 2, 3),
             (204, [float("inf")] + [1.0] * 7, 1, 1, 2, 3), (205, [], 1, 1, 2, 3), (206, [1.0, 2.0], 1, 1, 2, 3), (207, [2.0, 4.0], 1, 1, 2, 3),
             (3, rows[3][1], 1, 1, 2, 3), (3, rows[3][1], 1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, `group` int, cell int")
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df, settings).select("vec_id", "n_links", "component_id", "kept").collect())

    def ok(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    linked = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok(rows[i]) and ok(rows[j]) and rows[i][2] == rows[j][2]
              and len(rows[i][1]) == len(rows[j][1])
              and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.98]
    comp = components(len(rows), linked)
    n = Counter(i for i, _ in linked)
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    assert got == Counter((r[0], n[i], least[comp[i]], r[0] == least[comp[i]]) for i, r in enumerate(rows))


# --- 1: mixing ---------------------------------------------------------------------------------------------------


def water(budget, rooms, weights):
    """Shares by weight, none above its room, by repeated rounds."""
    out = {k: 0.0 for k in rooms}
    active, rest = set(rooms), min(budget, sum(rooms.values()))
    while active and rest > 1e-9:
        total = sum(weights[k] for k in active)
        full = {k for k in active if out[k] + rest * weights[k] / total >= rooms[k] - 1e-12}
        if not full:
            for k in active:
                out[k] += rest * weights[k] / total
            break
        for k in full:
            rest -= rooms[k] - out[k]
            out[k] = rooms[k]
        active -= full
    return out


def test_mixing_budgets_and_prefixes(spark, texts):
    mix = mixing.Mix(domain_of={"src0": "a", "src1": "a", "src2": "b"}, weights={"domain": {"a": 0.2, "b": 0.7}, "lang": {"en": 3.0}}, share=0.9, max_epochs=3)
    docs = made(texts, spark)
    got = mixing.mix_sources(docs, mix).collect()
    leaf = lambda s, lang: ({"src0": "a", "src1": "a", "src2": "b"}.get(s, "other"), lang or "unknown", s or "unknown")
    supply = Counter()
    for _, t, lang, s in texts:
        supply[leaf(s, lang)] += len(words_of(t))
    supply = {k: v for k, v in supply.items() if v}
    given = {(): 0.9 * sum(supply.values())}
    for depth, weights in enumerate(({"a": 0.2, "b": 0.7}, {"en": 3.0}, {})):
        new = {}
        for parent, budget in given.items():
            rooms = Counter()
            for k, v in supply.items():
                if k[:depth] == parent:
                    rooms[k[:depth + 1]] += 3 * v
            new |= water(budget, rooms, {k: weights.get(k[-1], 1.0) for k in rooms})
        given = new
    # the documents that each leaf takes: whole epochs, and of the next the first by hash until the budget is reached
    taken, expected = Counter(), Counter()
    for r in got:
        key = (r.domain, r.lang, r.source)
        assert abs(r.leaf_budget - given[key]) < 0.01
        taken[(*key, r.doc_id, r.epoch)] += 1
    for key, budget in given.items():
        full = min(int(budget // supply[key]), 3)
        ids = [(i, len(words_of(t))) for i, t, lang, s in texts if leaf(s, lang) == key]
        frame = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(ids)], "k int, id long").selectExpr("k", f"xxhash64({mix.seed}, {full}, id) AS place")
        places = {r.k: r.place for r in frame.collect()}
        order = sorted(range(len(ids)), key=lambda k: (places[k], ids[k][0] is not None, ids[k][0] or 0))
        begins, last = 0, None
        for k in order:
            if begins < budget - full * supply[key] - 1e-6:
                last = k
            begins += ids[k][1]
        named = lambda k: (places[k], ids[k][0] is not None, ids[k][0] or 0)
        for k, (i, _) in enumerate(ids):
            for epoch in range(1, full + 1 + (last is not None and named(k) <= named(last))):
                expected[(*key, i, epoch)] += 1
    assert taken == expected
    epochs = defaultdict(set)
    for r in got:
        epochs[r.domain, r.lang, r.source, r.doc_id].add(r.epoch)
    assert all(e == set(range(1, max(e) + 1)) for e in epochs.values())
    again = sorted(map(str, mixing.mix_sources(docs.repartition(5), mix).collect()))
    assert again == sorted(map(str, got))
    rows = mixing.mixed_texts(docs, mix)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in got)


# --- 5: language -------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the and of with that house water under".split(), "de": "der und mit haus wasser unter nicht schön".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(rng.randint(3, 40))), x, f"h{i % 3}") for i in range(80) for x in [("en", "de")[i % 2]]]
    rows += [(100, rows[0][1], "de", "h1"), (101, "", "en", "h1"), (102, None, None, None), (103, "12345 ###", "en", "h1"), (104, "a", "en", "h0"),
             (105, "жуй чай щука эхо юла " * 20, None, None), (106, LONG, "en", "h2"), (0, rows[0][1], "en", "h0"), (None, rows[1][1], "de", "h1")]
    docs = made(rows, spark)
    settings = language.Settings(least_texts=2)
    out = {r.id: r for r in language.identify_languages(language.document_evidence(docs), settings=settings).collect()}
    assert all(out[i].language == x and out[i].kept for i, _, x, _ in rows[:80])
    assert out[100].language == "en" and out[None].language == "de"
    assert not out[101].kept and not out[102].kept and not out[103].kept and not out[105].kept and out[105].language == "und"
    assert out[104].kept
    kept = language.in_accepted_language(docs, settings=settings)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(i for i, *_ in rows if i is not None and i not in (101, 102, 103, 105))
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de-AT"><body><script>the and of</script><p>der und mit haus</p></body></html>'), (2, None, None)],
                                  "page_id long, url string, html string")
    row = language.page_evidence(pages).orderBy("id").collect()[0]
    assert (row.declared, row.suffix, row.host, row.text.split()) == ("de", "de", "a.example.de", "der und mit haus".split())


def test_every_declared_language_counts(spark):
    """More languages than 64, some of one row; a table of fewer than five rows; text of no declared language stays out."""
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "αβγδεζηθικλμνξοπρστυφχψω"]
    rows, n = [], 0
    for k in range(90):
        letters = alphabets[k % 3]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(40)]
        for _ in range(1 + k % 4 if k >= 70 else 6):
            rows.append((n, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40))), f"l{k:02}", f"h{n % 7}"))
            n += 1
        if k in (3, 40, 69):  # none declared: the text tells
            rows.append((1000 + k, " ".join(rng.choice(words) for _ in range(30)), None, None))
    rows += [(2000, "日本語の文章はここにあります " * 10, None, None), (2001, "mmm", "rare", None), (2002, "x", "once", None)]
    settings = language.Settings(languages=7, numbers=200)
    out = {r.id: r for r in language.identify_languages(language.document_evidence(made(rows, spark)), settings=settings).collect()}
    assert all(out[i].language == x and out[i].kept for i, _, x, _ in rows if i < 1000)
    assert all(out[1000 + k].language == f"l{k:02}" and out[1000 + k].kept for k in (3, 40, 69))
    assert out[2000].language == "und" and not out[2000].kept
    assert out[2001].language == "rare" and out[2002].language == "once"
    few = [(1, "the house under that water and this", "en", "a"), (2, "дом стоит под водой", "ru", "a"), (3, "das Haus steht nicht unter Wasser", "de", None)]
    out = language.identify_languages(language.document_evidence(made(few, spark))).collect()
    assert {(r.id, r.language, r.kept) for r in out} == {(1, "en", True), (2, "ru", True), (3, "de", True)}
    assert language.in_accepted_language(made(few, spark)).count() == 3


# --- 6: pieces ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary(spark, texts):
    raw = pieces.read_model(pieces.MODEL)
    return pieces.with_cache(pieces.load(raw, pieces.piece_counts(made(texts, spark), raw)))


def test_scores_are_logs_of_counted_shares(spark, texts):
    import sentencepiece
    raw = pieces.read_model(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    want = Counter(i for _, t, *_ in texts for i in library.encode(t or ""))
    counts = pieces.piece_counts(made(texts, spark), raw)
    assert {i: int(n) for i, n in enumerate(counts) if n} == dict(want)
    scores = pieces.load(raw, counts).scores
    plain = [i for i in range(len(counts)) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    total = sum(counts[i] + pieces.SMOOTHING for i in plain)
    assert np.allclose(scores[plain], [np.log((counts[i] + pieces.SMOOTHING) / total) for i in plain])
    assert abs(np.exp(scores[plain]).sum() - 1) < 1e-9
    few = pieces.piece_counts(made(texts, spark), raw, documents=5)
    assert 0 < few.sum() < counts.sum() and pieces.piece_counts(made([], spark), raw).sum() == 0


def test_scores_count_every_text(spark):
    """More texts than any sample of them; words that a sample would miss, runs of spaces, edges, markers, lone spaces."""
    import sentencepiece
    raw = pieces.read_model(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    odd = ["  two  spaces ", " ", "   ", "a ", " b", "a▁b", "▁", "▁▁ x", "tab\tline\n end", "日本語 😀", "a\x00b  c", "", None, "word" * 500]
    texts = [(i, f"rare{i} the house {'Ω' * (i % 5)} end", "en", "a") for i in range(4500)] + [(9000 + i, t, "en", "a") for i, t in enumerate(odd)]
    want = Counter(i for _, t, *_ in texts for i in library.encode(t or ""))
    counts = pieces.piece_counts(made(texts, spark), raw)
    assert {i: int(n) for i, n in enumerate(counts) if n} == dict(want)
    fitted = pieces.fitted(made(texts, spark), pieces.MODEL, "doc_id", "text")
    assert np.array_equal(fitted.scores, pieces.load(raw, counts).scores)


def best_score(v, text):
    """Highest sum of scores over all cuts of a text, unknown characters as in the operator."""
    by = {p: s for i, (p, s) in enumerate(zip(v.pieces, v.scores)) if i > 258}
    score = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        if text[j - 1] not in by:
            score[j] = score[j - 1] + v.floor
        for i in range(max(0, j - v.longest), j):
            if text[i:j] in by:
                score[j] = max(score[j], score[i] + by[text[i:j]])
    return score[-1]


def test_pieces_are_a_best_path(vocabulary):
    rng = random.Random(7)
    texts = ["hello world", " two  spaces   three ", "über naïve Größe", "日本語 text", "x" * 200, "tab\tline\nend", "😀 ok", ""]
    texts += ["".join(rng.choice("abcde thinrs") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    own = {b: i for b, i in enumerate(vocabulary.byte_ids)}
    for t, ids in zip(texts, pieces.encode_all(vocabulary, texts)):
        assert pieces.decoded(vocabulary, ids) == t == pieces.fast_decoded(vocabulary, ids)
        marked = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
        known = set(own.values())
        total, at = 0.0, 0
        for i in ids:
            if int(i) not in known:
                total += vocabulary.scores[i]
        unknown = [c for c in marked if vocabulary.code[ord(c)] == 0 or c not in set(vocabulary.pieces)]
        assert abs(total + vocabulary.floor * len(unknown) - best_score(vocabulary, marked)) < 1e-6


def test_pieces_are_no_worse_than_the_library_in_unigram_mode():
    """The library sums in single precision, in which scores of -1e9 drown small ones; its path is never the better one."""
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabulary = pieces.with_cache(pieces.load(pieces.read_model(pieces.MODEL)))
    raw = pieces.read_model(pieces.MODEL) + bytes([0x12, 0x02, 0x18, 0x01])  # trainer_spec.model_type = unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["of that house and water", "the reading of things", "nothing ventured nothing gained", "Größe"]
    for t, ids in zip(texts, pieces.encode_all(vocabulary, texts)):
        theirs = library.encode(t)
        assert pieces.decoded(vocabulary, theirs) == t
        assert sum(vocabulary.scores[i] for i in ids) >= sum(vocabulary.scores[i] for i in theirs)


def test_segments_seen_again_stay_known(vocabulary, monkeypatch):
    """A full cache loses what was not seen lately; a segment of every batch is encoded once. Ids are those of an empty cache."""
    pieces.with_cache(vocabulary)
    pieces._CACHE.update(known={}, older={}, bytes=0)
    batches = [["house under " + " ".join(f"w{b}x{k}" for k in range(40)), f"a▁b ☃{b} 𝕏", ""] for b in range(30)]
    want = [[vocabulary.long_segment(s) for s in pieces.segments_of(t)] for texts in batches for t in texts]
    asked = Counter()
    encode = vocabulary.segments_bytes
    monkeypatch.setattr(vocabulary, "segments_bytes", lambda segments: asked.update(segments) or encode(segments), raising=False)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    got = [ids.tolist() for texts in batches for ids in pieces.encode_all(vocabulary, texts)]
    assert got == [sum(x, []) for x in want]
    assert asked["▁house"] == asked["▁under"] == 1
    assert len(pieces._CACHE["known"]) + len(pieces._CACHE["older"]) < 400 < len(asked)


def test_long_segments_equal_short_ones(vocabulary):
    pieces.with_cache(vocabulary)
    text = "▁" + "thinkingwater" * 3
    assert vocabulary.long_segment(text) == vocabulary.segments_ids([text])[0]


def test_encoding_in_spark(spark, texts, vocabulary):
    got = pieces.encode_texts(made(texts, spark), ["doc_id", "id", "n"]).collect()
    pieces.with_cache(vocabulary)
    expected = Counter((i, tuple(pieces.encode_all(vocabulary, [t or ""])[0].tolist()), t or "") for i, t, *_ in texts)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == expected
    assert all(r.same_text for r in pieces.encoding_digests(made(texts, spark)).collect())


# --- 7: archives -------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    same = "<html>same\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(5, "http://www.b.example.com/x#f", same), (2, "https://a.example.com/p?q=1", same), (9, None, None), (8, "http://c.org", ""),
            (7, "http://a.example.com:80/p?q=1", "ü" * 9000), (4, "http://a b\t.com/", "x"), (None, "http://n.org/", "alone"), (5, "http://b.example.com/x", same)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, place int, digest string")
    got = Counter(tuple(r) for r in warc.archived(pages).collect())
    import base64
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        first.setdefault(h or "", i)
    expected, seen = Counter(), set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = (h or "") in seen
        seen.add(h or "")
        expected[i, len(b), digest, "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert got == expected
    files, index = str(tmp_path / "files"), str(tmp_path / "index")
    warc.write_archives(pages, files, warc.Handoff(spark, "t"), records_per_file=3)
    warc.build_index(spark, files, index, entries_per_block=2)
    found = warc.lookup(spark, index, "http://A.example.com/p?q=1")
    assert sorted(h["WARC-Record-ID"] for h, _ in found) == ["<urn:page:2>", "<urn:page:7>"]
    assert {p.decode() for _, p in found} == {same, "ü" * 9000}
    assert warc.lookup(spark, index, "http://nowhere.example/") == []


def test_records_are_read_through_the_index(spark, tmp_path):
    """What no entry of the index names is not read, be it damaged; an entry that names another record's place is an error."""
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"text {i}") for i in range(7)], "page_id long, url string, html string")
    files, index = str(tmp_path / "files"), str(tmp_path / "index")
    warc.write_archives(pages.coalesce(1), files, warc.Handoff(spark, "t"), records_per_file=100)
    built = warc.build_index(spark, files, index)
    assert sorted(r.page_id for r in warc.read_records(spark, files, built).collect()) == list(range(7))
    (archive,) = (tmp_path / "files").glob("part-*")
    with open(archive, "ab") as f:
        f.write(b"no record at all")
    (tmp_path / "files" / f".{archive.name}.crc").unlink(missing_ok=True)
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_records(spark, files, built).collect()}
    assert got == {i: (6, "response") for i in range(7)}
    data = archive.read_bytes()
    archive.write_bytes(data.replace(b"urn:page:3", b"urn:page:4"))
    with pytest.raises(Exception, match="the index has <urn:page:3> where <urn:page:4> is"):
        warc.read_records(spark, files, built).collect()


# --- 8: quality --------------------------------------------------------------------------------------------------


def expected_measures(text):
    t = text or ""
    w, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(8)}
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_quality_measures(spark, texts):
    rows = [*texts, (500, "# | <> " * 30, "en", "s"), (501, "a b c d e f g h " * 9, "en", "s"), (502, "\n\nline one here\nline one here\n", "en", "s")]
    got = quality_rules.judge_quality(made(rows, spark)).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *expected_measures(t)) for i, t, *_ in rows)
    assert all(not r.kept for r in got if r.base_failed) and not next(r for r in got if r.doc_id == 500).kept


def test_cascade_order_does_not_change_verdicts(spark, texts):
    df = made(texts, spark)
    a = Counter(map(tuple, quality_rules.judge_quality(df).collect()))
    b = Counter(map(tuple, quality_rules.judge_quality(df, rules=quality_rules.RULES[::-1], sample_rows=3).collect()))
    assert a == b


# --- 9: chat -----------------------------------------------------------------------------------------------------


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant \\ <\\| \\\\n\n<|"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 2, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", ""),
            (2, 5, "a\nb<|im_end|>", "x"), (2, None, "user", "first"), (3, 0, "assistant", "é😀"), (None, 0, "user", "lost")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(70)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, node int, tree int")
    got = {r.conv_id: tuple(r)[1:] for r in reply_trees.digests(reply_trees.format_trees(reply_trees.chained(df, "conv_id", "turn", "role", "text"))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, value in got.items():
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert value[:4] == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees_choose_the_best_branch(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9),
             (1, 5, 2, "user", "less", 0.1), (2, 1, 99, "user", "orphan", None), (3, 1, None, "user", "tie", 1.0), (3, 2, 1, "a", "x", 1.0), (3, 3, 1, "a", "y", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    rows = reply_trees.read_back(reply_trees.format_trees(df, branches=2)).collect()
    said = {(r.tree, r["rank"]): [t["text"] for t in r.turns] for r in rows}
    assert said == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "bad", "less"], (2, 1): ["orphan"], (3, 1): ["tie", "x"], (3, 2): ["tie", "y"]}


@pytest.mark.parametrize("links", [[(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)]])
def test_rings_fail(spark, links):
    nodes = spark.createDataFrame([("t", n, p, "user", "x", 0.0) for n, p in links], "tree string, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="ring"):
        reply_trees.format_trees(nodes)


# --- 10: toxicity ------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_their_misspellings(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}{c}{d}" for a in "bdl" for b in "aeo" for c in "nrt" for d in "aio"]
    bad = ["grumblix", "snorvack", "plobbern"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    extra = [(1000, "lara grumblixx dena boti", "en", "s"), (1001, "", "en", "s"), (1002, None, "en", "s"), (1003, "... !!", "en", "s"), (0, rows[0][1], "en", "s"),
             (None, "dena boti", "en", "s")]
    df = made(rows + extra, spark)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    settings = toxicity.Settings(buckets=1 << 12, toxic_rows=80, clean_rows=200)
    model = toxicity.fit(df, lab, settings)
    out = {r.doc_id: r for r in toxicity.score_texts(df, model, settings).collect()}
    held = [i for i in range(400) if out[i].held_out]
    import zlib
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert out[1000].score > 0.5 and out[None].score < 0.5
    assert all(0 <= out[i].score <= 1 for i in (1001, 1002, 1003))


# --- all: empty tables -------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = made([], spark)
    assert jaccard_join.shingle_join(docs).count() == 0
    assert jaccard_join.one_of_each(docs).count() == 0
    assert substring_dedup.substring_digests(docs).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 0
    assert mixing.mix_sources(docs, mixing.Mix()).count() == 0
    assert mixing.mixed_texts(docs, mixing.Mix()).count() == 0
    assert language.in_accepted_language(docs).count() == 0
    assert pieces.encode_texts(docs).count() == 0
    assert quality_rules.judge_quality(docs).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_texts(docs, toxicity.fit(docs, lab)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicate_vectors(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0
    chat = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert reply_trees.digests(reply_trees.format_trees(reply_trees.chained(chat, "conv_id", "turn", "role", "text"))).count() == 0


def test_slices_are_laid_out_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 100_000)
    begin, flat = np.concatenate([[0], np.cumsum(counts)[:-1]]), rng.integers(97, 123, int(counts.sum()), dtype=np.uint8)
    tracemalloc.start()
    out = substring_dedup.ragged_matrix(flat, begin, counts, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    back = substring_dedup.ragged_matrix(flat, begin, counts, 50, reverse=True)
    assert peak < 4 * out.nbytes
    for i in (0, 1, 8191, 8192, 99_999):
        x = flat[begin[i]:begin[i] + counts[i]]
        assert out[i].tobytes() == x.tobytes().ljust(50, b"\0") and back[i].tobytes() == x[::-1].tobytes().ljust(50, b"\0")
