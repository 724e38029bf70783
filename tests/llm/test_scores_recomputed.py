"""Posteriors of languages and scores of toxicity, recomputed word by word and trigram by trigram in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docguard.llm import language, toxicity
from docguard.llm.common import slice_hashes

LONG = " ".join(f"wort{i % 91}" for i in range(20000))


# --- language ----------------------------------------------------------------------------------------------------


def trigrams(text, buckets):
    """Buckets of the trigrams of letters, by the same hash and nothing else shared."""
    out = []
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    letter = [b >= 128 or 97 <= b <= 122 for b in low]
    code = [b if k else 32 for b, k in zip(low, letter)]
    for i in range(len(code) - 2):
        if letter[i + 1] and (letter[i] or letter[i + 2]):
            a, b, c = (x * m & 0xFFFFFFFF for x, m in zip(code[i:i + 3], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)))
            h = a ^ b ^ c
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            out.append((h ^ h >> 13) % buckets)
    return out, sum(letter)


def posteriors(rows, settings):
    """(language, probability) of each (id, text, declared, suffix, host), None for the probability of texts without a letter."""
    size = settings.buckets
    grams = [trigrams(t, size) for _, t, *_ in rows]
    counts = defaultdict(Counter)
    for (_, _, declared, *_), (own, _) in zip(rows, grams):
        if declared is not None and declared != "und":
            counts[declared].update(own)
    names = [*sorted(counts), "und"]
    whole = sum(counts.values(), Counter())
    total, seen = sum(whole.values()), len(whole)
    share = [(whole[b] + seen / size) / (total + seen) for b in range(size)]
    weight = min(settings.smoothing * size, total)

    def likelihood(name, own):
        scale = min(1.0, settings.evidence / max(1, len(own)))
        if name == "und":
            return scale * sum(-math.log(size) for _ in own)
        mass = sum(counts[name].values()) + weight
        return scale * sum(math.log((counts[name][b] + weight * share[b]) / mass) for b in own)

    texts = [[likelihood(k, own) for k in names] for own, _ in grams]
    guesses = []
    for (_, _, declared, *_), (own, letters), ll in zip(rows, grams, texts):
        guess = names[ll.index(max(ll))] if own else declared if declared in names[:-1] else None
        guesses.append(guess if letters else None)
    tops = Counter(g for g in guesses if g)
    prior = [(tops[k] + 1) / (sum(tops.values()) + len(names)) for k in names]
    prior[-1] = min(prior[-1], settings.other_prior)

    def level(found, parent, strength):
        return [(found[k] + strength * p) / (sum(found.values()) + strength) for k, p in zip(names, parent)]

    by_suffix, by_host, by_value = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, _, declared, suffix, host), g in zip(rows, guesses):
        if g:
            by_suffix[suffix or ""][g] += 1
            if host is not None:
                by_host[host, suffix or ""][g] += 1
            if declared is not None:
                by_value[declared][g] += 1
    values = {d for _, _, d, *_ in rows if d is not None}
    out = []
    for (_, _, declared, suffix, host), (_, letters), ll in zip(rows, grams, texts):
        p = level(by_suffix[suffix or ""], prior, settings.suffix_strength) if (suffix or "") in by_suffix else prior
        if (host, suffix or "") in by_host:
            p = level(by_host[host, suffix or ""], p, settings.host_strength)
        logs = [a + math.log(b) for a, b in zip(ll, p)]
        if declared is not None:
            for k, name in enumerate(names):
                least = settings.least_texts if name != "und" else 0
                hits = by_value[declared][name] + (least if name == declared and name != "und" else 0)
                logs[k] += math.log((hits + 0.5) / (tops[name] + least + 0.5 * (len(values) + 1)))
        best = max(logs)
        out.append((names[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)) if letters else ("und", None))
    return out


@pytest.fixture(scope="module")
def evidence():
    rng = random.Random(6)
    words = {"en": "the and of with that house water under".split(), "de": "der und mit haus wasser unter nicht schön".split(),
             "fr": "le et de avec cette maison eau sous".split()}
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(words[lang] if rng.random() < 0.8 else words[rng.choice("en de fr".split())]) for _ in range(rng.randint(1, 25)))
        declared = lang if rng.random() < 0.6 else rng.choice([None, "en", "de", "xx"])
        rows.append((i, text, declared, rng.choice([None, "com", "de", "fr"]), rng.choice([None, "a.de", "b.fr", "c.com"])))
    rows += [(200, "", "en", "com", "a.de"), (201, None, None, None, None), (202, "12 34", "de", None, None), (203, "a", "fr", "fr", None), (204, "o", None, None, "c.com"),
             (205, LONG, "de", "de", "a.de"), (206, "и в на что", "und", None, None), (None, rows[4][1], "en", "com", None), (7, *rows[7][1:]), (7, *rows[7][1:])]
    return rows


def test_posteriors(spark, evidence):
    settings = language.Settings(buckets=512, least_texts=3)
    df = spark.createDataFrame(evidence, "id long, text string, declared string, suffix string, host string")
    got = language.identify_languages(df, settings=settings).select("id", "language", "probability", "kept").collect()
    expected = posteriors(evidence, settings)
    assert len({x for x, _ in expected}) >= 4
    rank = lambda r: (r[0] is None, r[0] or 0)
    for r, (row, (name, p)) in zip(sorted(got, key=rank), sorted(zip(evidence, expected), key=lambda x: rank(x[0]))):
        assert r.id == row[0] and r.language == name, (r, row, name, p)
        if p is not None:
            assert r.probability == pytest.approx(p, abs=2e-6)
        assert r.kept == (p is not None and name != "und" and p >= settings.least_probability)


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "abc abd", x, None, None) for i, x in enumerate(["zz", "aa"] * 4)] + [(100, "abc abd", None, None, None)]
    out = language.identify_languages(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")).collect()
    assert {r.language for r in out if r.id == 100} == {"aa"}


def test_pages(spark):
    """The query over web pages: markup, suffix and host of each page, against the same rules in plain Python."""
    rng = random.Random(1)
    words = {"en": "the and of with that house water under".split(), "de": "der und mit haus wasser unter nicht nie".split()}
    pages, rows = [], []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(words[lang]) for _ in range(12))
        host = f"h{i % 3}.example.{'de' if lang == 'de' else 'com'}"
        declared = lang if i % 4 < 3 else None
        pages.append((i, f"http://{host}/{i}", f"<html{f' lang={chr(34)}{lang}{chr(34)}' if declared else ''}><body><p>{text}</p></body></html>"))
        rows.append((i, text, declared, host.rsplit(".", 1)[1], host))
    pages.append((99, None, None))
    rows.append((99, None, None, None, None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.id: r for r in language.identify_languages(language.page_evidence(df)).collect()}
    for (i, *_), (name, p) in zip(rows, posteriors(rows, language.Settings())):
        assert out[i].language == name
        if p is not None:
            assert out[i].probability == pytest.approx(p, abs=1e-4)
    assert language.identify_languages(language.page_evidence(df.limit(0))).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------------------


def plain_score(text, weights, bias, settings):
    """The most toxic window of words; a word is the mean weight of its n-grams."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words, run = [], bytearray()
    for b in low + b" ":
        if b == 32 or 9 <= b <= 13:
            letters = [k for k, x in enumerate(run) if x >= 128 or 97 <= x <= 122 or 48 <= x <= 57]
            if letters:
                words.append(bytes(run[letters[0]:letters[-1] + 1]))
            run = bytearray()
        else:
            run.append(b)

    def value(word):
        marked = b"<" + word + b">"
        grams = [marked[i:i + n] for n in range(settings.shortest, settings.longest + 1) for i in range(len(marked) - n + 1)] or [marked]
        data = np.frombuffer(b"".join(grams), np.uint8)
        ends = np.cumsum([len(g) for g in grams])
        cells = slice_hashes(data, ends - [len(g) for g in grams], ends) % np.uint64(settings.buckets)
        return sum(float(weights[int(c)]) for c in cells) / len(grams)

    cache = {w: value(w) for w in set(words)}
    values = [cache[w] for w in words]
    size = min(settings.window, len(values))
    best = max((sum(values[i:i + size]) / size for i in range(len(values) - size + 1)), default=0.0) if size else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, best + bias))))


def test_scores(spark):
    settings = toxicity.Settings(buckets=1 << 10)
    rng = np.random.default_rng(4)
    weights, bias = rng.normal(0, 2, settings.buckets), -0.4
    texts = ["one", "", None, "... !!", "Some (words), in a row: déjà vu! x", "a\tb\nc\x0bd", "日本 語", "tie tie tie tie", LONG, "--a-- 'b'"]
    texts += [" ".join("".join(rng.choice(list("abcdeXYZ.-"), rng.integers(1, 9))) for _ in range(rng.integers(1, 30))) for _ in range(40)]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "no id", 1, "s"), (3, "again", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, held_out string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.predicted) for r in toxicity.score_texts(df, (weights, bias), settings).collect()))
    exact = np.asarray(weights, np.float32)
    expected = sorted((i is None, i or 0, plain_score(t, exact, bias, settings)) for i, t, *_ in rows)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2], abs=1e-6) and g[3] == int(g[2] >= 0.5)
