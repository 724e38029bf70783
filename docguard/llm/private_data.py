"""Personal data in texts: checked patterns, and boosted trees over what wider patterns propose. SQL only on the main path.

High-recall patterns propose spans that may overlap; a span is described by its format and by what stands around it,
never by its check. Spans that pass their kind's check (the base ones) are the known positives, all others are of unknown
kind: a number with one wrong digit is still a number of that sort. Trees boosted on the logistic loss estimate how
likely a span of that description is to be checked; on held-out documents this is calibrated by isotonic regression and
divided by the mean estimate of the checked ones, which gives the chance that a span is what its kind says. Spans above
the threshold are added to the base ones. The trees become one SQL expression evaluated inside the text's row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans. Lookbehinds and possessive repeats only save steps: no match differs, since a run of
# digits or of an address's letters matches from its start or from nowhere.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20@\x20|@)[a-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[a-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++)++",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\(?[0-9]{2,4}\)?[\x20.-]){1,3}[0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a pattern to have a chance.
NEEDS = {"email": r"@|(?i)[\[(]\x20?at\x20?[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9][\x20().-]|\+[0-9]"}

_DIGITS = "regexp_replace(m.t, '[^0-9]', '')"
#: Luhn from the right: every second digit counts double, less 9 above 9.
_LUHN = (f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))), "
         "0, (a, b) -> a + b) % 10 = 0")
CHECKS = {
    "email": "true",
    "ip": "forall(split(m.t, '[.]'), p -> p rlike '^0*[0-9]{1,3}$' AND int(right(p, 3)) <= 255)",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}

_CLASS = ("CASE WHEN {c} = '' THEN 0 WHEN {c} rlike '^[\\\\s]$' THEN 1 WHEN {c} rlike '^\\\\p{{L}}$' THEN 2 WHEN {c} rlike '^[0-9]$' THEN 3 "
          "WHEN {c} rlike '^[\"=:#/_]$' THEN 4 ELSE 5 END")
_RUNS = "transform(regexp_extract_all(m.t, '[0-9]+', 0), r -> length(r))"
#: Small integers that describe a proposed span m (found text t, before b, after a).
FEATURES = {
    "kind": "m.k",
    "digits": f"least(31, length({_DIGITS}))",
    "groups": f"least(9, size({_RUNS}))",
    "longest": f"least(31, coalesce(array_max({_RUNS}), 0))",
    "shortest": f"least(31, coalesce(array_min({_RUNS}), 0))",
    "letters": "least(31, length(regexp_replace(m.t, '[^A-Za-z]', '')))",
    "last": "least(15, length(regexp_extract(m.t, '([A-Za-z0-9]*)$', 1)))",
    "before": _CLASS.format(c="right(m.b, 1)"),
    "after": _CLASS.format(c="left(m.a, 1)"),
    "cue": "CASE WHEN lower(m.b) rlike '(?:version|\\\\bv|licen[cs]e|section|page|chapter|token|key|hash|isbn|price|year)\\\\W*$' THEN 1 "
           "WHEN lower(m.b) rlike '(?:mail|phone|tel|call|fax|mobile|card|visa|account|host|address|\\\\bip)\\\\W*$' THEN 2 ELSE 0 END",
}


def _found(text: str, kind: str, pattern: str) -> str:
    """SQL: the matches of a pattern with positions in code points, summed up from what stands between them.

    k kind, s start, e end, t text, b and a what stands before and after (up to the neighbouring match).
    """
    none = "CAST(array() AS array<struct<k: int, s: int, e: int, t: string, b: string, a: string>>)"
    follows = "zip_with(gaps, slice(gaps, 2, size(gaps)), (p, q) -> named_struct('gap', p, 'next', coalesce(q, '')))"
    hits = (f"filter(zip_with(regexp_extract_all({text}, r'{pattern}', 0), {follows}, "
            "(h, z) -> named_struct('hit', h, 'gap', z.gap, 'next', z.next)), x -> x.hit IS NOT NULL)")
    span = (f"named_struct('k', {KINDS.index(kind)}, 's', acc.at + length(x.gap), 'e', acc.at + length(x.gap) + length(x.hit), "
            "'t', x.hit, 'b', right(x.gap, 24), 'a', left(x.next, 2))")
    walk = (f"aggregate({hits}, named_struct('at', 0, 'out', {none}), (acc, x) -> named_struct("
            f"'at', acc.at + length(x.gap) + length(x.hit), 'out', concat(acc.out, array({span}))), acc -> acc.out)")
    # a transform over one element gives the pieces a name
    named = f"transform(array(split({text}, r'{pattern}', -1)), gaps -> {walk})[0]"
    return f"CASE WHEN {text} rlike r'{NEEDS[kind]}' AND {text} rlike r'{pattern}' THEN {named} ELSE {none} END"


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """Add __base (checked spans by kind and start) and __free (proposed spans that overlap none of them)."""
    # a match of a base pattern that fails its check is proposed as well
    found = df.selectExpr("*", *[f"{_found(text, k, BASE[k])} AS `__{k}`" for k in KINDS],
                          f"concat({', '.join(_found(text, k, WIDE[k]) for k in KINDS)}) AS `__wide`")
    split = found.selectExpr("*", f"concat({', '.join(f'filter(`__{k}`, m -> {CHECKS[k]})' for k in KINDS)}) AS `__base`")
    proposed = f"concat(`__wide`, {', '.join(f'`__{k}`' for k in KINDS)})"
    return split.selectExpr(
        *[f"`{c}`" for c in df.columns], "`__base`",
        f"array_distinct(filter({proposed}, m -> NOT exists(`__base`, x -> x.s < m.e AND m.s < x.e))) AS `__free`")


def described(spans: str) -> str:
    """SQL: the spans with their features f."""
    made = ", ".join(f"'{n}', int({e})" for n, e in FEATURES.items())
    return f"transform({spans}, m -> named_struct('k', m.k, 's', m.s, 'e', m.e, 'f', named_struct({made})))"


@dataclass
class Model:
    """Boosted trees as nested (feature, cut, left, right) or leaf values, and a threshold on their sum per kind."""
    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def sql(self) -> str:
        """The sum of all trees over the features m.f."""
        def node(t) -> str:
            if not isinstance(t, tuple):
                return f"{t!r}D"
            return f"CASE WHEN m.f.`{t[0]}` <= {t[1]} THEN {node(t[2])} ELSE {node(t[3])} END"
        return " + ".join([f"{self.start!r}D", *map(node, self.trees)])

    def chosen_sql(self) -> str:
        """Whether a span's sum reaches the threshold of its kind."""
        tests = [f"m.k = {k} AND m.v >= {t!r}D" for k, t in sorted(self.thresholds.items())]
        return f"({' OR '.join(tests)})" if tests else "false"

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The sum of all trees for rows of features."""
        names = list(FEATURES)

        def node(t, at):
            if not isinstance(t, tuple):
                out[at] += t
                return
            low = rows[at, names.index(t[0])] <= t[1]
            node(t[2], at[low])
            node(t[3], at[~low])

        out = np.full(len(rows), self.start)
        for t in self.trees:
            node(t, np.arange(len(rows)))
        return out


def boosted(rows: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3,
            least: float = 5.0, smooth: float = 1.0) -> Model:
    """Trees by second-order boosting of the logistic loss over weighted rows of small integers."""
    names = list(FEATURES)
    share = (n[y == 1].sum() + 1) / (n.sum() + 2)
    model = Model(float(np.log(share / (1 - share))))
    raw = np.full(len(rows), model.start)

    def grow(at, g, h, left):
        total, weight = g[at].sum(), h[at].sum()
        best = (1e-6, None, None)
        if left:
            for j in range(len(names)):
                x = rows[at, j]
                size = x.max(initial=0) + 1
                gs, hs, ns = (np.bincount(x, w[at], size).cumsum()[:-1] for w in (g, h, n))
                gain = gs ** 2 / (hs + smooth) + (total - gs) ** 2 / (weight - hs + smooth) - total ** 2 / (weight + smooth)
                gain[(ns < least) | (n[at].sum() - ns < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            value = float(-rate * total / (weight + smooth))
            raw[at] += value
            return value
        low = rows[at, best[1]] <= best[2]
        return names[best[1]], best[2], grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        model.trees.append(grow(np.arange(len(rows)), n * (p - y), n * p * (1 - p), depth))
    return model


def isotonic(score: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct scores, rates): the rising step function of the score nearest to y, by pooling neighbours."""
    values, at = np.unique(score, return_inverse=True)
    weight, hits = np.bincount(at, n), np.bincount(at, n * y)
    blocks: list[list[float]] = []
    for w, h in zip(weight, hits):
        blocks.append([w, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return values, np.concatenate([np.full(int(c), h / w) for w, h, c in blocks]) if blocks else np.zeros(0)


def calibrated(model: Model, rows: np.ndarray, n: np.ndarray, y: np.ndarray, least: float = 0.5, least_known: int = 3) -> Model:
    """Set the thresholds from held-out rows: a span's chance is its rate over the mean rate of the checked ones.

    A kind with fewer than least_known checked held-out spans cannot be calibrated and gets none.
    """
    score = model.score(rows)
    for k in range(len(KINDS)):
        mine = rows[:, list(FEATURES).index("kind")] == k
        known = n[mine] * y[mine]
        if known.sum() < least_known:
            continue
        values, rates = isotonic(score[mine], n[mine], y[mine])
        held = rates[np.searchsorted(values, score[mine])]
        chance = rates / ((held * known).sum() / known.sum())
        if (chance >= least).any():
            model.thresholds[k] = float(values[np.argmax(chance >= least)])
    return model


def fit(df: DataFrame, id_column: str = "doc_id", text: str = "text", documents: int = 20_000, patterns: int = 50_000) -> Model:
    """Fit on the spans of the `documents` documents with the smallest hashes of their ids.

    Spans are counted per description in Spark; at most `patterns` descriptions (by hash) reach the driver. A third of
    the documents calibrates what the others fitted. Without any span the model adds none.
    """
    own = df.selectExpr(f"xxhash64(string(`{id_column}`)) AS h", f"coalesce(string(`{text}`), '') AS `__text`")
    last = own.select("h").orderBy("h").limit(documents).selectExpr("max(h) AS h").first().h
    if last is None:
        return Model()
    known = "exists(`__base`, x -> x.k = m.k AND x.s = m.s AND x.e = m.e)"
    spans = with_spans(own.filter(f"h <= {last}L"), "`__text`").selectExpr(
        "int(pmod(h, 3) = 0) AS held", "`__base`", f"explode(concat({described('`__base`')}, {described('`__free`')})) AS m")
    counted = spans.selectExpr("held", "m.f AS f", f"int({known}) AS y").groupBy("held", "f", "y").count()
    drawn = counted.orderBy(F.xxhash64("f", "held", "y"), "f", "held", "y").limit(patterns)
    got = drawn.select("held", "y", "count", "f.*").toPandas()
    if not len(got):
        return Model()
    x = got[list(FEATURES)].to_numpy(np.int64)
    n, y, held = (got[c].to_numpy(np.float64) for c in ("count", "y", "held"))
    if not (held == 0).any() or not (held == 1).any():
        return Model()
    model = boosted(x[held == 0], n[held == 0], y[held == 0])
    return calibrated(model, x[held == 1], n[held == 1], y[held == 1])


def private_spans(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, base and added arrays of (k, s, e): kind, start, end in code points, end exclusive.

    A null text is empty and has no spans; ties and repeated rows get rows of their own; other columns are not returned.
    Added spans overlap no base span; of those that lie inside one another the widest stays.
    """
    own = df.selectExpr(f"`{id_column}` AS `__id`", f"coalesce(string(`{text}`), '') AS `__text`")
    found = with_spans(own, "`__text`").selectExpr(
        "`__id`", "transform(`__base`, m -> named_struct('k', m.k, 's', m.s, 'e', m.e)) AS base", f"{described('`__free`')} AS `__free`")
    scored = found.selectExpr("`__id`", "base", f"transform(`__free`, m -> named_struct('k', m.k, 's', m.s, 'e', m.e, 'v', {model.sql()})) AS `__scored`")
    chosen = scored.selectExpr("`__id`", "base", f"array_distinct(transform(filter(`__scored`, m -> {model.chosen_sql()}), "
                               "m -> named_struct('k', m.k, 's', m.s, 'e', m.e))) AS `__chosen`")
    inside = "x.s <= m.s AND m.e <= x.e AND (x.e - x.s > m.e - m.s OR x.k < m.k)"
    return chosen.selectExpr(f"`__id` AS `{id_column}`", "base",
                             f"array_sort(filter(`__chosen`, m -> NOT exists(`__chosen`, x -> {inside}))) AS added")


def redacted(text: str, spans: str) -> str:
    """SQL: a text with each of its sorted spans (structs of k, s, e) replaced by its kind in brackets."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    ordered = f"array_sort(transform({spans}, m -> named_struct('s', m.s, 'e', m.e, 'k', m.k)))"
    walk = (f"aggregate({ordered}, named_struct('at', 0, 'out', CAST(array() AS array<string>)), (acc, m) -> if(m.s < acc.at, "
            f"named_struct('at', greatest(acc.at, m.e), 'out', acc.out), named_struct('at', m.e, 'out', concat(acc.out, "
            f"array(substr({text}, acc.at + 1, m.s - acc.at), array({names})[m.k])))), "
            f"acc -> concat(array_join(acc.out, ''), substr({text}, acc.at + 1)))")
    return walk


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, m -> concat(array({names})[m.k], ':', m.s, ':', m.e)), ',')"


def find_private_data(df: DataFrame, id_column: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans listed, one row per input row.

    n_<kind> and base_sha256 are of base spans; spans lists base and added ones by kind, then start. Nulls, ties, empty
    texts and tables as in `private_spans`.
    """
    model = fit(df, id_column, text) if model is None else model
    counts = [f"bigint(size(filter(base, m -> m.k = {i}))) AS n_{k}" for i, k in enumerate(KINDS)]
    return private_spans(df, model, id_column, text).selectExpr(
        f"`{id_column}`", *counts, f"sha2({_listed('base')}, 256) AS base_sha256",
        f"{_listed('array_sort(concat(base, added))')} AS spans")
