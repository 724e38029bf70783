"""Language of texts by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import Handoff, lowered, slabs, small, small_batches, text_bytes, tidy

OTHER = "und"


@dataclass(frozen=True)
class Settings:
    """Sizes and strengths. The text counts as at most `evidence` trigrams, since those of a text depend on each other.

    A language counts as declared by its own name in at least `least_texts` texts, so that the declarations of rare ones
    weigh too. `languages` and `numbers` bound what a task holds at a time, not what is counted.
    """
    buckets: int = 8192
    evidence: float = 60.0
    least_texts: int = 5
    smoothing: float = 0.5
    host_strength: float = 20.0
    suffix_strength: float = 20.0
    other_prior: float = 1e-6
    least_probability: float = 0.5
    languages: int = 256
    numbers: int = 1 << 21


def _trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """Bucket and text of each trigram of letters: bytes in lower case, runs of other characters as one blank each."""
    data = lowered(data)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    code = np.where(letter, data, 32).astype(np.uint32)
    n = len(code)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64)
    mixed = (code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    keep = letter[1:-1] & (letter[:-2] | letter[2:])  # at least two letters, one of them in the middle
    edges = offsets[1:-1]
    for back in (1, 2):  # not across two texts
        at = edges - back
        keep[at[(at >= 0) & (at < n - 2)]] = False
    position = np.flatnonzero(keep)
    bounds = np.searchsorted(position, offsets)
    return (mixed[position] % np.uint32(buckets)).astype(np.int64), np.diff(bounds), bounds


def count_trigrams(rows: DataFrame, settings: Settings) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of the trigrams of each declared language over all rows: summed in each task, then by Spark.

    Every declared value but 'und' is a language, however few rows declare it, and also if their texts have no trigram.
    """
    size = settings.buckets

    def run(batches):
        import pyarrow as pa

        def flushed(total):
            for name, counts in total.items():
                at = np.flatnonzero(counts) if counts.any() else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                                                 ["language", "bucket", "n"])

        total = {}
        for part in slabs(batches):
            data, offsets = text_bytes(part.column(1))
            bucket, sizes, _ = _trigrams(data, offsets, size)
            coded = part.column(0).dictionary_encode()
            owner = np.repeat(coded.indices.to_numpy(), sizes).astype(np.int64)
            names = coded.dictionary.to_pylist()
            for low in range(0, len(names), settings.languages):
                some = names[low:low + settings.languages]
                own = slice(None) if len(some) == len(names) else (owner >= low) & (owner < low + len(some))
                both = np.bincount((owner[own] - low) * size + bucket[own], minlength=len(some) * size).reshape(-1, size)
                for name, counts in zip(some, both):
                    total[name] = total[name] + counts if name in total else counts.copy()
                if len(total) > settings.languages:
                    yield from flushed(total)
                    total = {}
        yield from flushed(total)

    summed = rows.filter(f"declared <> '{OTHER}'").select("declared", "text").mapInArrow(tidy(run), "language string, bucket int, n long").groupBy(
        "language", "bucket").agg(F.sum("n").alias("n"))
    found = {}
    for r in summed.toLocalIterator():  # a row for each bucket that a language has
        at, n = found.setdefault(r["language"], (array("i"), array("q")))
        at.append(r["bucket"])
        n.append(r["n"])
    return {name: (np.frombuffer(at, np.int32), np.frombuffer(n, np.int64)) for name, (at, n) in found.items()}


@dataclass(frozen=True)
class Tables:
    """Log probabilities of the buckets: `base` those of all texts; for each language what it adds where it has no count, its buckets and their values."""
    base: np.ndarray
    own: list[tuple[float, np.ndarray, np.ndarray]]

    def row(self, k: int) -> np.ndarray:
        """Of language k, or even ones for the number after the last."""
        if k == len(self.own):
            return np.full(len(self.base), -np.log(len(self.base)))
        rest, at, values = self.own[k]
        row = self.base + rest
        row[at] = values
        return row


def log_tables(counts: dict[str, tuple[np.ndarray, np.ndarray]], settings: Settings) -> tuple[list[str], Tables]:
    """Smoothed log probabilities by language; the last one, for any other language, is even.

    Languages are smoothed towards the buckets of all texts and these towards even ones: a language of few texts
    is near the whole and not near the even one, so that it does not draw texts of no language.
    """
    names, whole = sorted(counts), np.zeros(settings.buckets)
    for at, n in counts.values():
        whole[at] += n
    total, seen = whole.sum(), np.count_nonzero(whole)
    shares = (whole + seen / settings.buckets) / (total + seen) if total else np.full(settings.buckets, 1 / settings.buckets)
    weight = min(settings.smoothing * settings.buckets, total) or 1.0
    own = []
    for at, n in map(counts.get, names):
        mass = n.sum() + weight
        own.append((float(np.log(weight / mass)), at, np.log((n + weight * shares[at]) / mass)))
    return [*names, OTHER], Tables(np.log(shares), own)


def text_likelihoods(rows: DataFrame, names: list[str], tables: Tables, settings: Settings) -> DataFrame:
    """Replace the text of each row by n_letters, n_trigrams and the log likelihood per language, scaled to the evidence it counts as."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    others = [c for c in rows.columns if c != "text"]
    most = max(1, settings.numbers // len(names))

    def run(batches):
        import pyarrow as pa

        for part in (slab.slice(at, most) for slab in slabs(batches) for at in range(0, slab.num_rows, most)):
            data, offsets = text_bytes(part.column(len(others)))
            bucket, sizes, bounds = _trigrams(data, offsets, settings.buckets)
            scale = np.minimum(1.0, settings.evidence / np.maximum(sizes, 1))
            found = np.zeros((part.num_rows, len(names)))
            if len(bucket):
                for k in range(len(names)):
                    sums = np.concatenate([[0.0], np.cumsum(shared.value.row(k)[bucket])])
                    found[:, k] = (sums[bounds[1:]] - sums[bounds[:-1]]) * scale
            flat = pa.array(found.reshape(-1))
            lower = lowered(data)
            letters = np.concatenate([[0], np.cumsum((lower >= 128) | ((lower >= 97) & (lower <= 122)))])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(len(others))), pa.array(letters[offsets[1:]] - letters[offsets[:-1]]), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(names)), flat)],
                [*others, "n_letters", "n_trigrams", "text_ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema.fields)
    return rows.select(*others, "text").mapInArrow(tidy(run), schema + ", n_letters long, n_trigrams long, text_ll array<double>")


def _names(names: list[str]) -> str:
    return "array(" + ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names) + ")"


def identify_languages(rows: DataFrame, accepted: list[str] | None = None, settings: Settings = Settings(),
                       keep: list[str] = ("id",)) -> DataFrame:
    """Language, probability and decision of each row of (id, text, declared, suffix, host); each of these may be null.

    The likelihood of a text comes from trigram counts of all texts by declared language. The other evidence comes
    from grouped counts over all rows: how often a language (as the text alone says, or its declaration if it has no trigram) is declared as what, and stands
    under which suffix, and the hosts' priors, each smoothed towards its suffix's and that one's towards the whole.
    Missing evidence counts for nothing. A row is kept if its text has a letter and its best language is
    accepted (any but 'und' unless named) with at least `least_probability`. Texts without a letter, null and empty ones too,
    are 'und' and not kept; where a text has letters but no trigram, the other evidence decides. Repeated rows get the same answer each; ties go to the language first in order; an empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    hand = Handoff(rows.sparkSession, "language")
    names, tables = log_tables(count_trigrams(rows, settings), settings)
    n = len(names)
    scored = hand.write(text_likelihoods(rows.select(*keep, "declared", "suffix", "host", "text"), names, tables, settings), "scored")
    named = _names(names[:-1] or [""])
    guess = scored.filter("n_letters > 0").selectExpr(
        "declared", "coalesce(suffix, '') AS suffix", "host",
        f"int(if(n_trigrams > 0, array_position(text_ll, array_max(text_ll)), array_position({named}, declared))) AS language").filter("language > 0")
    # shares of all rows, of suffixes and of hosts, each level smoothed by the one above
    def shares(by: list[str], source: DataFrame) -> DataFrame:
        some = source.groupBy(*by, "language").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("found"), F.sum("n").alias("total"))
        return some.selectExpr(*by, f"transform(sequence(1, {n}), k -> coalesce(try_element_at(found, k), 0L)) AS counts", "total")

    def few(side: DataFrame) -> DataFrame:  # rows with a number for each language
        return small(side, (1 << 23) // n)

    tops = {r["language"]: r["n"] for r in guess.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row for each language
    counts = [tops.get(k + 1, 0) for k in range(n)]
    whole = [(c + 1.0) / (sum(counts) + n) for c in counts]
    whole[-1] = min(whole[-1], settings.other_prior)
    fixed = "array(" + ", ".join(f"{float(x)!r}D" for x in whole) + ")"

    def smoothed(parent: str, strength: float) -> str:
        return f"zip_with(counts, {parent}, (c, p) -> (c + {strength}D * p) / (total + {strength}D))"

    suffixes = shares(["suffix"], guess).selectExpr("suffix", f"{smoothed(fixed, settings.suffix_strength)} AS suffix_share")
    suffixes = hand.write(suffixes, "suffixes")
    hosts = shares(["host", "suffix"], guess.filter("host IS NOT NULL")).join(few(suffixes), "suffix").selectExpr(
        "host", "suffix", f"{smoothed('suffix_share', settings.host_strength)} AS host_share")
    hosts = hand.write(hosts, "hosts")
    values = hand.write(scored.filter("declared IS NOT NULL").select("declared").distinct().selectExpr(
        "declared", f"array_position({named}, declared) AS place"), "values")
    n_values = values.count()
    declared = values.join(few(shares(["declared"], guess.filter("declared IS NOT NULL"))), "declared", "left")
    # each language is declared by its own name in so many texts more
    least = float(settings.least_texts)
    totals = "array(" + ", ".join(f"{c + (k < n - 1) * least!r}D" for k, c in enumerate(counts)) + ")"
    even = f"transform(sequence(1, {n}), k -> 0L)"
    raised = f"zip_with(coalesce(counts, {even}), sequence(1, {n}), (c, k) -> c + if(k = place, {least}D, 0D))"
    declared = declared.selectExpr("declared", f"zip_with({raised}, {totals}, (c, t) -> ln((c + 0.5D) / (t + 0.5D * {n_values + 1}))) AS declared_ll")
    joined = scored.selectExpr("*", "coalesce(suffix, '') AS at").join(
        few(suffixes.withColumnRenamed("suffix", "at")), "at", "left").join(
        few(hosts.withColumnRenamed("suffix", "at")), ["host", "at"], "left").join(few(declared), "declared", "left")
    prior = f"transform(coalesce(host_share, suffix_share, {fixed}), p -> ln(p))"
    zeros = f"array_repeat(0D, {n})"
    total = f"zip_with(zip_with(text_ll, {prior}, (a, b) -> a + b), coalesce(declared_ll, {zeros}), (a, b) -> a + b)"
    decided = joined.selectExpr(*keep, "n_letters", "n_trigrams", f"{total} AS logs").selectExpr("*", "array_max(logs) AS best").selectExpr(
        *keep, "n_letters", "n_trigrams", "logs", "best", "1D / aggregate(logs, 0D, (s, x) -> s + exp(x - best)) AS probability",
        f"element_at({_names(names)}, int(array_position(logs, best))) AS language")
    ok = "language <> 'und'" if accepted is None else f"array_contains({_names(accepted)}, language)"
    return decided.selectExpr(*keep, f"if(n_letters > 0, language, '{OTHER}') AS language", "round(probability, 6) AS probability",
                              "n_trigrams", f"n_letters > 0 AND {ok} AND probability >= {settings.least_probability} AS kept")


def document_evidence(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents as rows with evidence: the language they come with as declared, their source as host, no suffix."""
    return docs.selectExpr(f"`{id_column}` AS id", f"`{text}` AS text", f"nullif(`{lang}`, '') AS declared",
                           "CAST(NULL AS string) AS suffix", f"`{source}` AS host")


def page_evidence(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Web pages as rows with evidence: text without markup, the markup's language, the address's suffix and host."""
    host = f"regexp_extract(lower(`{url}`), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)"
    plain = f"regexp_replace(regexp_replace(`{html}`, '(?is)<(script|style)[^>]*>.*?</\\\\1>', ' '), '(?s)<[^>]*>|&[#A-Za-z0-9]+;', ' ')"
    lang = f"lower(regexp_extract(`{html}`, '(?i)<html[^>]*\\\\blang\\\\s*=\\\\s*[\\\"\\']?([A-Za-z]+)', 1))"
    return pages.selectExpr(f"`{id_column}` AS id", f"{plain} AS text", f"nullif({lang}, '') AS declared",
                            f"nullif(substring_index({host}, '.', -1), '') AS suffix", f"nullif({host}, '') AS host")


def in_accepted_language(docs: DataFrame, accepted: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The documents without those rejected; rows are told apart by id and text. All columns stay as they are."""
    rows = document_evidence(docs).withColumn("print", F.expr("xxhash64(text)"))
    rejected = identify_languages(rows, accepted, settings, keep=["id", "print"]).filter("NOT kept").select(
        F.col("id").alias("__id"), F.col("print").alias("__print")).distinct()
    same = (F.col("__id").eqNullSafe(F.col("doc_id"))) & (F.expr("xxhash64(text)") == F.col("__print"))
    return docs.join(small(rejected), same, "left_anti")
