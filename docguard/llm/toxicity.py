"""Toxicity by subword bags: mean vectors of character n-grams under a linear softmax, trained together in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import lowered, slabs, slice_hashes, text_bytes, word_spans

HELD_OUT = "pmod(crc32(binary(string(`{id}`))), 5) = 0"


@dataclass(frozen=True)
class Settings:
    """Sizes of the model, bounds of the training sample (rows per class) and of training."""
    buckets: int = 1 << 17
    width: int = 8
    shortest: int = 3
    longest: int = 6
    window: int = 2
    toxic_rows: int = 2500
    clean_rows: int = 3500
    epochs: int = 10
    dropout: float = 0.3
    toxic_weight: float = 2.0
    batch: int = 64
    rate: float = 0.3
    seed: int = 5


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of words: runs without blanks, less the marks at their ends; words of marks alone go."""
    starts, ends, rows = word_spans(data, offsets)
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90))
    at = np.flatnonzero(letter)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1
    some = last >= first
    if not len(at):
        return starts[:0], ends[:0], rows[:0]
    return at[first[some]], at[last[some]] + 1, rows[some]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Index of the first occurrence of each distinct word, and each word's number among these."""
    _, first, number = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, settings: Settings):
    """Bucket and word number of every n-gram of the words, each between boundary marks (a shorter word is one)."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.full(at[-1], ord("<"), np.uint8)
    inner = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    body = (inner > 0) & (inner < np.repeat(sizes - 1, sizes))
    buffer[body] = data[(np.repeat(starts, sizes) + inner - 1)[body]]
    buffer[at[1:] - 1] = ord(">")
    word = np.repeat(np.arange(len(starts)), sizes)
    left = np.repeat(sizes, sizes) - inner
    brief = np.flatnonzero(sizes < settings.shortest)
    hashes, owners = [slice_hashes(buffer, at[brief], at[brief + 1])], [brief]
    for n in range(settings.shortest, settings.longest + 1):
        begin = np.flatnonzero(left >= n)
        hashes.append(slice_hashes(buffer, begin, begin + n))
        owners.append(word[begin])
    return (np.concatenate(hashes) % np.uint64(settings.buckets)).astype(np.int64), np.concatenate(owners)


def window_sums(values: np.ndarray, bounds: np.ndarray, window: int):
    """Mean over each run of `window` words within a text (over all words of a shorter one): means, first word, length, text."""
    sizes = np.diff(bounds)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - window + 1, 1))
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    length = np.minimum(window, sizes[text])
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[first + length] - sums[first]) / np.maximum(length, 1), first, length, text


def best_windows(values: np.ndarray, bounds: np.ndarray, window: int):
    """The highest mean of each text (0 without words), and where its window begins and how long it is."""
    means, first, length, text = window_sums(values, bounds, window)
    n = len(bounds) - 1
    best, where, long = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(means):
        order = np.lexsort((-means, text))
        top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        best[text[top]], where[text[top]], long[text[top]] = means[top], first[top], length[top]
    return best, where, long


def train(texts: list[str | None], toxic: list[int], settings: Settings = Settings()):
    """Bucket weights and bias of the trained model.

    Vectors and softmax are trained together by Adagrad; a text's window with the highest score stands for it, so a few
    words are not drowned in a long text. Vectors start from the log odds of a bucket's presence in toxic texts.
    """
    import pyarrow as pa

    rng = np.random.default_rng(settings.seed)
    index: dict[int, int] = {}
    numbers, bounds, buckets, counts = [], [0], [], []
    for at in range(0, len(texts), 100):  # word numbers and n-grams, so many texts at a time
        data, offsets = text_bytes(pa.array([t or "" for t in texts[at:at + 100]], pa.large_string()))
        data = lowered(data)
        starts, ends, rows = words_of(data, offsets)
        hashes = slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        before = len(index)
        ids = np.array([index.setdefault(h, len(index)) for h in kinds.tolist()], np.int64)
        new = first[ids >= before]
        bucket, owner = ngrams(data, starts[new], ends[new], settings)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(new)))
        numbers.append(ids[number.reshape(-1)].astype(np.int32) if len(ids) else np.zeros(0, np.int32))
        bounds += (bounds[-1] + np.searchsorted(rows, np.arange(1, len(offsets)))).tolist()
    number, bucket, bounds = np.concatenate(numbers), np.concatenate(buckets), np.array(bounds)
    grams = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    y = np.array(toxic, np.float64)
    # presence of each bucket in the texts of a class
    seen = np.zeros((2, settings.buckets))
    for i in range(len(texts)):
        own = np.unique(number[bounds[i]:bounds[i + 1]])
        if len(own):
            seen[int(y[i]), np.unique(np.concatenate([bucket[grams[w]:grams[w + 1]] for w in own]))] += 1
    n = np.array([max(1.0, (y == 0).sum()), max(1.0, (y == 1).sum())])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    vectors = rng.normal(0, 0.05, (settings.buckets, settings.width)).astype(np.float64)
    vectors[:, 0] += np.clip(odds, -3, 3)
    soft, bias = rng.normal(0, 0.05, (settings.width, 2)), np.zeros(2)
    soft[0] = (-0.5, 0.5)
    square_v, square_s, square_b = np.full(settings.buckets, 1e-2), np.full(soft.shape, 1e-2), np.full(2, 1e-2)
    for _ in range(settings.epochs):
        for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // settings.batch)):
            spans = [np.arange(bounds[i], bounds[i + 1]) for i in chosen]
            flat = np.concatenate(spans)
            if not len(flat):
                continue
            edge = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            words, back = np.unique(number[flat], return_inverse=True)
            counts = grams[words + 1] - grams[words]
            pick = np.repeat(grams[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            direction = soft[:, 1] - soft[:, 0]
            value = np.add.reduceat((vectors @ direction)[bucket[pick]], np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts
            _, where, long = best_windows(value[back.reshape(-1)], edge, settings.window)
            grad_v, rows_v = [], []
            grad_s, grad_b = np.zeros_like(soft), np.zeros(2)
            for k, i in enumerate(chosen):
                if not long[k]:
                    continue
                own = number[flat[where[k]:where[k] + long[k]]]
                parts = [bucket[grams[w]:grams[w + 1]] for w in own]
                weight = np.concatenate([np.full(len(p), 1 / len(p) / len(parts)) for p in parts])
                cells = np.concatenate(parts)
                left = rng.random(len(cells)) >= settings.dropout  # no n-gram may carry a word alone
                if not left.any():
                    continue
                weight, cells = weight[left] / weight[left].sum(), cells[left]
                bag = weight @ vectors[cells]
                z = bag @ soft + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(y[i])] -= 1
                p *= settings.toxic_weight if y[i] else 1.0
                grad_s += np.outer(bag, p)
                grad_b += p
                grad_v.append(np.outer(weight, soft @ p))
                rows_v.append(cells)
            if not rows_v:
                continue
            cells, grads = np.concatenate(rows_v), np.concatenate(grad_v)
            np.add.at(square_v, cells, (grads ** 2).sum(axis=1))
            np.subtract.at(vectors, cells, settings.rate * grads / np.sqrt(square_v[cells])[:, None])
            grad_s, grad_b = grad_s / len(chosen), grad_b / len(chosen)
            square_s += grad_s ** 2
            square_b += grad_b ** 2
            soft -= 0.1 * grad_s / np.sqrt(square_s)
            bias -= 0.1 * grad_b / np.sqrt(square_b)
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text",
        label: str = "toxic"):
    """Train on a bounded sample of the labelled rows that are not held out.

    Of each class the `toxic_rows` or `clean_rows` rows with the smallest hash of their id are taken, whole texts; only
    these come to the driver. Null labels and ids are no labels. Without a labelled row the model scores 0.5 for all.
    """
    usable = labels.selectExpr(f"`{id_column}` AS id", f"int(`{label}`) AS label").filter("label IN (0, 1) AND id IS NOT NULL").filter(
        "NOT " + HELD_OUT.format(id="id")).distinct()
    parts = [usable.filter(f"label = {value}").orderBy(F.expr(f"xxhash64({settings.seed}, id)"), "id").limit(n)
             for value, n in ((0, settings.clean_rows), (1, settings.toxic_rows))]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").orderBy("id", "text").collect()
    if not rows:
        return np.zeros(settings.buckets), 0.0
    return train([r["text"] for r in rows], [r["label"] for r in rows], settings)


def score_texts(docs: DataFrame, model, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Score each whole text by its most toxic window: id, held_out, score, predicted.

    Null texts, empty texts and texts without a word score by the bias alone. Repeated rows get a row each; an empty
    table gives none; all other columns are ignored. A held-out row without an id counts as not held out.
    """
    weights = docs.sparkSession.sparkContext.broadcast((np.asarray(model[0], np.float32), model[1]))

    def run(batches):
        import pyarrow as pa

        vector, bias = weights.value
        for part in slabs(batches):
            data, offsets = text_bytes(part.column(2))
            data = lowered(data)
            starts, ends, rows = words_of(data, offsets)
            value = np.zeros(0)
            if len(starts):
                first, number = distinct_words(data, starts, ends)
                bucket, owner = ngrams(data, starts[first], ends[first], settings)
                value = (np.bincount(owner, vector[bucket], len(first)) / np.bincount(owner, minlength=len(first)))[number]
            best, _, _ = best_windows(value, np.searchsorted(rows, np.arange(part.num_rows + 1)), settings.window)
            score = 1 / (1 + np.exp(-np.clip(best + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["id", "held_out", "score", "predicted"])

    own = docs.selectExpr(f"bigint(`{id_column}`) AS id", f"coalesce({HELD_OUT.format(id=id_column)}, false) AS held_out", f"`{text}` AS text")
    return own.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_column)
