"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

A rolling hash of the bytes triggers where phrases end: each string of the given length has a trigger, the least hash
among its 16-byte strings, and equal strings have it at the same place. So the string is a suffix of the phrase before
the trigger and the begin of what the parse goes on with. Most triggers occur in one document only; they are found by
shuffling four bytes for each and play no further part. The rest are compared by hashes: a phrase with its continuation
(a record) that an earlier document holds as a whole needs nothing more, since all its strings go, and one that shares the
bytes halfway round its trigger with no other record shares no string with any. What remains is a dictionary of distinct
records, each sent by the document that has it first. In it, phrases and continuations meet by trigger. Both are sorted: phrases from their ends, which is the suffix array of the dictionary, and continuations, which is that of
the parse. With the lengths of common prefixes of neighbours, a string's place in corpus order is the pair of its
ranks, and the strings of equal rank are one class with a first document.

The text moves in deflated chunks of about a megabyte that are written once, bucketed by chunk, so that later passes
join what belongs to a chunk without moving text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.llm.common import Handoff, mixed, rolling, small_batches, text_bytes, tidy

LAST = (1 << 63) - 1  # rows without an id come after all others
BLOCK = 1 << 18  # bytes hashed at once, so that working arrays have a few megabytes
ROWS = 1 << 13  # byte slices laid out at once
TABLES: list[str] = []


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Drop these, or all, chunk tables of results that are written or no longer wanted."""
    for name in names or tuple(TABLES):
        TABLES.remove(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@dataclass(frozen=True)
class Settings:
    """Length of the strings, of the triggers' strings, bytes of a chunk, and from how many chunks' copies on a trigger is hot."""
    length: int = 50
    trigger: int = 16
    chunk: int = 1 << 20
    hot: int = 64


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def opened(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as deflated planes of the bytes of their differences."""
    steps = np.diff(keys, prepend=np.uint32(0))
    return packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def opened_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(opened(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


def key_rows(bucket: np.ndarray, key: np.ndarray, owner: np.ndarray):
    """(bucket, packed keys): the distinct keys of a chunk by bucket, twice if two of its documents have it."""
    order = np.lexsort((owner, key, bucket))
    b, k, o = bucket[order], key[order], owner[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    other = ~new
    other[1:] &= o[1:] != o[:-1]
    run_number = np.cumsum(new)
    second = np.zeros(len(b), bool)  # the first further document of a key
    where = np.flatnonzero(other)
    if len(where):
        second[where[np.concatenate([[True], run_number[where][1:] != run_number[where][:-1]])]] = True
    keep = new | second
    b, k = b[keep], k[keep]
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    return b[edges[:-1]].astype(np.int32), [packed_keys(k[x:y]) for x, y in zip(edges[:-1], edges[1:])]


def known_keys(side) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (bucket, key) pairs as one number, and which are hot, from the rows of shared_keys for a chunk."""
    known, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for part in side or []:
        k = opened_keys(part["keys"])
        known.append(np.uint64(part["bucket"]) << np.uint64(32) | k.astype(np.uint64))
        hot.append(np.unpackbits(np.frombuffer(part["hot"], np.uint8), count=len(k)).astype(bool) if "hot" in part else np.zeros(len(k), bool))
    known, hot = np.concatenate(known), np.concatenate(hot)
    order = np.argsort(known)
    return known[order], hot[order]


def chunked(docs: DataFrame, settings: Settings, id_column: str, text: str) -> DataFrame:
    """(chunk, ids, sizes, packed, rest): runs of rows of about a chunk's size; rest holds the rows' other columns."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_column, text)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(True).alias("none"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), rest.alias("rest"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_bytes(table.column(1))
            ids = table.column(0).combine_chunks().fill_null(LAST)
            n = len(ids)
            one = np.array([0, n], np.int32)
            more = table.column(2).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array(one), ids), pa.ListArray.from_arrays(pa.array(one), pa.array(np.diff(offsets))),
                 pa.array([packed(data.tobytes())], pa.binary()), pa.ListArray.from_arrays(pa.array(one), more)],
                ["chunk", "ids", "sizes", "packed", "rest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(text_bytes(batch.column(1))[1])
            at = 0
            for i, n in enumerate(sizes.tolist()):
                size += n + 64
                if size >= settings.chunk:
                    held.append(batch.slice(at, i + 1 - at))
                    yield out()
                    number, held, size, at = number + 1, [], 0, i + 1
            if at < batch.num_rows:
                # a copy: a slice would keep the whole batch alive until the chunk is full
                held.append(batch.take(pa.array(np.arange(at, batch.num_rows))))
        if held:
            yield out()

    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"chunk long, ids array<long>, sizes array<long>, packed binary, rest array<{kind}>")


def bucketed(spark: SparkSession, df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The frame as a table of the shared warehouse, bucketed by a key, and its name."""
    name = f"chunks_{uuid.uuid4().hex}"
    TABLES.append(name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(name)
    return spark.table(name), name


#: Bytes of text whose keys are dealt to one bucket, which bounds what a group of keys holds.
BUCKET_BYTES = 1 << 24


def key_buckets(chunks: DataFrame) -> int:
    """To how many buckets the keys of the texts are dealt: as many as shuffle partitions, more where the counted bytes need them.

    Keys are hashes, so a bucket holds those of some BUCKET_BYTES of text whatever the size of the whole, and of a key two for each
    chunk at most.
    """
    total = chunks.agg(F.expr("sum(aggregate(sizes, 0L, (s, x) -> s + x))")).first()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def triggered(data: np.ndarray, offsets: np.ndarray, settings: Settings):
    """Per run of strings with one trigger: its place, the first and last begin of a string, the document, the trigger's hash."""
    length, k = settings.length, settings.trigger
    width = length - k + 1
    found = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[at:at + BLOCK + length - 1]
        sums, down = rolling(part)
        h = mixed((sums[k:] - sums[:-k]) * down[:len(part) - k + 1])
        best = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if width > step:
            best = np.minimum(best[:len(best) - (width - step)], best[width - step:])
        place = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
        begin = np.arange(len(place))
        doc = np.searchsorted(offsets, begin + at, side="right") - 1
        whole = begin + at + length <= offsets[doc + 1]
        begin, place, doc = begin[whole], place[whole], doc[whole]
        if not len(begin):
            continue
        new = np.ones(len(begin), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(begin)]]) - 1
        found.append((place[first] + at, begin[first] + at, begin[last] + at, doc[first], h[place[first]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def dealt(h: np.ndarray, n: int):
    """Bucket and 32-bit key of a trigger's hash."""
    return (h % np.uint64(n)).astype(np.int64), ((h // np.uint64(n)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def content(row_packed: bytes, sizes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(opened(row_packed), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def trigger_keys(chunks: DataFrame, n: int, settings: Settings) -> DataFrame:
    """(bucket, chunk, keys): each chunk's distinct trigger keys, twice if two of its documents have it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(1)[i].values.to_numpy()
                data, offsets = content(batch.column(3)[i].as_py(), batch.column(2)[i].values.to_numpy())
                _, _, _, doc, h = triggered(data, offsets, settings)
                if not len(h):
                    continue
                bucket, key = dealt(h, n)
                owner = ids[doc]
                buckets, parts = key_rows(bucket, key, owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
                    ["bucket", "chunk", "keys"])

    return chunks.select("chunk", "ids", "sizes", "packed").mapInArrow(tidy(run), "bucket int, chunk long, keys binary")


def shared_of(parts: list[np.ndarray], hot: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each chunk's keys those that occur twice or more in all, once each, and which of these do `hot` times."""
    key = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    copies = np.diff(edges)
    keep = np.repeat(copies > 1, copies)
    once = np.ones(len(k), bool)
    once[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    keep &= once
    k, o, often = k[keep], o[keep], np.repeat(copies >= hot, copies)[keep]
    order = np.lexsort((k, o))
    k, o, often = k[order], o[order], often[order]
    edges = np.searchsorted(o, np.arange(len(parts) + 1))
    return [(k[x:y], often[x:y]) for x, y in zip(edges[:-1], edges[1:])]


def shared_keys(keys: DataFrame, settings: Settings) -> DataFrame:
    """(chunk, bucket, keys, hot): of each chunk's keys those that two documents have, and which of these are hot."""

    def run(table):
        import pyarrow as pa

        found = shared_of([opened_keys(x.as_py()) for x in table.column("keys")], settings.hot)
        some = [i for i, (k, _) in enumerate(found) if len(k)]
        chunk, bucket = table.column("chunk").to_numpy(), table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array(chunk[some], pa.int64()), "bucket": pa.array([bucket] * len(some), pa.int32()),
                         "keys": pa.array([packed_keys(found[i][0]) for i in some], pa.binary()),
                         "hot": pa.array([np.packbits(found[i][1]).tobytes() for i in some], pa.binary())})

    return keys.groupBy("bucket").applyInArrow(tidy(run), "chunk long, bucket int, keys binary, hot binary")


#: The keys of a chunk that shares none.
NOTHING = packed_keys(np.zeros(0, np.uint32))

#: Kinds of payloads: records and strings at hot triggers to be ranked; before that records' prints and their contexts' keys.
RECORDS, STRINGS, PRINTS, CONTEXTS = range(4)


class Chunk:
    """A chunk with its shared triggers: what of its records is to be compared, what then is to be ranked, and what comes of it.

    Results are (kind, bucket, masks) of the rounds so far, in the order of the payloads.
    """

    def __init__(self, ids, sizes, data: bytes, side, n: int, settings: Settings):
        self.settings, self.ids, self.n = settings, ids, n
        self.data, self.offsets = content(data, sizes)
        place, first, last, doc, h = triggered(self.data, self.offsets, settings)
        bucket, key = dealt(h, n)
        both = bucket.astype(np.uint64) << np.uint64(32) | key
        known, hot = known_keys(side)
        at = np.minimum(np.searchsorted(known, both), max(0, len(known) - 1))
        shared = np.flatnonzero(known[at] == both) if len(known) else np.zeros(0, np.int64)
        self.place, self.first, self.last, self.owner = (x[shared] for x in (place, first, last, self.ids[doc] if len(doc) else doc))
        self.bucket, self.key, self.hot = bucket[shared], key[shared], hot[at[shared]] if len(known) else np.zeros(0, bool)
        if len(shared):
            self.sums, self.down = rolling(self.data)
            self._records()

    def _hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice."""
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def _records(self) -> None:
        """Distinct (bytes around the trigger, its place in them) with their least id, by the print's bucket; `of` gives each row's record."""
        begin, end = self.first, self.last + self.settings.length
        prints = mixed(self._hashes(begin, end) ^ (self.place - begin).astype(np.uint64))
        part = (prints % np.uint64(self.n)).astype(np.int64)
        order = np.lexsort((self.owner, self.key, prints, part))
        p, k = prints[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        self.rows, head = order, np.flatnonzero(new)
        self.of, self.lead = np.cumsum(new) - 1, order[head]
        self.prints, self.print_bucket, self.least = p[head], part[order][head], self.owner[self.lead]

    def _contexts(self):
        """Bucket, key and record of what each string of a record holds one of: half of its bytes beside the trigger, on either side."""
        length, k = self.settings.length, self.settings.trigger
        before = (length - k + 1) // 2
        after = length - k - before + 1
        place = self.place[self.lead]
        left = np.flatnonzero(place - self.first[self.lead] >= before)
        right = np.flatnonzero(self.last[self.lead] + length - place >= k + after)
        h = np.concatenate([self._hashes(place[left] - before, place[left] + k), mixed(~self._hashes(place[right], place[right] + k + after))])
        return (*dealt(h, self.n), np.concatenate([left, right]))

    def to_compare(self):
        """(bucket, kind, packed bytes) of the records' prints and contexts."""
        if not len(self.place):
            return
        for bucket, x, y in runs(self.print_bucket):
            yield bucket, PRINTS, packed_hashes(self.prints[x:y], self.key[self.lead[x:y]], self.least[x:y])
        buckets, keys = key_rows(*self._contexts())
        yield from ((int(b), CONTEXTS, k) for b, k in zip(buckets, keys))

    def _settle(self, results) -> dict:
        """Which records an earlier document holds as a whole, and those to be ranked: records by trigger, strings of hot ones by hash."""
        masks = {(r["kind"], r["bucket"]): opened(r["masks"]) for r in results if r["kind"] != CONTEXTS}
        self.earlier = np.concatenate([np.frombuffer(masks[PRINTS, b], np.uint8) for b, _, _ in runs(self.print_bucket)]).astype(bool)
        bucket, key, record = self._contexts()
        known, _ = known_keys([{"bucket": r["bucket"], "keys": r["masks"]} for r in results if r["kind"] == CONTEXTS])
        both = bucket.astype(np.uint64) << np.uint64(32) | key
        near = np.zeros(len(self.lead), bool)
        if len(known):
            near[record[known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both]] = True
        near &= ~self.earlier
        plain, hot = np.flatnonzero(near & ~self.hot[self.lead]), np.flatnonzero(near & self.hot[self.lead])
        self.plain = plain[np.argsort(self.bucket[self.lead[plain]], kind="stable")]
        self.plain_bucket = self.bucket[self.lead[self.plain]]
        self._strings(hot)
        return masks

    def _strings(self, records: np.ndarray) -> None:
        """Distinct hashes of the strings of records at hot triggers with their least id."""
        lead = self.lead[records]
        counts = self.last[lead] - self.first[lead] + 1
        begin = np.repeat(self.first[lead] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        record, check = np.repeat(records, counts), np.repeat(self.key[lead], counts)
        h = self._hashes(begin, begin + self.settings.length)
        bucket = (h % np.uint64(self.n)).astype(np.int64)
        order = np.lexsort((self.least[record], check, h, bucket))
        v, c = h[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        head = np.flatnonzero(new)
        self.hot_of, self.hot_record, self.hot_begin = np.cumsum(new) - 1, record[order], begin[order]
        self.hot_hash, self.hot_check, self.hot_bucket, self.hot_least = v[head], c[head], bucket[order][head], self.least[record[order][head]]

    def to_rank(self, results):
        """(bucket, kind, packed bytes) of what is to be ranked."""
        if not len(self.place):
            return
        self._settle(results)
        length = self.settings.length
        for bucket, x, y in runs(self.plain_bucket):
            lead = self.lead[self.plain[x:y]]
            left, right = self.place[lead] - self.first[lead], self.last[lead] + length - self.place[lead]
            counts = left + right
            at = np.repeat(self.first[lead] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            parts = [np.int64([y - x]), self.key[lead], self.least[self.plain[x:y]], left.astype(np.uint8), right.astype(np.uint8), self.data[at]]
            yield bucket, RECORDS, packed(b"".join([p.tobytes() for p in parts]))
        for bucket, x, y in runs(self.hot_bucket):
            yield bucket, STRINGS, packed_hashes(self.hot_hash[x:y], self.hot_check[x:y], self.hot_least[x:y])

    def removed(self, results) -> np.ndarray:
        """Which bytes go: those of strings that begin in a document with a smaller id."""
        length = self.settings.length
        steps = np.zeros(len(self.data) + 1, np.int32)
        if len(self.place):
            masks = self._settle(results)
            marks = np.zeros(len(self.lead), np.uint64)
            if len(self.plain):
                marks[self.plain] = np.concatenate([np.frombuffer(masks[RECORDS, b], np.uint64) for b, _, _ in runs(self.plain_bucket)])
            if len(self.hot_hash):
                gone = np.concatenate([np.frombuffer(masks[STRINGS, b], np.uint8) for b, _, _ in runs(self.hot_bucket)]).astype(bool)[self.hot_of]
                gone |= self.least[self.hot_record] > self.hot_least[self.hot_of]
                record = self.hot_record[gone]
                np.bitwise_or.at(marks, record, np.uint64(1) << (self.place[self.lead[record]] - self.hot_begin[gone]).astype(np.uint64))
            later = (self.owner[self.rows] > self.least[self.of]) | self.earlier[self.of]
            whole = self.rows[later]  # all strings of the row
            np.add.at(steps, self.first[whole], 1)
            np.add.at(steps, self.last[whole] + length, -1)
            some = ~later & (marks[self.of] > 0)
            rows, marks = self.rows[some], marks[self.of[some]]
            for j in range(length - self.settings.trigger + 1):
                begin = self.place[rows] - j
                go = (begin >= self.first[rows]) & (begin <= self.last[rows]) & (marks >> np.uint64(j) & np.uint64(1) > 0)
                np.add.at(steps, begin[go], 1)
                np.add.at(steps, begin[go] + length, -1)
        return np.cumsum(steps[:-1]) > 0


def runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted buckets."""
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else np.zeros(1, np.int64)
    return [(int(buckets[x]), int(x), int(y)) for x, y in zip(edges[:-1], edges[1:])]


def packed_hashes(hashes: np.ndarray, checks: np.ndarray, least: np.ndarray) -> bytes:
    return packed(np.int64(len(hashes)).tobytes() + hashes.tobytes() + checks.tobytes() + np.ascontiguousarray(least.view(np.uint8).reshape(-1, 8).T).tobytes())


def columns_of(matrix: np.ndarray) -> list[np.ndarray]:
    """Byte rows as big-endian 64-bit columns, the last first, as lexsort takes them."""
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    wide[:, :matrix.shape[1]] = matrix
    words = wide.view(">u8")
    return [words[:, c].astype(np.uint64) for c in range(words.shape[1])][::-1]


def suffix_order(matrix: np.ndarray, key: np.ndarray):
    """Order of byte rows under their keys, and how many bytes each has in common with the row before it."""
    order = np.lexsort((*columns_of(matrix), key))
    m, k = matrix[order], key[order]
    differs = np.ones((len(m), matrix.shape[1] + 1), bool)
    if len(m) > 1:
        differs[1:, :-1] = m[1:] != m[:-1]
    common = differs.argmax(axis=1)
    common[0] = -1
    common[1:][k[1:] != k[:-1]] = -1
    return order, common


def ragged_matrix(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray, width: int, reverse: bool = False) -> np.ndarray:
    """Byte slices as rows of one width, filled with zeros, from their end if `reverse`."""
    out = np.zeros((len(begin), width), np.uint8)
    for at in range(0, len(begin), ROWS):  # places of bytes take eight times as much as the bytes
        b, n = begin[at:at + ROWS], counts[at:at + ROWS]
        row = np.repeat(np.arange(at, at + len(b)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        source = np.repeat(b + n - 1, n) - inner if reverse else np.repeat(b, n) + inner
        out[row, inner] = flat[source]
    return out


def ranked_records(parts: list[bytes], settings: Settings) -> list[bytes]:
    """Per payload, a mask for each record: bit j says that the string that begins j bytes before the trigger has an earlier document."""
    length, width = settings.length, settings.length - settings.trigger
    key, least, left, right, flat, sizes = [], [], [], [], [], []
    for data in parts:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at = 8
        for out, kind in ((key, np.uint32), (least, np.int64), (left, np.uint8), (right, np.uint8)):
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        flat.append(np.frombuffer(data, np.uint8, -1, at))
        sizes.append(n)
    key, least, flat = np.concatenate(key), np.concatenate(least), np.concatenate(flat)
    left, right = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(left + right)[:-1]])
    phrases, before = suffix_order(ragged_matrix(flat, begin, left, width, reverse=True), key)
    parses, after = suffix_order(ragged_matrix(flat, begin + left, right, length), key)
    back_phrase, back_parse = np.argsort(phrases), np.argsort(parses)
    masks = np.zeros(len(key), np.uint64)
    shortest = length - right  # the string that begins last
    for j in range(width + 1):
        rows = np.flatnonzero((shortest <= j) & (j <= left))
        if len(rows) < 2:
            continue
        a = np.cumsum(before < j)[back_phrase[rows]]
        b = np.cumsum(after < length - j)[back_parse[rows]]
        place = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        order = np.argsort(place, kind="stable")
        p, d = place[order], least[rows][order]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        low = np.repeat(np.minimum.reduceat(d, head), np.diff(np.concatenate([head, [len(p)]])))
        masks[rows[order[d > low]]] |= np.uint64(1 << j)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return [masks[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]


def ranked_strings(parts: list[bytes]) -> list[bytes]:
    """Per payload, a byte for each hash: whether it has an earlier document."""
    hashes, checks, least, sizes = [], [], [], []
    for data in parts:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        hashes.append(np.frombuffer(data, np.uint64, n, 8))
        checks.append(np.frombuffer(data, np.uint32, n, 8 + 8 * n))
        planes = np.frombuffer(data, np.uint8, 8 * n, 8 + 12 * n).reshape(8, n)
        least.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1))
        sizes.append(n)
    h, c, d = np.concatenate(hashes), np.concatenate(checks), np.concatenate(least)
    order = np.lexsort((c, h))
    head = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]))
    low = np.repeat(np.minimum.reduceat(d[order], head), np.diff(np.concatenate([head, [len(h)]])))
    out = np.zeros(len(h), np.uint8)
    out[order] = d[order] > low
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return [out[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]


def ranked(payloads: DataFrame, settings: Settings) -> DataFrame:
    """(chunk, bucket, kind, masks): the payloads of a bucket and kind are compared together."""

    def run(table):
        import pyarrow as pa

        kind = table.column("kind")[0].as_py()
        if kind == CONTEXTS:
            masks = [packed_keys(k) for k, _ in shared_of([opened_keys(x.as_py()) for x in table.column("payload")], settings.hot)]
        else:
            parts = [opened(x.as_py()) for x in table.column("payload")]
            masks = [packed(m) for m in (ranked_records(parts, settings) if kind == RECORDS else ranked_strings(parts))]
        out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": table.column("kind"), "masks": pa.array(masks, pa.binary())})
        return out.filter(pa.array([m != NOTHING for m in masks], pa.bool_())) if kind == CONTEXTS else out

    return payloads.groupBy("bucket", "kind").applyInArrow(tidy(run), "chunk long, bucket int, kind int, masks binary")


def payloads(wanted: DataFrame, n: int, settings: Settings) -> DataFrame:
    """(chunk, bucket, kind, payload) of chunks with their shared keys: what is to be compared, or with the results of that what is to be ranked."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].as_py(),
                              batch.column(4)[i].as_py(), n, settings)
                rows = list(chunk.to_rank(batch.column(5)[i].as_py()) if batch.num_columns > 5 else chunk.to_compare())
                del chunk  # else it is held beside the next one
                if rows:
                    bucket, kind, payload = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
                        ["chunk", "bucket", "kind", "payload"])

    return wanted.mapInArrow(tidy(run), "chunk long, bucket int, kind int, payload binary")


def by_chunk(masks: DataFrame) -> DataFrame:
    return masks.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "masks")).alias("results"))


def cleaned(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text", as_text: bool = False,
            hand: Handoff | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and rest (a struct of the other columns).

    With as_text, kept is a text: a character that was cut in two goes whole. This is done where the bytes are, since a
    second function behind it would run in workers of its own beside these.

    A byte goes if a string of `length` bytes over it also begins in a document with a smaller id; strings are those of
    the input and never cross documents. Null texts are empty; rows without an id come after all others; rows that
    share an id leave each other alone. Short texts lose nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    hand = Handoff(spark, "substrings") if hand is None else hand
    chunks, name = bucketed(spark, chunked(docs, settings, id_column, text), "chunk")
    n = key_buckets(chunks)
    keys = hand.write(shared_keys(trigger_keys(chunks, n, settings), settings), "keys")
    side = keys.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys", "hot")).alias("side"))

    wanted = chunks.select("chunk", "ids", "sizes", "packed").join(side, "chunk").select("chunk", "ids", "sizes", "packed", "side")
    compared = hand.write(ranked(payloads(wanted, n, settings), settings), "compared")
    masks = hand.write(ranked(payloads(wanted.join(by_chunk(compared), "chunk"), n, settings), settings), "masks")
    results = by_chunk(compared.unionByName(masks))

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(1)[i].values.to_numpy()
                chunk = Chunk(ids, batch.column(2)[i].values.to_numpy(), batch.column(3)[i].as_py(), batch.column(5)[i].as_py(), n, settings)
                gone, at = chunk.removed(batch.column(6)[i].as_py()), chunk.offsets
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                first[at[(at > 0) & (at < len(gone))]] = gone[at[(at > 0) & (at < len(gone))]]
                counts = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
                left = np.concatenate([[0], np.cumsum(~gone)])[at].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(left.tobytes()), pa.py_buffer(chunk.data[~gone].tobytes())])
                if as_text:
                    kept = pa.array([x.as_py().decode("utf-8", "ignore") for x in kept], pa.string())
                rest = batch.column(4)[i].values
                columns = [pa.array(ids, mask=ids == LAST), pa.array(np.diff(at)), *(pa.array(c[at[1:]] - c[at[:-1]]) for c in counts), kept, rest]
                del chunk, gone, first, counts, left  # else they are held beside those of the next chunk
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    kind = chunks.schema["rest"].dataType.elementType.simpleString()
    joined = chunks.join(side, "chunk", "left").join(results, "chunk", "left").select("chunk", "ids", "sizes", "packed", "rest", "side", "results")
    return joined.mapInArrow(tidy(finish), f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, rest {kind}")


def substring_digests(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark, steps, before = docs.sparkSession, Handoff(docs.sparkSession, "substrings"), set(TABLES)
    own = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = cleaned(own, settings, "id", "text", hand=steps).selectExpr(
        f"id AS `{id_column}`", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
    written = Handoff(spark, "substrings").write(rows, "digests")
    steps.drop()
    mine = [t for t in TABLES if t not in before]
    if mine:
        drop_tables(spark, *mine)
    return written


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with what remains of their texts, in the columns they had; a character cut in two goes whole.

    A text of which nothing is left stays as an empty text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = cleaned(docs, settings, as_text=True)
    by_name = {"doc_id": F.col("id").alias("doc_id"), "text": F.col("kept").alias("text")} | {c: F.col("rest").getField(c).alias(c) for c in others}
    return rows.select(*[by_name[c] for c in docs.columns])
